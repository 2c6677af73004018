"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, byte_bpe, fingerprint, html_text, lexical, licenses, near_dup, packing, prefix_trie, substrings, topk, toxicity, url_filter
from paperloom.llm.common import table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by URL_RULES. Null and unparsable URLs have an empty host and path and the default verdict; repeated rows and null ids are judged row by row; an empty table gives no rows."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES), default="allow")


OP1_SQL = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
d AS (SELECT DISTINCT host, path FROM u),
m AS (
  SELECT host, path, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS k
  FROM d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path AND m.k = 1
"""


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors of every vector whose id is divisible by 100. Null vectors and ids, and null or non-finite components, take no part; ties go to the smaller id; repeated candidates each count; an empty table gives no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM k WHERE r <= 10
"""


#: The remainder of crc32(doc_id) mod 4 that is held out of the training of the toxicity classifier, and the score from which a text is rejected.
HELD_OUT, TOXIC_FROM = 2, 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole text; null and empty texts have the score of an empty bag; a null id is not held out; repeated rows are scored row by row; an empty table gives no rows."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), keep=~held_out)
    scores = toxicity.toxicity_scores(documents, model)
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best window for each license it holds. Null, empty and short texts hold none; repeated and null ids are matched row by row; an empty table gives no rows."""
    return licenses.license_matches(table(spark, sf_dir, "documents"), licenses.TEMPLATES, least=0.8)


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*[x.replace("'", "''") for x in row]) for row in licenses.TEMPLATES.items())
#: Counts the template shingles in every window, without hashes or bands.
OP3_SQL = f"""
WITH t(license, template) AS (VALUES {_TEMPLATE_ROWS}),
tw AS (SELECT license, list_filter(string_split_regex(translate(template, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM t),
ts AS (SELECT DISTINCT license, len(w) AS n_words, array_to_string(w[i:i+4], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tn AS (SELECT license, n_words, greatest(n_words // 16, 1) AS stride, count(*) AS n FROM ts GROUP BY ALL),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i+4], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
h AS (SELECT doc_id, license, n_words, p, shingle FROM ds JOIN ts USING (shingle)),
s AS (
  SELECT doc_id, license, shingle, unnest(range(CAST(ceil(greatest(p - h.n_words + 5, 0) / stride) AS BIGINT), p // stride + 1)) * stride AS start
  FROM h JOIN tn USING (license)),
c AS (SELECT doc_id, license, start, count(DISTINCT shingle) AS k FROM s GROUP BY ALL),
m AS (SELECT c.*, tn.n_words, k / n AS containment FROM c JOIN tn USING (license) WHERE k / n >= 0.8),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) AS r FROM m)
SELECT doc_id, license, CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, round(containment, 6) AS containment FROM b WHERE r = 1
"""


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it is kept. Null, empty and blank texts have an empty set and are linked with nothing; rows of one id count as one document; a row without id is kept; an empty table gives no rows."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
#: All pairs by their common shingles, and what each document reaches over links.
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
#: Every window of every document, and the words that later ones of equal windows cover.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: hash(array_to_string(w[i:i+19], ' ')))) AS h FROM d WHERE len(w) >= 20),
y AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k, true AS gone FROM y),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
o AS (SELECT doc_id, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone IS NULL) AS kept FROM v LEFT JOIN g USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's ids. A null or empty text is its end id alone; null and repeated ids are packed like others; a very long text is cut into many pieces; an empty table gives no rows."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document. Null texts are empty ones; null ids come last, repeated ids in the order of their texts; a single row is its own next; an empty table gives no rows."""
    return fingerprint.neighbour_edits(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows. Null and empty texts have no words; rows of one id are in the order of their texts, null ids last; of repeated rows the first keeps its words; an empty table gives no rows."""
    cleaned = substrings.drop_repeats(table(spark, sf_dir, "documents"), width=20)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text. Null and empty pages, and pages without any, have an empty one; null and repeated ids are read row by row; an empty table gives no rows."""
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text as digests. Null and empty texts have no ids; null and repeated ids are encoded row by row; an empty table gives no rows."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item. Null and empty texts have no terms, an item without terms has no rows; repeated rows of either table each count, ties go to the smaller doc_id, null ids last; empty tables give no rows."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Scores every document that holds a term of an item.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(t) * n_docs) // n_terms AS m FROM d, c WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
s AS (
  SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM (SELECT q, item_id, unnest(t) AS term FROM i) JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations. Null roles and texts are empty ones; rows without a conv_id take no part; turns of one number are in the order of their digests, repeated rows follow each other; an empty table gives no rows."""
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))))


#: The remainder of a CRC-32 by bits: each digit is followed by seven zeros, and each step takes one bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, e: xor(xor(s, e) >> 1, CASE WHEN xor(s, e) & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT))"
#: Every prefix of every rebuilt conversation as a list of digests; a node counts for all nodes above it.
OP12_SQL = f"""
WITH a AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM a)),
u AS (
  SELECT c.conv_id, pos, 0 AS own, key, chars FROM c JOIN a ON a.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, pos, 1, key, chars FROM a JOIN c USING (conv_id) WHERE pos > h),
t AS (
  SELECT conv_id, row_number() OVER x AS depth, chars, sha256(string_agg(key, ',') OVER x) AS node FROM u WINDOW x AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS last FROM t GROUP BY conv_id),
p AS (SELECT t.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = last AS ended FROM t JOIN e USING (conv_id)),
n AS (
  SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, bool_and(ended) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM p GROUP BY depth, node),
s AS (SELECT t.depth, t.node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM n JOIN t ON t.conv_id = n.conv_id AND t.depth <= n.depth GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, node) LEFT JOIN k USING (depth, node) LEFT JOIN n p ON p.depth = n.depth - 1 AND p.node = n.above
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes as digests. Null and empty texts have no ids; null and repeated ids are encoded row by row; an empty table gives no rows."""
    coded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_toxicity": op2_toxicity,
        "op3_license_scan": op3_license_scan,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_packing": op5_packing,
        "op6_fingerprints": op6_fingerprints,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_exact_topk": op8_exact_topk,
        "op9_html_text": op9_html_text,
        "op10_bpe": op10_bpe,
        "op11_lexical_search": op11_lexical_search,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": OP1_SQL, "op3_license_scan": OP3_SQL, "op4_minhash_dedup": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op8_exact_topk": OP8_SQL, "op11_lexical_search": OP11_SQL, "op12_prefix_trie": OP12_SQL,
    }
