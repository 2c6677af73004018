"""Views of the test tables as papers, chunks, questions and answers, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunks as C
from paperloom.operators.retrieval import embedded
from paperloom.sources.steps import saved, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id") if name == "documents" else df


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first sentence is the title, the first line the abstract, both whole. Identifiers come from ids by rule, so that some repeat; blank ones are null."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    first = F.element_at(F.split("text", "[.\n]"), 1)
    return d.select(
        n.alias("id"), F.when(n % 11 != 0, first).alias("title"), F.when(n % 7 != 0, F.concat(F.lit("Author "), (n % 13).cast("string"))).alias("authors"),
        F.when(n % 5 != 0, F.element_at(F.split("text", "\n"), 1)).alias("abstract"), F.when(n % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), ((n / 6).cast("long")).cast("string"))).alias("doi"),
        F.when(n % 4 == 0, F.concat(F.lit("arXiv:"), ((n / 8).cast("long")).cast("string"))).alias("arxiv_id"), "source", F.concat(F.lit("s"), (n % 401).cast("string")).alias("source_id"),
        F.when(n % 2 == 0, F.lit("2024-01-01")).alias("published_date"), F.when(n % 9 != 0, F.lit("x.pdf")).alias("pdf_url"), F.col("text").alias("full_text"),
        F.when(n % 10 != 0, F.greatest(F.lit(1), F.ceil(F.length("text") / 2000)).cast("long")).alias("n_pages"),
    )


PAPERS = """papers AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN regexp_split_to_array(text, '[.\n]')[1] END AS title,
    CASE WHEN doc_id % 7 <> 0 THEN 'Author ' || doc_id % 13 END AS authors, CASE WHEN doc_id % 5 <> 0 THEN string_split(text, chr(10))[1] END AS abstract,
    CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1/' || doc_id // 6 END AS doi, CASE WHEN doc_id % 4 = 0 THEN 'arXiv:' || doc_id // 8 END AS arxiv_id,
    source, 's' || doc_id % 401 AS source_id, CASE WHEN doc_id % 2 = 0 THEN '2024-01-01' END AS published_date, CASE WHEN doc_id % 9 <> 0 THEN 'x.pdf' END AS pdf_url,
    text AS full_text, CASE WHEN doc_id % 10 <> 0 THEN CAST(greatest(1, ceil(length(text) / 2000)) AS BIGINT) END AS n_pages
  FROM documents)"""

FUZZY_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '\.(pdf|txt)$', ''), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"

#: A text with what rules look for that the invented prose never holds, by the remainder of the id. Spark and DuckDB read it alike.
MARKED = """{t} || CASE {n} % 8
  WHEN 0 THEN ' Introduction [1] and [2,3]. Method and Results (Smith, 2020). Fig. 2 and Fig. 3, Table 1.' || chr(10) || 'References' || chr(10) || '[1] A. [2] B. [7] C.'
  WHEN 1 THEN chr(10) || chr(10) || {t} || chr(10) || chr(10) || {t}
  WHEN 2 THEN ' Conclusion. Discussion. Figure 9.' || chr(10) || 'Bibliography' || chr(10) || 'Smith, J. and Lee, K. 2019. Proceedings of things.' || chr(10) || '1. one'
  WHEN 3 THEN repeat(chr(10), 6) || 'ABSTRACT' ELSE '' END"""


def marked_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """papers whose texts hold citations, headings, figures and repeats by id."""
    return papers(spark, sf_dir).withColumn("full_text", F.expr(MARKED.format(t="full_text", n="id")))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, chunk_id, page_number, text, tokens, embedding of documents: a stored table, written once for a query, however often it reads it."""
    rows = C.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")
    return saved(embedded(rows))


CLEAN = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '<EOS>|<pad>', ' ', 'g'), '\s+', ' ', 'g'))"
#: Chunks by a recursion over each document's sentences.
CHUNKS = rf"""sents AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({CLEAN}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s
  FROM documents WHERE {CLEAN} <> ''),
fold AS (
  SELECT doc_id, s, 1 AS i, [s[1]] AS own, length(s[1]) + 1 AS n, CAST(NULL AS VARCHAR) AS done, 0 AS place FROM sents WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1, list_append(begun, s[i + 1]), base + length(s[i + 1]) + 1, CASE WHEN isfull THEN array_to_string(own, ' ') END, place + CAST(isfull AS INTEGER)
  FROM (
    SELECT *, CASE WHEN isfull THEN kept ELSE own END AS begun, CASE WHEN isfull THEN coalesce(list_sum(list_transform(kept, lambda x: length(x) + 1)), 0) ELSE n END AS base
    FROM (
      SELECT *, n + length(s[i + 1]) + 1 > 1200 AS isfull,
        own[len(own) - len(list_filter(range(1, len(own) + 1), lambda k: list_sum(list_transform(own[len(own) - k + 1:], lambda x: length(x) + 1)) - 1 <= 200)) + 1:] AS kept
      FROM fold WHERE i < len(s)))),
pieces AS (SELECT doc_id, place - 1 AS place, done AS text FROM fold WHERE done IS NOT NULL UNION ALL SELECT doc_id, place, array_to_string(own, ' ') FROM fold WHERE i = len(s)),
judged AS (
  SELECT doc_id, place, text, len(w) AS nw, len(list_filter(w, lambda x: length(x) <= 2)) AS short,
    CAST(contains(lower(text), 'proceedings of') AS INT) + CAST(contains(lower(text), 'computational linguistics') AS INT) + CAST(contains(lower(text), 'journal of') AS INT) + CAST(contains(lower(text), 'vol.') AS INT)
    + CAST(contains(lower(text), 'pages ') AS INT) + CAST(contains(lower(text), 'acl,') AS INT) + CAST(contains(lower(text), 'arxiv preprint') AS INT) AS marks
  FROM (SELECT *, string_split(text, ' ') AS w FROM pieces)),
chunks AS (
  SELECT doc_id AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS chunk_id, text FROM judged
  WHERE NOT (length(text) < 80 OR nw < 15 OR (nw >= 20 AND short / nw > 0.45) OR marks >= 2))"""
TOKENS = r"""list_distinct(list_filter(list_transform(string_split(translate(lower({0}), '-_' || chr(10) || chr(9) || chr(13), '     '), ' '), lambda w: trim(w, '.,?!:;()[]{{}}"''')), lambda w: length(w) >= 3))"""
#: A hashed embedding of a list of tokens.
EMBED = "list_transform(range(0, 64), lambda i: len(list_filter({0}, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 = i)))"
