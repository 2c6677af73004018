"""Queries over whole requests: contexts of gaps, strengths and summaries, answers, ingest, duplicate signals, and smaller rules, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.functions import lexicons as L
from paperloom.functions import text as T
from paperloom.operators import answers as A
from paperloom.operators import chunks as C
from paperloom.operators import dedup as D
from paperloom.operators import metadata as M
from paperloom.operators import operations as O
from paperloom.operators import pipelines as P
from paperloom.plans import fixtures as X
from paperloom.plans.fixtures import table
from paperloom.plans.queries import _ERROR, _EXPANDED, _KEYWORDS, _SCORE, LIMITING, PRAISING, QUERIES, SQL, STRONG, WORDS, hits_of, phrases, present, query, questions
from paperloom.sources import readers, trigrams
from paperloom.sources.steps import scratch

__all__ = ["QUERIES", "SQL"]

_REFERENCE = r"(regexp_matches(trim(string_split(lower({t}), chr(10))[1]), '^(references|bibliography|acknowledgments|acknowledgements|author contributions|conflict of interest|conflicts of interest)') OR len(regexp_extract_all({t}, '\[\d{{1,3}}\]')) >= 5)"
_LIMITED = f"({present('text', LIMITING)} > 0 AND NOT ({present('text', PRAISING)} > 0 AND {present('text', LIMITING)} <= {present('text', PRAISING)}))"
_COSINE = "round(1 - CASE WHEN len(tokens) > 0 AND len(asked) > 0 THEN list_inner_product(CAST(v AS DOUBLE[]), CAST(qv AS DOUBLE[])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(qv, lambda x: x * x)))) ELSE 0 END, 9)"
_STORED = f"c AS (SELECT paper_id, chunk_id, text, {X.TOKENS.format('text')} AS tokens FROM chunks), ce AS (SELECT *, {X.EMBED.format('tokens')} AS v FROM c)"


def _ranked(k: int, floor: float, pool: int) -> str:
    """SQL from s (query_id, paper_id, chunk_id, tokens, asked, dist) to hits within each paper."""
    return f"""pool AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY dist, chunk_id) AS place FROM s QUALIFY place <= {pool}),
f AS (SELECT *, round(greatest(0.0, least(1.0, 1 - dist)), 6) AS similarity, round({_SCORE.format(t="tokens", q="asked", k=_KEYWORDS)}, 6) AS keyword_score FROM pool),
hits AS (SELECT query_id, paper_id, chunk_id, similarity, round(0.8 * similarity + 0.2 * keyword_score, 6) AS final_score,
  row_number() OVER (PARTITION BY query_id, paper_id ORDER BY round(0.8 * similarity + 0.2 * keyword_score, 6) DESC, place) AS rank FROM f WHERE similarity >= {floor} QUALIFY rank <= {k})"""


def _wide(of: str) -> str:
    """SQL of the neighbours of the ranked rows `of` (paper_id, chunk_id, rank, similarity, final_score): n."""
    return f"""x AS (SELECT paper_id, h.chunk_id + o AS chunk_id, rank, o <> 0 AS is_neighbor, similarity, final_score FROM {of} h, (SELECT unnest([-1, 0, 1]) AS o)),
n AS (SELECT x.*, text, CASE WHEN is_neighbor THEN 0.0 ELSE final_score END AS score FROM x JOIN chunks USING (paper_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY paper_id, chunk_id ORDER BY rank, is_neighbor) = 1)"""


def _rendered(of: str, order: str, most: int) -> str:
    return f"""k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY {order}) AS i FROM {of} QUALIFY i <= {most}),
told AS (SELECT paper_id, count(*) AS n_sources, string_agg('[SOURCE ' || i || ']' || chr(10) || 'Paper: ' || paper_id || chr(10) || 'Page: 1' || chr(10) || CASE WHEN is_neighbor THEN 'Similarity: neighbor' ELSE 'Similarity: ' || printf('%.4f', floor(similarity * 10000 + 0.5) / 10000) END || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS context FROM k GROUP BY paper_id)"""


def _evidence(asked: list[str], boost: str, merge: str, keep: int) -> str:
    rows = ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in enumerate(asked))
    return f"""{X.CHUNKS}, {_STORED}, qt(query_id, text) AS (VALUES {rows}), q AS (SELECT query_id, {X.TOKENS.format("text")} AS asked FROM qt), qe AS (SELECT *, {X.EMBED.format("asked")} AS qv FROM q),
s AS (SELECT query_id, paper_id, chunk_id, tokens, asked, {_COSINE} AS dist FROM ce, qe), {_ranked(5, 0.2, 30)},
m AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY paper_id, chunk_id ORDER BY {merge}) = 1),
z AS (SELECT m.*, round(final_score + CASE WHEN {boost} THEN 0.05 ELSE 0 END, 6) AS boosted FROM m JOIN chunks USING (paper_id, chunk_id) WHERE final_score >= 0.18 AND NOT {_REFERENCE.format(t="text")}),
best AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY paper_id ORDER BY boosted DESC, chunk_id) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY boosted DESC, chunk_id) <= {keep}),
{_wide("best")}, body AS (SELECT * FROM n WHERE NOT {_REFERENCE.format(t="text")}), {_rendered("body", "score DESC, chunk_id", 15)}
SELECT paper_id, n_sources, sha256(context) AS context_sha FROM told"""


def _told(sources):
    return P.R.rendered(sources, "paper_id").select("paper_id", "n_sources", F.sha2("context", 256).alias("context_sha"))


@query("WITH RECURSIVE " + _evidence(L.GAP_QUESTIONS, _LIMITED, "final_score DESC, query_id, rank", 5))
def gap_contexts(spark, d):
    return _told(P.gap_sources(X.text_chunks(spark, d), limitations=LIMITING, positives=PRAISING))


@query("WITH RECURSIVE " + _evidence(L.STRENGTH_QUESTIONS, f"{present('text', STRONG)} > 0", "query_id, rank", 10))
def strength_contexts(spark, d):
    return _told(P.strength_sources(X.text_chunks(spark, d), strengths=STRONG))


@query(f"""WITH RECURSIVE {X.CHUNKS}, {_STORED}, {X.PAPERS},
q AS (SELECT id AS query_id, id AS of_paper, {X.TOKENS.format("coalesce(title, '') || ' ' || coalesce(abstract, '') || ' " + L.SUMMARY_QUESTION + "'")} AS asked FROM papers), qe AS (SELECT *, {X.EMBED.format("asked")} AS qv FROM q),
s AS (SELECT query_id, paper_id, chunk_id, tokens, asked, {_COSINE} AS dist FROM ce JOIN qe ON paper_id = of_paper), {_ranked(15, 0.05, 75)}, {_wide("hits")}, {_rendered("n", "chunk_id", 20)}
SELECT id AS paper_id, coalesce(n_sources, 0) AS n_sources, sha256(coalesce(context, CASE WHEN trim(full_text, ' ' || chr(10)) <> '' THEN '[SOURCE 1]' || chr(10) || 'Paper ID: ' || id || chr(10) || 'Full Text (truncated):' || chr(10) || substr(full_text, 1, 12000) END)) AS context_sha FROM papers LEFT JOIN told ON paper_id = id""")
def summary_contexts(spark, d):
    papers = X.papers(spark, d)
    return P.summary_contexts(papers, X.text_chunks(spark, d)).select("paper_id", "n_sources", F.sha2("context", 256).alias("context_sha"))


@query(f"""WITH RECURSIVE {_EXPANDED}, k AS (SELECT query_id, count(*) AS n FROM n GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN n IS NULL OR item_id % 5 = 4 THEN 'The available research context is insufficient to answer this question.' ELSE 'So it is [SOURCE 1] [SOURCE ' || item_id % 5 * 6 || ']' END AS answer, least(coalesce(n, 0), 12) AS n_sources,
  n IS NULL OR item_id % 5 = 4 OR item_id % 5 * 6 BETWEEN 1 AND least(n, 12) AS valid FROM benchmark LEFT JOIN k ON query_id = item_id""")
def rag_answers(spark, d):
    """The answer cites source 1 and another one by the question, which may not be there; for some the generator fails."""
    chunks, asked = X.text_chunks(spark, d), questions(spark, d)
    n = F.col("query_id") % 5
    said = lambda context: F.when(n != 4, F.concat(F.lit("So it is [SOURCE 1] [SOURCE "), n * 6, F.lit("]")))
    return P.asked(chunks, asked, said).select("query_id", "answer", "n_sources", "valid")


# -- ingest and duplicates ----------------------------------------------------------------------------------------------

_NORMAL = rf"""{X.PAPERS}, norm AS (SELECT id, nullif(trim(title), '') AS title, nullif(trim(doi), '') AS doi, nullif(trim(arxiv_id), '') AS arxiv_id, source, source_id, full_text, n_pages FROM papers),
raw AS (SELECT *, CASE WHEN title IS NULL THEN 'title is missing' WHEN n_pages IS NULL OR length(full_text) / n_pages < 100 THEN 'needs OCR' END AS reason FROM norm),
good AS (SELECT * FROM raw WHERE reason IS NULL AND id % 2 = 1), known AS (SELECT * FROM raw WHERE id % 2 = 0)"""
_TITLE_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '\.(pdf|txt)$', ''), '\b(research\s+paper|paper)\b', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _signals(of: str, doi: str, arxiv: str) -> str:
    return f"""SELECT id, 1 AS p, {doi} AS k FROM {of} WHERE doi <> '' UNION ALL SELECT id, 2, {arxiv} FROM {of} WHERE arxiv_id <> '' UNION ALL SELECT id, 3, source || chr(1) || source_id FROM {of}
  UNION ALL SELECT id, 4, sha256(trim(full_text, ' ' || chr(10))) FROM {of} WHERE trim(full_text, ' ' || chr(10)) <> '' UNION ALL SELECT id, 5, {_TITLE_KEY} FROM {of} WHERE {_TITLE_KEY} <> ''"""


_CLEAN_DOI, _CLEAN_ARXIV = "replace(lower(doi), 'https://doi.org/', '')", "replace(lower(arxiv_id), 'arxiv:', '')"


def _first(keys: str, known: str) -> str:
    return f"SELECT a.id, arg_min(existing_id, CAST(a.p AS BIGINT) * 1000000000000 + existing_id) AS existing_id, min(a.p) AS p FROM {keys} a JOIN (SELECT p, k, min(id) AS existing_id FROM {known} GROUP BY ALL) b USING (p, k) WHERE a.id <> existing_id GROUP BY a.id"


@query(f"""WITH {_NORMAL}, mine AS ({_signals("good", _CLEAN_DOI, _CLEAN_ARXIV)}), theirs AS ({_signals("known", "doi", "arxiv_id")}), old AS ({_first("mine", "theirs")}), twin AS ({_first("mine", "mine")})
SELECT r.id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN coalesce(old.p, twin.p) IS NOT NULL THEN 'duplicate' ELSE 'created' END AS status,
  coalesce(reason, ['doi', 'arxiv', 'source_id', 'text', 'title'][coalesce(old.p, twin.p)]) AS reason, coalesce(old.existing_id, twin.existing_id) AS existing_id
FROM raw r LEFT JOIN old ON old.id = r.id LEFT JOIN twin ON twin.id = r.id WHERE r.id % 2 = 1""")
def ingest_status(spark, d):
    papers = M.normalized(X.papers(spark, d).withColumn("authors", F.array("authors")))
    return M.ingest_status(papers.filter("id % 2 = 1"), papers.filter("id % 2 = 0"))


def _stored(spark, d):
    """Papers of even ids taken in as a first batch, into folders of this run."""
    papers = M.normalized(X.papers(spark, d).withColumn("authors", F.array("authors")).withColumn("categories", F.array().cast("array<string>")))
    at = f"{scratch(spark)}/{uuid.uuid4().hex}"
    paths = f"{at}/papers", f"{at}/chunks"
    P.ingest(papers.filter("id % 2 = 0"), *paths, batch=1)
    return papers, paths


#: What a first batch of even ids leaves: the good ones without a good one of a smaller id and a common key.
_FIRST_BATCH = f"""{_NORMAL}, good0 AS (SELECT * FROM raw WHERE reason IS NULL AND id % 2 = 0), mine0 AS ({_signals("good0", _CLEAN_DOI, _CLEAN_ARXIV)}), twin0 AS ({_first("mine0", "mine0")}),
stored AS (SELECT * FROM good0 WHERE id NOT IN (SELECT id FROM twin0))"""


@query(f"""WITH {_FIRST_BATCH}, mine AS ({_signals("good", _CLEAN_DOI, _CLEAN_ARXIV)}), theirs AS ({_signals("stored", "doi", "arxiv_id")}), old AS ({_first("mine", "theirs")}), twin AS ({_first("mine", "mine")})
SELECT r.id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN coalesce(old.p, twin.p) IS NOT NULL THEN 'duplicate' ELSE 'created' END AS status,
  coalesce(reason, ['doi', 'arxiv', 'source_id', 'text', 'title'][coalesce(old.p, twin.p)]) AS reason, coalesce(old.existing_id, twin.existing_id) AS existing_id
FROM raw r LEFT JOIN old ON old.id = r.id LEFT JOIN twin ON twin.id = r.id WHERE r.id % 2 = 1""")
def ingest_batches(spark, d):
    """A second batch against what the first has stored."""
    papers, paths = _stored(spark, d)
    return P.ingest(papers.filter("id % 2 = 1"), *paths, batch=2)


@query(f"""WITH RECURSIVE {_FIRST_BATCH}, {X.CHUNKS}
SELECT id, (SELECT count(*) FROM chunks WHERE paper_id = id) AS n_chunks FROM stored WHERE id % 7 <> 0""")
def stored_papers(spark, d):
    """What is left of a stored batch when the papers of every seventh id have been deleted, with their chunks."""
    papers, paths = _stored(spark, d)
    readers.delete_duplicates(spark, *paths, papers.filter("id % 7 = 0").select("id"))
    counts = readers.read_chunks(spark, paths[1]).groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    return readers.read_papers(spark, paths[0]).select("id").join(counts, "id", "left").select("id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query(rf"""WITH {X.PAPERS},
tt AS (SELECT id, {X.FUZZY_KEY} AS t, source, replace(lower(doi), 'https://doi.org/', '') AS doi FROM papers),
old AS (SELECT t, min(id) AS rep FROM tt WHERE id % 2 = 0 AND t <> '' GROUP BY t), fresh AS (SELECT t, min(id) AS rep FROM tt WHERE id % 2 = 1 AND t <> '' AND t NOT IN (SELECT t FROM old) GROUP BY t),
g2 AS (SELECT rep, t, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) WHERE length(t) >= 3),
near AS (SELECT a.t, b.rep FROM g2 a JOIN g2 b ON a.rep <> b.rep AND b.rep % 2 = 0 AND least(len(a.g), len(b.g)) >= 0.85 * greatest(len(a.g), len(b.g)) - 1e-9 WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.85 UNION ALL SELECT t, rep FROM old),
l AS (SELECT t, list_sort(list_distinct(list(rep))) AS candidates FROM near GROUP BY t),
d AS (SELECT doi, min(id) AS e FROM tt WHERE id % 2 = 0 AND doi <> '' GROUP BY doi), s2 AS (SELECT t, source, min(id) AS e FROM tt WHERE id % 2 = 0 AND t <> '' GROUP BY ALL)
SELECT tt.id, CASE WHEN d.e IS NOT NULL THEN 'doi_match' WHEN s2.e IS NOT NULL THEN 'title_source_match' END AS signal, coalesce(d.e, s2.e) AS existing_id,
  CASE WHEN coalesce(d.e, s2.e) IS NULL THEN array_to_string(coalesce(candidates, []), ',') ELSE '' END AS candidates
FROM tt LEFT JOIN d ON d.doi = tt.doi LEFT JOIN s2 ON s2.t = tt.t AND s2.source = tt.source LEFT JOIN l ON l.t = tt.t WHERE tt.id % 2 = 1""")
def duplicate_signals(spark, d):
    papers = X.papers(spark, d)
    rows = D.signals(papers.filter("id % 2 = 1"), papers.filter("id % 2 = 0"))
    return rows.select("id", "signal", "existing_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text <> '') SELECT a.doc_id, min(b.doc_id) AS first_id, count(*) - 1 AS n_others FROM h a JOIN h b USING (h) GROUP BY a.doc_id HAVING count(*) > 1")
def raw_text_duplicates(spark, d):
    return D.members(table(spark, d, "documents"), "doc_id", T.raw_hash(F.col("text")))


# -- smaller rules ------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, 'Title ' || doc_id AS title, CASE doc_id % 4 WHEN 0 THEN 'Ann Lee, Bo Chan' WHEN 1 THEN 'Ann Lee' WHEN 2 THEN NULL ELSE 'Ann Lee, Cy Poe' END AS authors FROM documents""")
def author_block(spark, d):
    n = F.col("doc_id")
    page = F.concat(F.lit("\n  Title "), n, F.lit("\nAnn  Lee\n"), F.when(n % 4 == 0, "Some University\nBo Chan\n").when(n % 4 == 3, "Cy Poe\nAnn Lee\nDee Fox 2019\n").otherwise(""), F.lit("Abstract\n"), F.col("text"))
    page = F.when(n % 4 == 2, F.concat(F.lit("Title "), n, F.lit("\nAbstract\n"), F.col("text"))).otherwise(page)
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(T.page_lines(page))).alias("lines"))
    return rows.select("doc_id", T.title_line(F.col("lines")).alias("title"), T.author_block(F.col("lines"), T.title_line(F.col("lines"))).alias("authors"))


@query("SELECT doc_id, text ILIKE '%thend%' OR text ILIKE '%SCHEI%' OR text ILIKE '%ciónes%' AS met FROM documents")
def chunk_search(spark, d):
    return table(spark, d, "documents").select("doc_id", T.any_like(F.col("text"), ["thend", "SCHEI", "ciónes"]).alias("met"))


@query("SELECT doc_id AS paper_id FROM documents WHERE text ILIKE '%thend%' OR text ILIKE '%SCHEI%' OR text ILIKE '%ciónes%the%'")
def chunk_search_indexed(spark, d):
    """Documents as stored chunks, found by their trigrams."""
    at = f"{scratch(spark)}/{uuid.uuid4().hex}"
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.lit(1).cast("long").alias("chunk_id"), "text")
    readers.append_chunks(chunks, at)
    trigrams.append_index(chunks, at)
    return trigrams.search(spark, at, ["thend", "SCHEI", "ciónes%the"]).select("paper_id")


@query(f"SELECT CAST(sum(CASE WHEN doc_id % 3 = 0 AND len({WORDS.format('text')}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS waiting, CAST(sum(CASE WHEN doc_id % 3 = 0 AND len({WORDS.format('text')}) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS blank, CAST(sum((doc_id % 3 <> 0)::INT) AS BIGINT) AS done FROM documents")
def missing_embeddings(spark, d):
    vector = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit(1.0)))
    return C.embedding_queue(table(spark, d, "documents").withColumn("embedding", vector))


#: Every line of every document as a page of its own, numbered in its id.
_PAGES = "own_pages AS (SELECT doc_id * 100000 + n AS doc_id, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)), "


@query(f"""WITH RECURSIVE {_PAGES}{X.CHUNKS.replace("FROM documents", "FROM own_pages")}
SELECT doc_id // 100000 AS paper_id, row_number() OVER (PARTITION BY doc_id // 100000 ORDER BY doc_id, place) AS chunk_id, CAST(doc_id % 100000 AS INTEGER) AS page_number, sha256(text) AS text_sha
FROM judged WHERE NOT (length(text) < 80 OR nw < 15 OR (nw >= 20 AND short / nw > 0.45) OR marks >= 2)""")
def page_chunks(spark, d):
    """Lines as pages: chunks overlap within a page, and kept ones are numbered over a paper's pages."""
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = C.chunked(pages.withColumn("page", F.col("at") + 1), "doc_id", "line", "page")
    return rows.select("paper_id", "chunk_id", "page_number", F.sha2("text", 256).alias("text_sha"))


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'exempt' WHEN user_id % 4 = 1 THEN 'strict' ELSE 'open' END AS kind, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || user_id ELSE 'h' || user_id END AS client FROM events""")
def request_kinds(spark, d):
    u = F.col("user_id")
    path = F.when(u % 4 == 0, "/health/").when(u % 4 == 1, F.concat(F.lit("/chat/"), u)).otherwise(F.concat(F.lit("/papers/"), u))
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(", 1.1.1.1")))
    return table(spark, d, "events").select("event_id", O.request_kind(path).alias("kind"), O.client_of(forwarded, F.concat(F.lit("h"), u)).alias("client"))


@query(r"""WITH RECURSIVE o AS (SELECT event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_type, i, t AS since, 1 AS checks FROM o WHERE i = 1
  UNION ALL SELECT o.event_type, o.i, CASE WHEN o.t - since > 21600000000 THEN o.t ELSE since END, checks + CAST(o.t - since > 21600000000 AS INT) FROM f JOIN o ON o.event_type = f.event_type AND o.i = f.i + 1)
SELECT event_type, max(i) AS n_asked, CAST(max(checks) AS BIGINT) AS n_checks FROM f GROUP BY event_type""")
def health_checks(spark, d):
    return O.stale_checks(table(spark, d, "events"), "event_type", "ts", "event_id", seconds=21600)


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'auth' WHEN 2 THEN 'auth' WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'auth' ELSE 'unavailable' END WHEN 6 THEN 'config' ELSE 'unavailable' END AS kind FROM events""")
def error_kinds(spark, d):
    n = F.col("event_id") % 7
    status = F.when(n == 0, 200).when(n == 1, 401).when(n == 2, 403).when(n == 3, 400).when(n == 4, 429)
    return table(spark, d, "events").select("event_id", O.error_kind(status, strict=F.col("user_id") % 2 == 0, ready=n != 6).alias("kind"))


@query(f"SELECT user_id, count(*) AS n_events, CAST(max(length({_ERROR})) AS BIGINT) AS longest, arg_max(substr(repeat({_ERROR} || '.', 200), 1, 2000), ts) AS last_error FROM events GROUP BY user_id")
def job_errors(spark, d):
    rows = table(spark, d, "events").withColumn("error", F.expr(_ERROR))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max(F.length("error")).cast("long").alias("longest"), F.max_by(O.error_text(F.repeat(F.concat("error", F.lit(".")), F.lit(200))), "ts").alias("last_error"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'W' || doc_id ELSE 'Inner' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'Ann Lee' ELSE 'Bo' END AS authors, CASE WHEN doc_id % 2 = 0 THEN 'https://x/' || doc_id ELSE 'u' END AS url FROM documents""")
def wrapped_metadata(spark, d):
    n = F.col("doc_id")
    inner = F.struct(F.lit("Inner").alias("title"), F.lit(None).cast("string").alias("url"), F.lit("u").alias("landing_page_url"))
    raw = table(spark, d, "documents").select(
        "doc_id", F.when(n % 2 == 1, inner).alias("paper"), F.concat(F.lit("W"), n).alias("title"), F.concat(F.lit("https://x/"), n).alias("url"), F.when(n % 3 != 0, F.array(F.lit("Bo"))).alias("authors"),
        F.array(F.struct(F.struct(F.lit("Ann Lee").alias("display_name")).alias("author"))).alias("authorships"),
    )
    return M.normalized(M.unwrapped(raw)).select("doc_id", "title", F.array_join("authors", "|").alias("authors"), "url")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Found ' || doc_id ELSE 'Kept' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'Ann' ELSE 'Bo' END AS authors FROM documents""")
def enriched_metadata(spark, d):
    n = F.col("doc_id")
    papers = table(spark, d, "documents").select("doc_id", F.when(n % 2 == 0, "scan.PDF").otherwise("Kept").alias("title"), F.lit("local").alias("source"), F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Bo"))).alias("authors"))
    found = papers.select("doc_id", F.concat(F.lit("Found "), n).alias("found_title"), F.array(F.lit("Ann")).alias("found_authors"))
    return M.enriched(papers, found, "doc_id").select("doc_id", "title", F.array_join("authors", "|").alias("authors"))


@query(f"WITH {X.PAPERS} SELECT id, title, source, coalesce(length(abstract), 0) > 0 AS has_abstract, trim(full_text, ' ' || chr(10)) <> '' AS has_full_text FROM papers")
def paper_cards(spark, d):
    rows = M.cards(X.papers(spark, d))
    return rows.select("id", "title", "source", (F.coalesce(F.length("abstract"), F.lit(0)) > 0).alias("has_abstract"), "has_full_text")


@query("""SELECT conv_id * 100 + turn AS request_id, CASE WHEN turn % 5 <> 4 THEN 'o' || conv_id END AS objective, CASE WHEN turn % 5 <> 4 THEN 'c' || turn END AS main_contribution, CASE WHEN turn % 5 <> 4 THEN 'm' END AS methodology FROM conversations""")
def summary_salvage(spark, d):
    """Objects in prose beside another one, in a string, two levels down, cut off, and one of too few parts."""
    body = "concat('\"Research Objective\": \"o', conv_id, '\", \"contributions\": \"c', turn, '\", \"approach\": \"m\"')"
    text = f"""CASE turn % 5 WHEN 0 THEN concat('First {{"a": 1}} and then {{', {body}, '}} and {{"b": 2}}') WHEN 1 THEN concat('{{"r": "', replace(concat('{{', {body}, '}}'), '"', '\\\\"'), '"}}')
      WHEN 2 THEN concat('{{"r": {{"s": {{', {body}, '}}}}}}') WHEN 3 THEN concat('Here: {{', {body}) ELSE '{{"goal": "g", "methods": "m"}}' END"""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), F.expr(text).alias("answer"))
    return A.parsed_summaries(rows).select("request_id", "objective", "main_contribution", "methodology")
