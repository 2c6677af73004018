"""Whole requests over stored chunks: answers to questions, gaps and strengths of papers, summaries.

A generator is a Column function from a context to an answer: an expression, or a model behind answers.answered().
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import lexicons as L
from paperloom.functions import text as T
from paperloom.operators import answers as A
from paperloom.operators import chunks as C
from paperloom.operators import dedup as D
from paperloom.operators import metadata as M
from paperloom.operators import retrieval as R
from paperloom.sources import readers, tables
from paperloom.sources.steps import saved

Generator = Callable[[Column], Column]


def asked(chunks: DataFrame, questions: DataFrame, generate: Generator, k: int = 8, floor: float = 0.15, most: int = 12) -> DataFrame:
    """query_id, answer, n_sources, n_flagged, valid, citations, invalid_citations, missing_citations of each question (query_id, text, tokens, embedding).

    Hits and their neighbours make the context; sources that try to instruct the model are counted, not dropped; the
    answer's citations are held against the sources. A question without hits, or whose generator gives null, has the
    answer that needs no citation. chunks: a stored table.
    """
    sources = R.numbered(R.with_neighbours(R.retrieve(chunks, questions, k, floor), chunks), chunks, most)
    flagged = sources.withColumn("flagged", F.size(T.injection_flags(F.col("text"))) > 0).groupBy("query_id").agg(F.count_if("flagged").alias("n_flagged"))
    told = questions.select("query_id").join(R.rendered(sources), "query_id", "left").join(flagged, "query_id", "left")
    said = told.withColumn("answer", F.coalesce(F.when(F.col("context").isNotNull(), generate(F.col("context"))), F.lit(T.NO_ANSWER)))
    n = F.coalesce("n_sources", F.lit(0)).cast("long")
    said = said.withColumn("v", F.explode(F.array(T.citation_verdict(F.col("answer"), n))))
    return said.select("query_id", "answer", n.alias("n_sources"), F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), "v.valid", "v.citations", "v.invalid_citations", "v.missing_citations")


#: Columns of a paper table.
PAPER = ("id", "title", "abstract", "authors", "doi", "source", "source_id", "arxiv_id", "published_date", "categories", "pdf_url", "full_text", "n_pages")


#: The priority of a key that is the paper's own id, by which papers that come again are found.
OWN_ID = len(D.SIGNALS)


def stored_keys(papers: DataFrame) -> DataFrame:
    """priority, key, id: the identity keys of papers as a paper table keeps them, and their ids as keys."""
    return D.identity_keys(papers, True).unionByName(papers.select(F.lit(OWN_ID).alias("priority"), F.col("id").cast("string").alias("key"), "id"))


def ingest(new: DataFrame, papers_path: str, chunks_path: str, batch: object = None) -> DataFrame:
    """Take in new papers (normalised, with id, full_text and n_pages): id, status, reason, existing_id of each, as metadata.ingest_status says.

    Created ones are appended to the paper table, their chunks with embeddings to the chunk table and their identity keys
    to a table beside the papers. Only keys are compared, and of the stored ones only the buckets that the new keys fall
    into are read: no stored text. What is taken in again is a duplicate of itself and adds nothing.

    batch: the name of this batch. Run again under its name, after a failure anywhere or after its end, it gives the same
    statuses and replaces what it wrote; readers see a batch's chunks and keys before its papers, and none while they are
    written.
    """
    spark, batch = new.sparkSession, tables.batch_name(batch)
    keys_path = readers.keys_path(papers_path)
    rows = saved(new.select(*PAPER))
    mine = saved(D.identity_keys(rows, False).unionByName(rows.select(F.lit(OWN_ID).alias("priority"), F.col("id").cast("string").alias("key"), "id")))
    known = tables.read(spark, keys_path, tables.met(mine, "key"), without=batch)
    known = mine.limit(0) if known is None else known.select("priority", "key", "id")
    again = known.filter(F.col("priority") == OWN_ID).join(rows.select("id"), "id", "left_semi").select("id", F.lit("duplicate").alias("was")).distinct()
    judged = M.judged(rows, known.filter(F.col("priority") < OWN_ID)).join(again, "id", "left")
    status = saved(judged.select("id", F.coalesce("was", "status").alias("status"), F.coalesce(F.when(F.col("was").isNotNull(), "id"), "reason").alias("reason"), F.when(F.col("was").isNotNull(), F.col("id")).otherwise(F.col("existing_id")).alias("existing_id")))
    created = saved(rows.join(status.filter("status = 'created'").select("id"), "id", "left_semi"))
    readers.append_chunks(R.embedded(C.chunked(created, "id", "full_text")), chunks_path, batch)
    tables.append(stored_keys(created), keys_path, "key", batch)
    readers.append_papers(created, papers_path, batch)
    return status


def body_text(c: Column) -> Column:
    """Whether a chunk is neither of a reference list nor of a picture."""
    return ~T.reference_chunk(c) & ~T.visual_chunk(c)


def evidence_sources(chunks: DataFrame, questions: Sequence[str], evidence: Callable[[Column], Column], how: str, keep: int, k: int = 5, floor: float = 0.2, most: int = 15) -> DataFrame:
    """paper_id, source, chunk_id, similarity, page_number, text: the numbered sources of every paper for a fixed list of questions.

    Each question is put to each paper alone, and each chunk counts once (how: see merged_hits). Chunks of references
    and pictures and those of a low score go, what has evidence comes first, the best `keep` are joined by their
    neighbours, of which references and pictures go too, and the first `most` by score are the sources.
    """
    hits = R.merged_hits(R.retrieve_in_papers(chunks, questions, k, floor), how)
    texts = chunks.select("paper_id", "chunk_id", "text")
    body = hits.join(texts, ["paper_id", "chunk_id"]).filter(body_text(F.col("text")))
    best = R.evidence_ranked(body, evidence(F.col("text")), most=keep, by="paper_id")
    order = Window.partitionBy("paper_id").orderBy(F.desc("boosted"), "chunk_id")
    ranked = best.drop("text").withColumn("query_id", F.col("paper_id")).withColumn("rank", F.row_number().over(order))
    wide = R.with_neighbours(ranked, chunks).drop("query_id")
    kept = wide.join(texts, ["paper_id", "chunk_id"]).filter(body_text(F.col("text"))).drop("text")
    return R.numbered(kept, chunks, most, by_score=True, by="paper_id")


def gap_sources(chunks: DataFrame, questions: Sequence[str] = tuple(L.GAP_QUESTIONS), limitations: Sequence[str] = tuple(L.LIMITATION_PHRASES), positives: Sequence[str] = tuple(L.POSITIVE_PHRASES)) -> DataFrame:
    return evidence_sources(chunks, questions, lambda t: T.limitation_evidence(t, limitations, positives), "max", 5)


def strength_sources(chunks: DataFrame, questions: Sequence[str] = tuple(L.STRENGTH_QUESTIONS), strengths: Sequence[str] = tuple(L.STRENGTH_PHRASES)) -> DataFrame:
    return evidence_sources(chunks, questions, lambda t: T.contains_any(t, strengths), "first", 10)


def _generated(sources: DataFrame, generate: Generator) -> tuple[DataFrame, DataFrame]:
    """Answers (request_id, answer) for each paper's context, and its sources (request_id, source, text)."""
    told = R.rendered(sources, "paper_id").select(F.col("paper_id").alias("request_id"), generate(F.col("context")).alias("answer"))
    return told, sources.select(F.col("paper_id").alias("request_id"), "source", "text")


def research_gaps(chunks: DataFrame, generate: Generator, **lists: Sequence[str]) -> DataFrame:
    """The limitations and gaps of every paper that hold against its sources: see answers.accepted_gaps. A paper without sources has none."""
    return A.accepted_gaps(*_generated(gap_sources(chunks, **lists), generate))


def verified_gaps(chunks: DataFrame, generate: Generator, verify: Generator, drop: bool = False, **lists: Sequence[str]) -> DataFrame:
    """research_gaps, each limitation held against its source by a verifier: see answers.verified."""
    sources = gap_sources(chunks, **lists)
    told, cited = _generated(sources, generate)
    return A.verified(A.accepted_gaps(told, cited), cited, verify, drop)


def strengths(chunks: DataFrame, generate: Generator, **lists: Sequence[str]) -> DataFrame:
    """The strengths of every paper that hold against its sources: see answers.accepted_strengths."""
    return A.accepted_strengths(*_generated(strength_sources(chunks, **lists), generate))


def summary_contexts(papers: DataFrame, chunks: DataFrame, k: int = 15, floor: float = 0.05, most: int = 20, head: int = 12_000) -> DataFrame:
    """paper_id, n_sources, context of every paper (id, title, abstract, full_text): what a broad question finds in it with neighbours, else the text's first characters; null without text."""
    broad = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.lit(L.SUMMARY_QUESTION))
    questions = R.embedded(papers.select(F.col("id").alias("query_id"), F.col("id").alias("paper_id"), broad.alias("text")))
    found = R.context(R.with_neighbours(R.retrieve_own(chunks, questions, k, floor), chunks), chunks, most).withColumnRenamed("query_id", "paper_id")
    rows = papers.select(F.col("id").alias("paper_id"), "full_text").join(found, "paper_id", "left")
    fallback = F.when(T.strip(F.col("full_text")) != "", F.concat(F.lit("[SOURCE 1]\nPaper ID: "), F.col("paper_id").cast("string"), F.lit("\nFull Text (truncated):\n"), F.substring("full_text", 1, head)))
    return rows.select("paper_id", F.coalesce("n_sources", F.lit(0).cast("long")).alias("n_sources"), F.coalesce("context", fallback).alias("context"))


def summaries(papers: DataFrame, chunks: DataFrame, generate: Generator) -> DataFrame:
    """paper_id, n_sources and the five parts of every paper's summary: null parts where the answer is no summary, `Not stated` without text."""
    told = summary_contexts(papers, chunks)
    parsed = A.parsed_summaries(told.select(F.col("paper_id").alias("request_id"), F.when(F.col("context").isNotNull(), generate(F.col("context"))).alias("answer")))
    rows = told.join(parsed.withColumnRenamed("request_id", "paper_id"), "paper_id", "left")
    return rows.select("paper_id", "n_sources", *[F.when(F.col("context").isNull(), F.lit(A.NOT_STATED)).otherwise(F.col(p)).alias(p) for p in L.SUMMARY_KEYS])
