"""Hybrid retrieval: a pool by vector distance, re-ranked with keywords, expanded to neighbours, rendered as context."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators.similarity import QUERY_BLOCK, top_k
from paperloom.sources.steps import saved


def embedded(rows: DataFrame, text_column: str = "text", dimensions: int = 64, model: Callable | None = None) -> DataFrame:
    """rows with tokens (of the text) and embedding (unit length): hashed counts of tokens, or a model's: see vectors.model_embedding."""
    if model:
        return rows.withColumn("tokens", F.explode(F.array(T.tokens(F.col(text_column))))).withColumn("embedding", V.model_embedding(F.col(text_column), model))

    token_lists = V.sliced(lambda column: pa.array([T.token_list(x) for x in column.to_pylist()], pa.list_(pa.string())))

    def work(column: pa.Array) -> pa.Array:
        tokens = token_lists(column)  # of a whole batch, so that a token is hashed once in it
        return pa.StructArray.from_arrays([tokens, V.lists_of(V.hashed_vectors(tokens, dimensions))], names=["tokens", "embedding"])

    both = F.arrow_udf(work, "tokens array<string>, embedding array<double>")(F.col(text_column))
    return rows.withColumn("__both", both).select(*rows.columns, "__both.tokens", "__both.embedding")


def pool_size(k: int) -> int:
    return min(max(5 * k, 30), 100)


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 8, floor: float = 0.15) -> DataFrame:
    """query_id, rank, paper_id, chunk_id, similarity, keyword_score, final_score of each question's k best chunks.

    chunks: paper_id, chunk_id, tokens, embedding, best a stored table, as it is read twice; questions: query_id, tokens,
    embedding, of any number: they are searched in blocks, and what is near is written, so that Spark sees whether it is
    short: then no tokens are shuffled. A pool of max(5k, 30), at most 100, chunks by cosine distance is re-ranked by 0.8 similarity + 0.2
    keyword score (ties in the order of distance and ids), then the similarity floor, then the first k.
    """
    k = min(max(k, 1), 20)
    near = saved(top_k(chunks, questions.select("query_id", F.col("embedding").alias("query")), pool_size(k)).withColumnRenamed("rank", "at"))
    pool = chunks.select("paper_id", "chunk_id", "tokens").join(near, ["paper_id", "chunk_id"]).join(questions.select("query_id", F.col("tokens").alias("asked")), "query_id")
    return _ranked(pool, ["query_id"], k, floor)


def _ranked(pool: DataFrame, by: list[str], k: int, floor: float) -> DataFrame:
    """The k best of each `by` of a pool: distance, at (its order by distance), tokens, asked."""
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance")))
    ranked = pool.withColumn("similarity", F.round(similarity, 6)).withColumn("keyword_score", F.round(T.keyword_score(F.col("tokens"), F.col("asked")), 6))
    ranked = ranked.withColumn("final_score", F.round(V.hybrid_score(F.col("similarity"), F.col("keyword_score")), 6)).filter(F.col("similarity") >= floor)
    order = Window.partitionBy(*by).orderBy(F.desc("final_score"), "at")
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "paper_id", "chunk_id", "similarity", "keyword_score", "final_score")


def _pooled(rows: DataFrame, k: int, floor: float) -> DataFrame:
    """The k best chunks of each question within each paper. rows: query_id, paper_id, chunk_id, tokens, asked, distance of every chunk that a question is put to."""
    k = min(max(k, 1), 20)
    return _ranked(_pool(rows, k), ["query_id", "paper_id"], k, floor)


def _pool(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "paper_id").orderBy(F.round("distance", 9), "chunk_id")
    return rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= pool_size(k))


def retrieve_in_papers(chunks: DataFrame, questions: Sequence[str], k: int = 5, floor: float = 0.2, dimensions: int = 64) -> DataFrame:
    """retrieve() for a fixed list of questions put to every paper alone: query_id is a question's place. chunks: paper_id, chunk_id, tokens, embedding.

    The questions' vectors are part of the plan; a chunk is scored against all of them at once, and ids and distances
    alone make the pools, which tokens are then joined to.
    """
    asked = [T.token_list(q) for q in questions]
    q = V.hashed_vectors(pa.array(asked, pa.list_(pa.string())), dimensions)

    def work(column: pa.Array) -> pa.Array:
        vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, dimensions))
        return V.lists_of(np.round(1 - vectors @ q.T, 9))

    distances = F.arrow_udf(work, "array<double>")(F.col("embedding"))
    lists = F.array(*[F.array(*[F.lit(t) for t in own]).cast("array<string>") for own in asked])
    rows = chunks.select("paper_id", "chunk_id", distances.alias("d")).select("paper_id", "chunk_id", F.posexplode("d").alias("query_id", "distance"))
    k = min(max(k, 1), 20)
    pool = _pool(rows, k).join(chunks.select("paper_id", "chunk_id", "tokens"), ["paper_id", "chunk_id"])
    pool = pool.select("*", F.element_at(lists, F.col("query_id") + 1).alias("asked")).withColumn("query_id", F.col("query_id").cast("long"))
    return _ranked(pool, ["query_id", "paper_id"], k, floor)


def retrieve_own(chunks: DataFrame, questions: DataFrame, k: int = 15, floor: float = 0.05) -> DataFrame:
    """retrieve() for questions that are each put to one paper. questions: query_id, paper_id, tokens, embedding."""
    asked = questions.select("query_id", "paper_id", F.col("tokens").alias("asked"), F.col("embedding").alias("q"))
    rows = chunks.select("paper_id", "chunk_id", "tokens", "embedding").join(asked, "paper_id")
    return _pooled(rows.withColumn("distance", F.round(1 - V.dot(F.col("embedding"), F.col("q")), 9)), k, floor)


def with_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Hits and the chunks beside them, each once per question: query_id, paper_id, chunk_id, is_neighbor, similarity, final_score.

    A hit beside a hit of an earlier rank is that one's neighbour: without similarity, with a score of 0. The band join is
    an equi-join on paper_id and on each of the 2 * window + 1 places.
    """
    wanted = hits.select("query_id", "rank", "paper_id", F.col("chunk_id").alias("of"), "similarity", "final_score", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("off"))
    wanted = wanted.withColumn("chunk_id", F.col("of") + F.col("off")).filter("chunk_id >= 0").join(chunks.select("paper_id", "chunk_id"), ["paper_id", "chunk_id"])
    self_ = F.col("off") == 0
    order = Window.partitionBy("query_id", "paper_id", "chunk_id").orderBy("rank", (~self_).cast("int"))
    first = wanted.withColumn("n", F.row_number().over(order)).filter("n = 1")
    return first.select("query_id", "paper_id", "chunk_id", (~self_).alias("is_neighbor"), F.when(self_, F.col("similarity")).alias("similarity"), F.when(self_, F.col("final_score")).otherwise(0.0).alias("final_score"))


def numbered(rows: DataFrame, chunks: DataFrame, most: int = 12, by_score: bool = False, by: str = "query_id") -> DataFrame:
    """The first rows of each `by` in document order, or by score (ties in document order), as sources: by, source (from 1), paper_id, chunk_id, similarity, page_number, text."""
    keys = ([F.desc("final_score")] if by_score else []) + [F.col("paper_id"), F.col("chunk_id")]
    picked = rows.withColumn("source", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).filter(F.col("source") <= most)
    told = picked.join(chunks.select("paper_id", "chunk_id", "page_number", "text"), ["paper_id", "chunk_id"])
    return told.select(*dict.fromkeys([by, "source", "paper_id", "chunk_id", "similarity", "page_number", "text"]))


def rendered(sources: DataFrame, by: str = "query_id") -> DataFrame:
    """by, n_sources, context: numbered sources as one text, [SOURCE i] first. A request has few sources, so they are gathered."""
    line = F.concat_ws("\n", F.format_string("[SOURCE %d]", F.col("source")), F.format_string("Paper: %d", F.col("paper_id")), F.format_string("Page: %d", F.col("page_number")), F.when(F.col("similarity").isNotNull(), F.format_string("Similarity: %.4f", F.floor(F.col("similarity") * 10000 + 0.5) / 10000)).otherwise("Similarity: neighbor"), F.col("text"))
    gathered = sources.select(by, F.struct("source", line.alias("line")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return gathered.select(by, F.size("xs").cast("long").alias("n_sources"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n\n").alias("context"))


def context(rows: DataFrame, chunks: DataFrame, most: int = 12, by_score: bool = False) -> DataFrame:
    """query_id, n_sources, context: the first rows in document order (or by score), numbered [SOURCE i], with their texts."""
    return rendered(numbered(rows, chunks, most, by_score))


def merged_hits(hits: DataFrame, how: str = "max") -> DataFrame:
    """The hits of many queries of one request, each chunk once. how: max (the greatest score; ties to the earlier query) or first (the earliest query and rank)."""
    keys = {"max": [F.desc("final_score"), "query_id", "rank"], "first": ["query_id", "rank"]}[how]
    order = Window.partitionBy("paper_id", "chunk_id").orderBy(*keys)
    return hits.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def evidence_ranked(hits: DataFrame, has_evidence, floor: float = 0.18, boost: float = 0.05, most: int = 5, by: str | None = None) -> DataFrame:
    """Hits of at least the floor by score, with the boost for evidence, the first `most` (of each `by`)."""
    scored = hits.filter(F.col("final_score") >= floor).withColumn("boosted", F.round(F.col("final_score") + F.when(has_evidence, boost).otherwise(0.0), 6))
    order = [F.desc("boosted"), F.col("paper_id"), F.col("chunk_id")]
    if by:
        return scored.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("n") <= most).drop("n")
    return scored.orderBy(*order).limit(most)


def keyword_matches(documents: DataFrame, questions: DataFrame, keywords: Sequence[str], id_column: str = "doc_id") -> DataFrame:
    """query_id, id, score (see text.keyword_score) of every document and question (query_id, text) that share a token.

    Questions are taken in blocks of about QUERY_BLOCK, whose tokens are collected and broadcast as lists of questions by
    token; a document's tokens are counted where it is read, so nothing is shuffled and no token, however common, is a
    group of rows.
    """
    asked = questions.select("query_id", F.explode(F.array(T.tokens(F.col("text")))).alias("asked")).filter(F.size("asked") > 0)
    count = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = saved(asked) if count > 1 else asked
    held = documents.select(id_column, T.tokens(F.col("text")).alias("tokens"))
    bucket = F.pmod(F.xxhash64("query_id"), F.lit(count))
    both = reduce(DataFrame.unionByName, [_shared_tokens(held, asked.filter(bucket == b).collect(), keywords, id_column, questions.schema["query_id"]) for b in range(count)])
    score = F.least(F.lit(0.5), F.col("both") / F.col("n") * 0.35 + F.least(F.lit(0.15), F.col("known") * 0.05))
    return both.select("query_id", id_column, F.round(score, 6).alias("score"))


def _shared_tokens(held: DataFrame, asked: list, keywords: Sequence[str], id_column: str, query: StructField) -> DataFrame:
    """query_id, id, n, both, known of one block: the question's tokens, those that a document has too, and those of them that are keywords."""
    of: dict[str, list[int]] = {}
    for at, row in enumerate(asked):
        for token in row["asked"]:
            of.setdefault(token, []).append(at)
    ids, n = pa.array([r["query_id"] for r in asked], to_arrow_type(query.dataType)), np.array([len(r["asked"]) for r in asked], np.int64)
    shared = held.sparkSession.sparkContext.broadcast((ids, n, {t: np.array(x) for t, x in of.items()}, set(keywords)))
    schema = StructType([query, held.schema[id_column], StructField("n", LongType()), StructField("both", LongType()), StructField("known", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, of, keywords = shared.value
        for batch in batches:
            places, owners, both, known = [], [], [], []
            for i, tokens in enumerate(batch.column("tokens").to_pylist()):
                met = [t for t in tokens or [] if t in of]
                if not met:
                    continue
                total = np.bincount(np.concatenate([of[t] for t in met]), minlength=len(n))
                special = [of[t] for t in met if t in keywords]
                own = np.flatnonzero(total)
                places.append(own)
                owners.append(np.full(len(own), i))
                both.append(total[own])
                known.append((np.bincount(np.concatenate(special), minlength=len(n)) if special else np.zeros(len(n), np.int64))[own])
            if places:
                at = np.concatenate(places)
                columns = [ids.take(pa.array(at)), batch.column(id_column).take(pa.array(np.concatenate(owners))), pa.array(n[at]), pa.array(np.concatenate(both)), pa.array(np.concatenate(known))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", id_column, "n", "both", "known"])

    return held.mapInArrow(work, schema)


def evaluated(items: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """n, score: of the items (query_id, k: key terms) that have terms, the percentage for which at least half of them stand in what retrieval returned."""
    found = hits.join(chunks.select("paper_id", "chunk_id", "tokens"), ["paper_id", "chunk_id"]).select("query_id", F.explode("tokens").alias("term")).distinct()
    wanted = items.filter(F.size("k") > 0).select("query_id", F.size("k").alias("n"), F.explode("k").alias("term"))
    each = wanted.join(found.withColumn("met", F.lit(1)), ["query_id", "term"], "left").groupBy("query_id", "n").agg(F.count("met").alias("met"))
    return each.agg(F.count("*").alias("n"), F.round(100 * F.avg((2 * F.col("met") >= F.col("n")).cast("double")), 4).alias("score"))
