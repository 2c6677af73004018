"""Vector search over chunks, comparison of papers and novelty against a corpus.

Asking rows are taken in blocks of a bounded size, which are broadcast; each task holds a block against its own rows as
matrices, and only maxima or nearest rows leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.steps import saved

#: Chunks whose best matches one pass over all chunks finds.
BLOCK = 2048
#: Queries of a search that one pass over the chunks serves; their vectors are what is broadcast.
QUERY_BLOCK = 4096
#: Similarities held at once by a task of a search.
CELLS = 1 << 22
#: Similarities held at once by a task of a comparison of papers, which has several arrays of them.
BEST_CELLS = 1 << 19


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of unit length; zero vectors stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True) if m.size else np.ones((len(m), 1))
    return m / np.where(n > 0, n, 1)


def top_k(chunks: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank, paper_id, chunk_id, distance of each query's k nearest chunks by cosine distance (to nine places); ties by (paper_id, chunk_id).

    queries (query_id, query) may be many: they are taken in blocks of about QUERY_BLOCK, and only a block is collected
    and broadcast at once. A task keeps each query's kth distance so far and sends on what reaches it, of each part of a
    batch the first k only, so that a vector with many copies makes no more rows than another.
    """
    wanted = queries.filter(F.col("query").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    count = max(1, -(-wanted.count() // QUERY_BLOCK))
    bucket = F.pmod(F.xxhash64("query_id"), F.lit(count))
    rows = chunks.filter(F.col(vector).isNotNull()).select(F.col("paper_id").cast("long").alias("paper_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col(vector).cast("array<double>").alias("v"))
    if count > 1:
        wanted = saved(wanted)
    keep = saved if count > 1 else lambda df: df
    scored = reduce(DataFrame.unionByName, [keep(_near(rows, wanted.filter(bucket == b).orderBy("query_id").collect(), k)) for b in range(count)])
    order = Window.partitionBy("query_id").orderBy("distance", "paper_id", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _near(rows: DataFrame, asked: list, k: int) -> DataFrame:
    """query_id, paper_id, chunk_id, distance: a superset of the k nearest rows of each query of one block."""
    ids, q = np.array([r["query_id"] for r in asked], np.int64), np.array([r["query"] for r in asked], float).reshape(len(asked), -1)
    n = np.linalg.norm(q, axis=1, keepdims=True)
    shared = rows.sparkSession.sparkContext.broadcast((ids, q / np.where(n > 0, n, 1)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = np.full((len(ids), k), np.inf)  # of each query the k least distances so far
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vectors, paper, chunk = matrix(batch.column("v")), np.asarray(batch.column("paper_id")), np.asarray(batch.column("chunk_id"))
            finite = np.isfinite(vectors).all(axis=1)
            vectors, paper, chunk = vectors[finite], paper[finite], chunk[finite]
            for at in range(0, len(vectors), step):
                sims = q @ vectors[at : at + step].T
                edge = 1 - best.max(axis=1)
                if sims.shape[1] > k and np.isinf(edge).any():
                    edge = np.maximum(edge, np.partition(sims, -k, axis=1)[:, -k])
                i, j = np.nonzero(sims >= edge[:, None] - 2e-9)
                d, j = np.round(1 - sims[i, j], 9), j + at
                order = np.lexsort((chunk[j], paper[j], d, i))
                i, j, d = i[order], j[order], d[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                first = place < k
                i, j, d, place = i[first], j[first], d[first], place[first]
                new = np.full_like(best, np.inf)
                new[i, place] = d
                best = np.partition(np.concatenate([best, new], axis=1), k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(paper[j]), pa.array(chunk[j]), pa.array(d)], names=["query_id", "paper_id", "chunk_id", "distance"])

    return rows.mapInArrow(near, "query_id long, paper_id long, chunk_id long, distance double")


def best_matches(chunks: DataFrame, vector: str = "embedding", normed: bool = True, targets: DataFrame | None = None) -> DataFrame:
    """paper_id, chunk_id, other_id, best_chunk, best: for each chunk (of the papers in targets: paper_id; else of all) and each other paper, its best chunk; ties to the least chunk_id.

    normed: cosines; else inner products of unit vectors. The asking chunks are taken in blocks of BLOCK: a block is
    collected and broadcast, and each task holds it against its own rows and sends on one row for each asking chunk and
    paper it has, so no vector is shuffled. Where there are several blocks, what each finds is written.
    """
    rows = chunks.filter(F.col(vector).isNotNull()).select(F.col("paper_id").cast("long").alias("paper_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col(vector).cast("array<double>").alias("v"))
    asking = rows if targets is None else rows.join(targets.select("paper_id").distinct(), "paper_id", "left_semi")
    count = max(1, -(-asking.count() // BLOCK))
    bucket = F.pmod(F.xxhash64("paper_id", "chunk_id"), F.lit(count))
    ordered = rows.sortWithinPartitions("paper_id", "chunk_id")
    keep = saved if count > 1 else lambda df: df
    found = [keep(_best(ordered, asking.filter(bucket == b).orderBy("paper_id", "chunk_id").collect(), normed)) for b in range(count)]
    best = F.max(F.struct("best", (-F.col("best_chunk")).alias("before"))).alias("x")
    return reduce(DataFrame.unionByName, found).groupBy("paper_id", "chunk_id", "other_id").agg(best).select("paper_id", "chunk_id", "other_id", (-F.col("x.before")).alias("best_chunk"), F.col("x.best").alias("best"))


def best_matches_among(chunks: DataFrame, targets: DataFrame, vector: str = "embedding", normed: bool = True) -> DataFrame:
    """best_matches of the papers in targets (paper_id) with each other: no other paper's chunks are met."""
    return best_matches(chunks.join(targets.select("paper_id").distinct(), "paper_id", "left_semi"), vector, normed)


def _best(rows: DataFrame, asking: list, normed: bool) -> DataFrame:
    """Of rows in the order of papers: for each asking chunk the best row of each other paper, as far as a task goes."""
    scaled = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1) if normed else m
    q = np.array([r["v"] for r in asking], float).reshape(len(asking), len(asking[0]["v"]) if asking else 0)
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["paper_id"] for r in asking], np.int64), np.array([r["chunk_id"] for r in asking], np.int64), scaled(q)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_paper, own_chunk, x = shared.value
        step = max(1, BEST_CELLS // max(1, len(own_paper)))

        def told(papers: np.ndarray, chunks: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
            a, b = np.nonzero(own_paper[:, None] != papers[None, :])
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (own_paper[a], own_chunk[a], papers[b], chunks[a, b], best[a, b])], names=["paper_id", "chunk_id", "other_id", "best_chunk", "best"])

        held = None  # of the last paper so far, which the next rows may go on with
        for batch in batches:
            for i in range(0, batch.num_rows if len(own_paper) else 0, step):
                part = batch.slice(i, step)
                paper, ids = part.column("paper_id").to_numpy(), part.column("chunk_id").to_numpy()
                y = scaled(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(paper), -1))
                scores = np.round(x @ y.T, 12)
                starts = np.flatnonzero(np.r_[True, paper[1:] != paper[:-1]])
                best = np.maximum.reduceat(scores, starts, axis=1)
                # of the best, the first: papers' rows are in the order of their chunks
                place = np.where(scores == np.repeat(best, np.diff(np.append(starts, len(paper))), axis=1), np.arange(len(paper)), len(paper))
                papers, chunks = paper[starts], ids[np.minimum.reduceat(place, starts, axis=1)]
                if held and held[0][0] == papers[0]:
                    before = held[2] >= best[:, :1]
                    chunks[:, :1], best[:, :1] = np.where(before, held[1], chunks[:, :1]), np.where(before, held[2], best[:, :1])
                elif held:
                    yield told(*held)
                if len(papers) > 1:
                    yield told(papers[:-1], chunks[:, :-1], best[:, :-1])
                held = papers[-1:].copy(), chunks[:, -1:].copy(), best[:, -1:].copy()
        if held:
            yield told(*held)

    return rows.mapInArrow(work, "paper_id long, chunk_id long, other_id long, best_chunk long, best double")


def comparisons(matches: DataFrame) -> DataFrame:
    """a, b (a < b), similarity (mean of both directions' mean best matches, within 0 and 1) and difference_score."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best")))
    one = matches.groupBy("paper_id", "other_id").agg(F.avg(held).alias("mean"))
    both = one.groupBy(F.least("paper_id", "other_id").alias("a"), F.greatest("paper_id", "other_id").alias("b")).agg((F.sum("mean") / 2).alias("m"))
    return both.select("a", "b", F.round("m", 4).alias("similarity"), F.round(1 - F.col("m"), 4).alias("difference_score"))


def evidence(matches: DataFrame, most: int = 5) -> DataFrame:
    """a, b, rank, chunk_a, chunk_b, similarity: of both directions the best distinct pairs of chunks of two papers."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best")))
    forward = F.col("paper_id") < F.col("other_id")
    rows = matches.select(
        F.least("paper_id", "other_id").alias("a"), F.greatest("paper_id", "other_id").alias("b"),
        F.when(forward, F.col("chunk_id")).otherwise(F.col("best_chunk")).alias("chunk_a"),
        F.when(forward, F.col("best_chunk")).otherwise(F.col("chunk_id")).alias("chunk_b"),
        F.round(held, 6).alias("similarity"),
    ).distinct()
    order = Window.partitionBy("a", "b").orderBy(F.desc("similarity"), "chunk_a", "chunk_b")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def novelty(matches: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """paper_id, other_id, rank, similarity, novelty_score: mean over a paper's chunks of its best cosine with each other paper (negatives count 0); novelty is 1 - the greatest.

    duplicates (paper_id, other_id) are left out beforehand. See unscored() for papers that have no score.
    """
    if duplicates is not None:
        matches = matches.join(duplicates, ["paper_id", "other_id"], "left_anti")
    per = matches.groupBy("paper_id", "other_id").agg(F.round(F.avg(F.greatest(F.lit(0.0), F.col("best"))), 4).alias("similarity"))
    order = Window.partitionBy("paper_id").orderBy(F.desc("similarity"), "other_id")
    all_rows = Window.partitionBy("paper_id")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.max("similarity").over(all_rows))), 4)
    return per.withColumn("novelty_score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 5)


def unscored(papers: DataFrame, chunks: DataFrame, scored: DataFrame) -> DataFrame:
    """paper_id, novelty_score (null), reason of each paper (paper_id) without a score: it has no embedded chunks, or nothing to be compared with."""
    embedded = chunks.filter(F.col("embedding").isNotNull()).select("paper_id").distinct().withColumn("has", F.lit(True))
    rows = papers.select("paper_id").distinct().join(scored.select("paper_id").distinct(), "paper_id", "left_anti").join(embedded, "paper_id", "left")
    return rows.select("paper_id", F.lit(None).cast("double").alias("novelty_score"), F.when(F.col("has"), "no other paper to compare with").otherwise("no embedded chunks").alias("reason"))


def near_vectors(vectors: DataFrame, queries: DataFrame, least: float = 0.97, most: int = 10) -> DataFrame:
    """query_id, rank, paper_id, chunk_id, similarity of at least `least` to a query, the best `most`."""
    found = top_k(vectors, queries, most + 1)
    rows = found.filter((F.col("query_id") != F.col("chunk_id")) & (1 - F.col("distance") >= least))
    order = Window.partitionBy("query_id").orderBy("distance", "paper_id", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).withColumn("similarity", F.round(1 - F.col("distance"), 6))
