"""Operator 8: exact inner-product top-k for many queries, by histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import saved

#: Queries that one pass over the candidates serves; their vectors are what is broadcast.
QUERY_BLOCK = 2048
#: Bins of a histogram; each round narrows a query's score range by this factor.
BINS = 256
#: Score cells held at once by a task.
CELLS = 1 << 21


def integer_vectors(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """id and floor(scale * x) of each component; rows with a null id, a null vector, or a null or non-finite component are left out."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_column).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def _matrix(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By dimension: the dimension, the rows of it, and their vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, values[offsets[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0), np.int64)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles are exact while sums stay below 2^53, else 64-bit integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _scored(batch: pa.RecordBatch, queries: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch: the queries' places in the block, candidate ids, scores (queries by candidates), and which cells are a query's own row."""
    ids = batch.column("id").to_numpy()
    for d, rows, vectors in _matrix(batch.column("v")):
        if d not in queries:
            continue
        at, (own, wanted) = queries[d][0], queries[d][1]
        step = max(1, CELLS // len(at))
        for i in range(0, len(rows), step):
            part = ids[rows[i : i + step]]
            yield at, part, _products(wanted, vectors[i : i + step]), own[:, None] == part[None, :]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score of each query's k best rows of vectors by integer inner product, ties to the smaller id.

    Components are taken as floor(scale * x). A query's own row (its id) is no candidate. Rows whose id or vector is
    null, or that hold a null or non-finite component, take no part on either side. Only vectors of a query's own
    dimension are its candidates. Repeated candidate rows are each a candidate; queries are taken by distinct id (of
    repeated ids the smallest vector). With fewer than k candidates all are returned; without queries or candidates
    the result is empty. Further columns are not read. Scores must fit a long.

    The queries are taken in blocks of QUERY_BLOCK. For a block: a first pass finds each query's least and greatest
    score; each next pass counts scores in BINS equal bins of the query's range, summed over all tasks, and keeps the
    bin that holds the kth best, until it is one score wide. A last pass keeps what reaches the kth score; of ties at
    it each task keeps its k smallest ids, which is all that a final rank by (score, id) can need.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale, id_column, vector_column)
    wanted = integer_vectors(queries, scale, id_column, vector_column).groupBy("id").agg(F.min("v").alias("v"))
    n = wanted.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    # several blocks: the queries are worked out once, and what each block finds is written, so that no plan grows with them
    keep = saved if blocks > 1 else lambda df: df
    wanted = keep(wanted)
    out = None
    bucket = F.pmod(F.xxhash64("id"), F.lit(blocks))
    for b in range(blocks):
        block = wanted.filter(bucket == b).orderBy("id").collect()
        found = _block(rows, [(r["id"], r["v"]) for r in block], k) if block else None
        if found is not None:
            out = keep(found) if out is None else out.unionByName(keep(found))
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score")


def _block(rows: DataFrame, block: list[tuple[int, list[int]]], k: int) -> DataFrame | None:
    spark = rows.sparkSession
    sizes = np.array([len(v) for _, v in block])
    ids = np.array([i for i, _ in block], np.int64)
    by_size = {int(d): (np.flatnonzero(sizes == d), (ids[sizes == d], np.array([v for _, v in block if len(v) == d], np.int64).reshape(-1, int(d)))) for d in np.unique(sizes)}
    shared = spark.sparkContext.broadcast(by_size)
    count = len(block)

    def extremes(it):
        low, high, n = np.full(count, np.iinfo(np.int64).max), np.full(count, np.iinfo(np.int64).min), np.zeros(count, np.int64)
        for batch in it:
            for at, _, scores, own in _scored(batch, shared.value):
                np.minimum.at(low, at, np.where(own, np.iinfo(np.int64).max, scores).min(axis=1))
                np.maximum.at(high, at, np.where(own, np.iinfo(np.int64).min, scores).max(axis=1))
                n[at] += (~own).sum(axis=1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"q": some.astype(np.int32), "low": low[some], "high": high[some], "n": n[some]})

    found = rows.mapInArrow(extremes, "q int, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    if not found:
        return None
    low, width, need = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for r in found:
        low[r["q"]], width[r["q"]] = r["low"], r["high"] - r["low"] + 1
        need[r["q"]] = min(k, r["n"])

    while (open_ := (width > 1) & (need > 0)).any():
        step = -(-width // BINS)
        state = spark.sparkContext.broadcast((low, width, np.maximum(step, 1), open_))

        def histogram(it):
            low, width, step, open_ = state.value
            bins = np.zeros((count, BINS), np.int64)
            for batch in it:
                for at, _, scores, own in _scored(batch, shared.value):
                    place = scores - low[at][:, None]
                    inside = (place >= 0) & (place < width[at][:, None]) & ~own & open_[at][:, None]
                    q, c = np.nonzero(inside)
                    cell = at[q] * BINS + place[q, c] // step[at[q]]
                    bins.ravel()[:] += np.bincount(cell, minlength=bins.size)
            q, c = np.nonzero(bins)
            yield pa.RecordBatch.from_pydict({"q": q.astype(np.int32), "bin": c.astype(np.int32), "n": bins[q, c]})

        counts = np.zeros((count, BINS), np.int64)
        for r in rows.mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).collect():
            counts[r["q"], r["bin"]] = r["n"]
        for q in np.flatnonzero(open_):
            above = np.cumsum(counts[q][::-1])
            back = int(np.searchsorted(above, need[q]))
            need[q] -= above[back - 1] if back else 0
            at = BINS - 1 - back
            end = min(low[q] + width[q], low[q] + (at + 1) * step[q])
            low[q] += at * step[q]
            width[q] = end - low[q]
        state.unpersist()

    least = spark.sparkContext.broadcast(np.where(need > 0, low, np.iinfo(np.int64).max))

    def reaching(it):
        edge = least.value
        ties: list[list[int]] = [[] for _ in range(count)]
        for batch in it:
            for at, part, scores, own in _scored(batch, shared.value):
                q, c = np.nonzero((scores >= edge[at][:, None]) & ~own)
                s, tie = scores[q, c], scores[q, c] == edge[at[q]]
                for x, i in zip(at[q[tie]], part[c[tie]], strict=True):
                    ties[x].append(int(i))
                    if len(ties[x]) >= 4 * k:
                        ties[x] = sorted(ties[x])[:k]
                yield pa.RecordBatch.from_pydict({"query_id": ids[at[q[~tie]]], "id": part[c[~tie]], "score": s[~tie]})
        kept = [(ids[x], i, edge[x]) for x, some in enumerate(ties) for i in sorted(some)[:k]]
        yield pa.RecordBatch.from_pydict({"query_id": pa.array([x[0] for x in kept], pa.int64()), "id": pa.array([x[1] for x in kept], pa.int64()), "score": pa.array([x[2] for x in kept], pa.int64())})

    return rows.mapInArrow(reaching, "query_id long, id long, score long")
