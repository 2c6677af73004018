"""Exact nearest papers and near vectors with bounds: what a bound rules out is never compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.similarity import CELLS, matrix, unscored
from paperloom.sources.steps import saved

#: Vectors from which the pivots are made, and pivots.
SAMPLE, PIVOTS = 1024, 16
#: Rows of a block at least, and blocks that a table is dealt to at most, as long as a block has no more than HELD numbers.
BLOCK_ROWS, BLOCKS, HELD = 4096, 32, 1 << 24
#: Components from which the bound of single pairs costs less than their product.
WIDE = 8 * PIVOTS
#: Papers whose centres one pass over the chunks meets; they are what is broadcast.
CENTRES = 1 << 15


def _rows(chunks: DataFrame, vector: str) -> DataFrame:
    rows = chunks.filter(F.col(vector).isNotNull()).select(F.col("paper_id").cast("long").alias("paper_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


# -- near vectors among all rows ------------------------------------------------------------------------------------------


def near_pairs(vectors: DataFrame, least: float = 0.97, most: int = 10, vector: str = "embedding") -> DataFrame:
    """paper_id, chunk_id, rank, near_paper, near_chunk, similarity: of every vector its `most` nearest others with a cosine of at least `least`; ties to the smaller (paper_id, chunk_id).

    All vectors are of one length; null ones and those with null or non-finite components take no part, zero vectors are
    near nothing. Two unit vectors cannot have a greater cosine than the product of their parts along some pivots and
    of the lengths of what remains. Rows are dealt to blocks by the pivot that they are nearest to and their angle with
    it; a pair of blocks is met only if their extremes allow `least`. Of its rows, those of WIDE or more components are
    compared in full only where their own bound allows; shorter ones are multiplied as matrices in single precision, and
    what comes near to `least` is compared anew. The pivots are the main directions of SAMPLE vectors: they decide what is
    compared, not what is found. A block meets itself and at most BLOCKS others, so what is shuffled grows with the rows; of
    each row and block at most `most` others leave a task, so a vector with many copies makes no more rows than another.
    Where nothing is ruled out, the products grow with the square of the rows.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors, vector).filter(F.exists("v", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64("paper_id", "chunk_id")).limit(SAMPLE).select("v").collect()
    schema = "paper_id long, chunk_id long, rank int, near_paper long, near_chunk long, similarity double"
    if not sample:
        return spark.createDataFrame([], schema)
    units = np.array([r["v"] for r in sample])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    pivots = spark.sparkContext.broadcast(np.linalg.svd(units, full_matrices=False)[2][:PIVOTS])

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = matrix(batch.column("v"))
            along = x @ pivots.value.T
            home = np.abs(along).argmax(axis=1)
            near = along[np.arange(len(x)), home]
            yield pa.RecordBatch.from_arrays([batch.column("paper_id"), batch.column("chunk_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), pa.array(2 * home + (near < 0)), pa.array(near)], names=["paper_id", "chunk_id", "v", "cell", "angle"])

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in it:
            block = batch.column("part").to_numpy().astype(np.int64) * (1 << 20) + (n + np.arange(batch.num_rows)) // size
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(block)], names=["paper_id", "chunk_id", "v", "block"])

    count = rows.count()
    size = max(BLOCK_ROWS, min(-(-count // BLOCKS), HELD // units.shape[1]))
    parts = max(1, -(-count // size))
    order = ["cell", "angle", "paper_id", "chunk_id"]
    ranged = rows.mapInArrow(placed, "paper_id long, chunk_id long, v array<double>, cell long, angle double").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = saved(ranged.select("paper_id", "chunk_id", "v", F.spark_partition_id().alias("part")).mapInArrow(dealt, "paper_id long, chunk_id long, v array<double>, block long"))

    def extremes(table: pa.Table) -> pa.Table:
        c, rest = _bound_parts(matrix(table.column("v")), pivots.value)
        return pa.table({"block": table.column("block").slice(0, 1), "low": [c.min(axis=0).tolist()], "high": [c.max(axis=0).tolist()], "rest": [float(rest.max())]})

    facts = held.groupBy("block").applyInArrow(extremes, "block long, low array<double>, high array<double>, rest double").orderBy("block").collect()
    low, high, rest = (np.array([r[c] for r in facts]) for c in ("low", "high", "rest"))
    met = []
    for i, own in enumerate(facts):
        greatest = np.maximum.reduce([low[i] * low[i:], low[i] * high[i:], high[i] * low[i:], high[i] * high[i:]]).sum(axis=1) + rest[i] * rest[i:]
        met += [(own["block"], facts[i + int(j)]["block"]) for j in np.flatnonzero(greatest >= least - 1e-9)]
    pairs = spark.createDataFrame(met, "a long, b long")

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        return near_rows(left, right, pivots.value, least, most, left.num_rows and right.num_rows and left.column("a")[0] != right.column("b")[0])

    own = [F.col(c).alias(c) for c in ("a", "b", "paper_id", "chunk_id", "v")]  # columns of their own for each side
    sides = [pairs.join(held.withColumnRenamed("block", c), c).select(own) for c in ("a", "b")]
    found = sides[0].groupBy("a", "b").cogroup(sides[1].groupBy("a", "b")).applyInArrow(compared, "paper_id long, chunk_id long, near_paper long, near_chunk long, similarity double")
    best = Window.partitionBy("paper_id", "chunk_id").orderBy(F.desc("similarity"), "near_paper", "near_chunk")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return ranked.select("paper_id", "chunk_id", "rank", "near_paper", "near_chunk", F.round("similarity", 6).alias("similarity"))


def _bound_parts(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors' parts along the pivots, and the lengths of what remains."""
    c = x @ pivots.T
    return c, np.sqrt(np.maximum(0.0, 1.0 - (c * c).sum(axis=1)))


def allowed(x: np.ndarray, y: np.ndarray, pivots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of x and y that the bound does not rule out."""
    (c, r), (d, s) = _bound_parts(x, pivots), _bound_parts(y, pivots)
    return np.nonzero(c @ d.T + np.outer(r, s) >= least - 1e-9)


def near_rows(left: pa.Table, right: pa.Table, pivots: np.ndarray, least: float, most: int, back: bool = False) -> pa.Table:
    """For each row of left its nearest rows of right, itself left out; back: and for each row of right those of left."""
    x, y = matrix(left.column("v")), matrix(right.column("v"))
    (p, c), (q, d) = ([t.column(n).to_numpy() for n in ("paper_id", "chunk_id")] for t in (left, right))
    wide = x.shape[1] >= WIDE
    short, tall = (None, None) if wide else (x.astype(np.float32), y.astype(np.float32).T)
    edge = np.float32(least - 1e-6 * x.shape[1])  # beyond what single precision can be off
    own, theirs = [], []
    step = max(1, CELLS // max(1, len(y)))
    for at in range(0, len(x) if len(y) else 0, step):
        if wide:
            i, j = allowed(x[at : at + step], y, pivots, least)
        else:
            i, j = np.divmod(np.flatnonzero(short[at : at + step] @ tall >= edge), len(y))
        i = i + at
        sims = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0)])
        ok = (sims >= least) & ((p[i] != q[j]) | (c[i] != d[j]))
        i, j, sims = i[ok], j[ok], np.round(sims[ok], 12)
        own.append(_firsts(i, j, sims, q, d, most))
        if back:
            theirs = [_firsts(*(np.concatenate(z) for z in zip(*theirs, (j, i, sims), strict=True)), p, c, most)]
    out = []
    for got, (a, b), (e, f) in ((own, (p, c), (q, d)), (theirs, (q, d), (p, c))):
        i, j, sims = (np.concatenate([g[k] for g in got] or [np.zeros(0)]) for k in range(3))
        i, j = i.astype(np.int64), j.astype(np.int64)
        out.append(pa.table({"paper_id": a[i], "chunk_id": b[i], "near_paper": e[j], "near_chunk": f[j], "similarity": sims}))
    return pa.concat_tables(out)


def _firsts(i: np.ndarray, j: np.ndarray, sims: np.ndarray, papers: np.ndarray, chunks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows i and j the `most` of each i: the most similar, ties to the smaller ids of j."""
    order = np.lexsort((chunks[j], papers[j], -sims, i))
    i, j, sims = i[order], j[order], sims[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[first], j[first], sims[first]


# -- nearest papers -------------------------------------------------------------------------------------------------------


def _centres(rows: DataFrame) -> DataFrame:
    """paper_id, grp, centre (unit sum of a paper's unit vectors; null if it is zero), radius: the greatest angle between the centre and a vector. Zero vectors are left out."""
    first = rows.select(F.size("v").alias("n")).first()
    n = first["n"] if first else 1
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    units = rows.withColumn("len", F.sqrt(dot("v", "v"))).filter("len > 0").select("paper_id", "grp", F.transform("v", lambda x: x / F.col("len")).alias("u"))
    sums = units.groupBy("paper_id", "grp").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(n)]).alias("s")).withColumn("len", F.sqrt(dot("s", "s")))
    centre = sums.select("paper_id", "grp", F.when(F.col("len") > 1e-9, F.transform("s", lambda x: x / F.col("len"))).alias("centre"))
    angle = F.when(F.col("centre").isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("u", "centre")))))
    radii = units.join(centre.select("paper_id", "centre"), "paper_id").groupBy("paper_id").agg(F.max(angle).alias("radius"))
    return centre.join(radii, "paper_id")


def nearest_papers(chunks: DataFrame, most: int = 5, vector: str = "embedding", same: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """paper_id, other_id, rank, similarity, novelty_score of every paper's (or every target's: paper_id) nearest others, as similarity.novelty gives them.

    same: a column that papers which are no independent work have in common; such papers are not compared (nulls are).
    A paper without vectors, or without another paper, has no rows.

    Each paper has a centre and a radius on the sphere, so the best cosine of a vector with a paper lies between the
    cosines of its angle with the centre plus and less the radius. The means of these bound a pair of papers, and only
    pairs whose upper bound reaches the fifth greatest lower bound of the asking paper are compared in full. The chunks
    are dealt by paper and read in order against CENTRES centres at a time; a task holds two sums for each centre.
    """
    rows = _rows(chunks.withColumn("grp", F.col(same).cast("string") if same else F.lit(None).cast("string")), vector).select("paper_id", "chunk_id", "v")
    groups = chunks.select(F.col("paper_id").cast("long").alias("paper_id"), (F.col(same).cast("string") if same else F.lit(None).cast("string")).alias("grp")).groupBy("paper_id").agg(F.max("grp").alias("grp"))
    rows = saved(rows.join(groups, "paper_id"))
    known = rows.select("paper_id", "grp").distinct().join(_centres(rows).drop("grp"), "paper_id", "left")
    known = saved(known.withColumn("block", F.lit(0)))
    blocks = max(1, -(-known.count() // CENTRES))
    asking = rows if targets is None else rows.join(targets.select("paper_id").distinct(), "paper_id", "left_semi")
    ordered = asking.repartition("paper_id").sortWithinPartitions("paper_id", "chunk_id")
    bounded = None
    for b in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("paper_id"), F.lit(blocks)) == b).orderBy("paper_id").collect()
        found = saved(_bounds(ordered, part, most))
        bounded = found if bounded is None else bounded.unionByName(found)
    reach = Window.partitionBy("paper_id")
    ranked = bounded.withColumn("place", F.row_number().over(reach.orderBy(F.desc("low"), "other_id")))
    edge = F.min(F.when(F.col("place") <= most, F.col("low"))).over(reach)
    pairs = ranked.withColumn("edge", edge).filter((F.col("high") >= F.col("edge") - 1e-4) | (F.col("place") <= most)).select(F.col("paper_id").alias("a"), F.col("other_id").alias("b"))

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        step, best = max(1, CELLS // max(1, len(y))), []
        for at in range(0, len(x), step):
            best.append(np.maximum(0.0, (x[at : at + step] @ y.T).max(axis=1)))
        return pa.table({"paper_id": left.column("a").slice(0, 1), "other_id": left.column("b").slice(0, 1), "similarity": [float(np.concatenate(best).mean())]})

    own = [F.col(c).alias(c) for c in ("a", "b", "v")]  # columns of their own for each side
    sides = [pairs.join(rows.select(F.col("paper_id").alias(c), "v"), c).select(own) for c in ("a", "b")]
    per = sides[0].groupBy("a", "b").cogroup(sides[1].groupBy("a", "b")).applyInArrow(compared, "paper_id long, other_id long, similarity double").withColumn("similarity", F.round("similarity", 4))
    every = Window.partitionBy("paper_id")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.max("similarity").over(every))), 4)
    return per.withColumn("novelty_score", score).withColumn("rank", F.row_number().over(every.orderBy(F.desc("similarity"), "other_id"))).filter(F.col("rank") <= most)


def novelty_report(papers: DataFrame, chunks: DataFrame, same: str | None = None) -> DataFrame:
    """paper_id, novelty_score, highest_similarity, n_compared, reason of every paper of papers (paper_id): without a score both are null and the reason says why."""
    near = nearest_papers(chunks, same=same, targets=papers).groupBy("paper_id").agg(F.max("novelty_score").alias("novelty_score"), F.max("similarity").alias("highest_similarity"), F.count("*").alias("n_compared"))
    near = saved(near)
    rest = unscored(papers, chunks, near)
    scored = near.withColumn("reason", F.lit(None).cast("string"))
    return scored.unionByName(rest.select("paper_id", "novelty_score", F.lit(None).cast("double").alias("highest_similarity"), F.lit(0).cast("long").alias("n_compared"), "reason"))


def bounds(x: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds, at least 0, of the best cosine of each unit vector with each paper. A zero vector has 0; with a paper without a centre (radius nan) they are 0 and 1."""
    cos = np.clip(x @ centres.T, -1.0, 1.0)
    angle = np.arccos(cos)
    reach = np.where(np.isnan(radii), np.pi, radii)
    low, high = np.cos(np.minimum(np.pi, angle + reach)), np.cos(np.maximum(0.0, angle - reach))
    zero = ~x.any(axis=1)
    return np.where(zero[:, None], 0.0, np.maximum(0.0, low)), np.where(zero[:, None], 0.0, np.maximum(0.0, high))


def _bounds(ordered: DataFrame, part: list, most: int) -> DataFrame:
    """paper_id, other_id, low, high: of rows in the order of papers, the papers of this part that can be among the nearest."""
    ids, groups = np.array([r["paper_id"] for r in part], np.int64), np.array([r["grp"] for r in part], object)
    size = next((len(r["centre"]) for r in part if r["centre"]), 1)
    centres = np.array([r["centre"] or [0.0] * size for r in part], float).reshape(len(part), size)
    radii = np.array([np.nan if r["radius"] is None else r["radius"] for r in part], float)
    shared = ordered.sparkSession.sparkContext.broadcast((ids, groups, centres, radii))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, centres, radii = shared.value
        step = max(1, CELLS // max(1, len(ids)))
        now, group, n = None, None, 0
        low, high = np.zeros(len(ids)), np.zeros(len(ids))

        def told() -> pa.RecordBatch:
            other = (ids != now) & (True if group is None else groups != group)
            a, b, at = low[other] / n, high[other] / n, ids[other]
            edge = np.partition(a, -most)[-most] if len(a) > most else -1.0
            keep = b >= edge - 1e-4
            return pa.RecordBatch.from_pydict({"paper_id": np.full(keep.sum(), now), "other_id": at[keep], "low": a[keep], "high": b[keep]})

        for batch in it:
            paper, x = batch.column("paper_id").to_numpy(), matrix(batch.column("v"))
            cuts = np.flatnonzero(np.r_[True, paper[1:] != paper[:-1]]) if len(paper) else []
            for i, j in zip(cuts, [*cuts[1:], len(paper)], strict=True):
                if now != paper[i]:
                    if now is not None:
                        yield told()
                    now, group, n, low, high = int(paper[i]), batch.column("grp")[int(i)].as_py(), 0, np.zeros(len(ids)), np.zeros(len(ids))
                for k in range(i, j, step):
                    some = bounds(x[k : min(j, k + step)], centres, radii)
                    low, high = low + some[0].sum(axis=0), high + some[1].sum(axis=0)
                n += j - i
        if now is not None:
            yield told()

    return ordered.select("paper_id", "grp", "v").mapInArrow(work, "paper_id long, other_id long, low double, high double")
