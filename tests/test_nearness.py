"""Bounded nearness against brute force, and how much the bounds leave to compare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import nearness, similarity
from paperloom.sources import steps

SCHEMA = "paper_id long, chunk_id long, embedding array<double>"


def clustered(papers, chunks, dims=24, spread=0.15, seed=4):
    """Rows of papers that each keep to a part of the sphere, some of which are close to each other."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(papers, dims))
    centres[1::3] = centres[::3][: len(centres[1::3])] + 0.3 * r.normal(size=centres[1::3].shape)
    return [(p, p * 1000 + c, (centres[p] + spread * r.normal(size=dims)).tolist()) for p in range(papers) for c in range(chunks)]


def brute_pairs(values, least, most):
    ids = [(p, c) for p, c, _ in values]
    x = np.array([v for *_, v in values], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i, row in enumerate(np.round(x @ x.T, 12)):
        near = sorted((-s, ids[j]) for j, s in enumerate(row) if j != i and s >= least)[:most]
        out |= {(*ids[i], k + 1, *other, round(-s, 6)) for k, (s, other) in enumerate(near)}
    return out


@pytest.mark.parametrize("least", [0.97, 0.8])
def test_near_pairs_are_those_of_all_pairs(rows, monkeypatch, least):
    monkeypatch.setattr(nearness, "BLOCK_ROWS", 40)
    values = clustered(20, 12)
    values += [(50 + i, i, values[0][2]) for i in range(30)]  # a vector with many copies
    got = nearness.near_pairs(rows(SCHEMA, *values, (99, 1, None), (99, 2, [0.0] * 24), (99, 3, [float("nan")] * 24)), least, most=4).collect()
    assert {tuple(r) for r in got} == brute_pairs(values, least, 4)


def test_near_pairs_of_nothing(rows):
    assert nearness.near_pairs(rows(SCHEMA)).count() == 0
    assert nearness.near_pairs(rows(SCHEMA, (1, 1, [1.0, 0.0]))).count() == 0


def test_the_bound_leaves_few_pairs_to_compare():
    """Vectors without any structure, the worst case: along 16 pivots of 64 dimensions fewer than one pair in a hundred is met."""
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = np.linalg.svd(x[:1024], full_matrices=False)[2][: nearness.PIVOTS]
    i, j = nearness.allowed(x, x, pivots, 0.97)
    met = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(met) < 0.01 * len(x) ** 2 and {(k, k) for k in range(len(x))} <= met


def all_pairs(df, same=None):
    return {tuple(r) for r in similarity.novelty(similarity.best_matches(df), same).select("paper_id", "other_id", "rank", "similarity", "novelty_score").collect()}


def test_nearest_papers_are_those_of_all_pairs(rows):
    df = rows(SCHEMA, *clustered(24, 9), (40, 1, [0.0] * 24), (41, 1, [1.0] + [0.0] * 23), (41, 2, [-1.0] + [0.0] * 23), (42, 1, None)).cache()
    columns = ["paper_id", "other_id", "rank", "similarity", "novelty_score"]
    got = {tuple(r) for r in nearness.nearest_papers(df).select(*columns).collect()}
    assert got == all_pairs(df) and max(r[2] for r in got) == 5
    asked = {tuple(r) for r in nearness.nearest_papers(df, targets=rows("paper_id long", (3,), (77,))).select(*columns).collect()}
    assert asked == {r for r in got if r[0] == 3}
    ids = df.select("paper_id").distinct()
    pairs = ids.join(ids.select(F.col("paper_id").alias("other_id")), (F.col("paper_id") % 4 == F.col("other_id") % 4) & (F.col("paper_id") != F.col("other_id")))
    kept = {tuple(r) for r in nearness.nearest_papers(df.withColumn("same", F.col("paper_id") % 4), same="same").select(*columns).collect()}
    assert kept == all_pairs(df, pairs)
    assert nearness.nearest_papers(rows(SCHEMA)).count() == 0


def test_bounds_hold_and_prune():
    values = clustered(60, 9)
    x = np.array([v for *_, v in values], float).reshape(60, 9, -1)
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    centres = x.sum(axis=1)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    radii = np.arccos(np.clip(np.einsum("pcd,pd->pc", x, centres), -1, 1)).max(axis=1)
    low, high = nearness.bounds(x.reshape(540, -1), centres, radii)
    best = np.maximum(0, np.einsum("ad,pcd->apc", x.reshape(540, -1), x).max(axis=2))
    assert (low <= best + 1e-9).all() and (best <= high + 1e-9).all()
    low, high = (b.reshape(60, 9, 60).mean(axis=1) for b in (low, high))
    for b in (low, high):
        np.fill_diagonal(b, 0)
    met = (high >= np.sort(low, axis=1)[:, -1:]).sum()  # with one nearest paper asked for
    assert met < 0.5 * 60 * 59


def test_short_vectors_are_multiplied_and_blocks_are_few(rows, monkeypatch):
    """Blocks grow with the table, so a row meets at most BLOCKS of them; what is near is found in both directions."""
    monkeypatch.setattr(nearness, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nearness, "BLOCKS", 3)
    monkeypatch.setattr(nearness, "CELLS", 64)
    kept = []
    monkeypatch.setattr(nearness, "saved", lambda df: kept.append(steps.saved(df)) or kept[-1])
    values = clustered(20, 12) + [(50 + i, i, clustered(1, 1)[0][2]) for i in range(30)]
    got = nearness.near_pairs(rows(SCHEMA, *values), 0.4, most=4).collect()
    assert {tuple(r) for r in got} == brute_pairs(values, 0.4, 4)
    assert kept[0].select("block").distinct().count() <= 6  # ranges need not be even
    monkeypatch.setattr(nearness, "WIDE", 8)
    assert {tuple(r) for r in nearness.near_pairs(rows(SCHEMA, *values), 0.4, most=4).collect()} == brute_pairs(values, 0.4, 4)
