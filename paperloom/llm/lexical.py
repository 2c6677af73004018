"""Operator 11: ranked lexical search by Fagin's threshold algorithm over an index that is dealt by documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import batches, bounded, saved, span_hashes, word_spans

#: Items that one pass over the documents serves: their terms are what is collected and broadcast.
ITEM_BLOCK = 1024
#: Postings of a shard: so many a task holds at once, with their lists.
SHARD = 1 << 20
#: Places of every list that a round of sorted access takes at first; each next round takes twice as many, up to MOST.
FIRST, MOST = 16, 1024
#: Groups among which an item's candidates are ranked before the last ranking.
SALTS = 64
#: Bytes that are in no term: ASCII but for digits and letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[[b for b in range(128) if not chr(b).isalnum()]] = True


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each term of all texts, A-Z lower-cased, and the index of each text's first (one more at the end)."""
    starts, ends, first = word_spans(data, offsets, BETWEEN)
    return span_hashes(data, starts, ends, lower=True), first


def _counted(it: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, n (terms), terms and tf (the terms of the vocabulary that a document holds, and how often) of every document."""
    for batch in bounded(it, "text"):
        for i, j, data, offsets in batches(batch):
            hashes, first = term_hashes(data, offsets)
            place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[place] == hashes
            owner = np.repeat(np.arange(j - i), np.diff(first))
            cells, tf = np.unique(owner[known] * len(vocabulary) + place[known], return_counts=True)
            ends = np.searchsorted(cells, np.arange(j - i + 1) * len(vocabulary)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cells % len(vocabulary), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), *lists], names=["id", "n", "terms", "tf"])


@dataclass
class Best:
    """The k best documents so far, by score and then id, null ids last."""

    k: int
    scores: np.ndarray
    ids: np.ndarray
    nulls: np.ndarray

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        keep = scores > 0 if len(self.scores) < self.k else scores >= max(1, self.scores[-1])
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores[keep]), (self.ids, ids[keep]), (self.nulls, nulls[keep])))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]

    def floor(self) -> int:
        """The kth score; below all scores while there are fewer than k."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


class Shard:
    """Some documents' postings twice: as the documents' rows (forward index), and as each term's list, the highest impacts first."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        self.ids, self.nulls, self.ends, self.terms, self.impacts = ids, nulls, ends, terms, impacts
        self.list_documents = np.repeat(np.arange(len(ids)), np.diff(ends))
        order = np.argsort(terms.astype(np.int64) * (1 << 20) + ((1 << 20) - 1 - impacts), kind="stable")  # an impact is below 10**6
        self.list_documents, self.list_impacts = self.list_documents[order], impacts[order]
        self.list_ends = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.seen = np.zeros(len(ids), bool)

    def scores(self, documents: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Random access: the documents' scores under weights by term, from their rows of the forward index."""
        size = np.diff(self.ends)[documents]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(upto[-1]) + np.repeat(self.ends[documents] - upto[:-1], size)
        sums = np.concatenate([[0], np.cumsum(weights[self.terms[at]] * self.impacts[at])])
        return sums[upto[1:]] - sums[upto[:-1]]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Improve an item's best; gives how many documents were looked up. terms: the item's, weights: by term, 0 for others.

        Round-robin over the lists, a stretch of places each; what is new is looked up. No document yet unseen can score
        more than the lists' impacts at the last places (the threshold), so the search ends once that is below the kth score.
        """
        at, ends = self.list_ends[terms], self.list_ends[terms + 1]
        step, looked = FIRST, []
        while (at < ends).any():
            upto = np.minimum(at + step, ends)
            size = upto - at
            places = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
            new = np.unique(self.list_documents[places])
            new = new[~self.seen[new]]
            self.seen[new] = True
            looked.append(new)
            best.add(self.scores(new, weights), self.ids[new], self.nulls[new])
            threshold = int((weights[terms] * np.where(upto < ends, self.list_impacts[np.maximum(upto - 1, 0)], 0)).sum())
            if threshold < best.floor() or threshold == 0:
                break
            at, step = upto, min(2 * step, MOST)
        looked = np.concatenate([np.zeros(0, np.int64), *looked])
        self.seen[looked] = False
        return len(looked)


def search(documents: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", item_column: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents (text) with a score above 0.

    Terms are runs of characters other than ASCII punctuation, blanks and controls, A-Z lower-cased. N documents hold a
    term; L is how many terms they hold. A term in df documents weighs floor(1000 ln((2N+2)/(2df+1))); tf occurrences in a
    document of n terms have the impact 10**9 tf div (1000 tf + 12 m), m = 75 + 25 n N div L; a document's score is the sum
    of weight times impact over the item's terms, repeats included. Equal scores are ranked by id, null ids last.

    Null and empty texts have no terms; an item without known terms has no rows. Every row of items is an item of its own
    and every row of documents a document, repeated ids or not. Empty tables give no rows. Other columns are not read. A
    text is one piece of work, however long.

    Items are taken in blocks of about ITEM_BLOCK, whose terms alone are collected. One pass over the documents writes the
    forward index of these terms, from which df, N and L are summed; then each task holds shards of it, as impact-sorted
    lists and as rows, and runs the threshold algorithm for every item, going on with the kth scores of its earlier shards.
    A term in all documents is a list in every shard and no group of a shuffle. Each task sends on k rows for each item at most.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    n = items.count()
    blocks = max(1, -(-n // ITEM_BLOCK))
    asked = items.select(F.col(item_column).alias("item"), F.col("text").cast("string").alias("text"))
    found = []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        found.append(_block(texts, own, k))
    found = [x for x in found if x is not None]
    if not found:
        return spark.createDataFrame([], f"{item_column} long, rank int, {id_column} long, score long")
    if len(found) > 1:
        found = [saved(x) for x in found]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")


def _block(texts: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    spark = texts.sparkSession
    item_type = items.schema["item"].dataType

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, offsets in batches(batch):
                hashes, first = term_hashes(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(i, j - i), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.astype(np.int64)))], names=["item", "terms"])

    asked = [(r["item"], np.unique(np.array(r["terms"], np.int64).astype(np.uint64), return_counts=True)) for r in items.mapInArrow(split, T.StructType([*items.select("item").schema, T.StructField("terms", T.ArrayType(T.LongType()))])).collect()]
    asked = [x for x in asked if len(x[1][0])]
    if not asked:
        return None
    vocabulary = np.unique(np.concatenate([x[1][0] for x in asked]))
    shared = spark.sparkContext.broadcast(vocabulary)
    index = saved(texts.mapInArrow(lambda it: _counted(it, shared.value), "id long, n long, terms array<int>, tf array<int>"))
    held = index.filter(F.col("n") > 0).agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    if not held["n"]:
        return None
    total, length = held["n"], held["terms"]
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    state = spark.sparkContext.broadcast((weight, [(t := np.searchsorted(vocabulary, terms), weight[t] * times) for _, (terms, times) in asked]))

    def searched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = state.value
        best = [Best(k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in wanted]
        weights = np.zeros(len(weight), np.int64)
        for shard in _shards(it, total, length, len(weight)):
            for own, (terms, times) in zip(best, wanted, strict=True):
                weights[terms] = times
                shard.search(terms, weights, own)
                weights[terms] = 0
        sizes = [len(x.scores) for x in best]
        if sum(sizes):
            ids = pa.array(np.concatenate([x.ids for x in best]), mask=np.concatenate([x.nulls for x in best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), sizes).astype(np.int32)), ids, pa.array(np.concatenate([x.scores for x in best]))], names=["q", "id", "score"])

    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    few = index.filter(F.size("terms") > 0).mapInArrow(searched, "q int, id long, score long").withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)
    named = spark.createDataFrame([(q, x[0]) for q, x in enumerate(asked)], T.StructType([T.StructField("q", T.IntegerType()), *items.select("item").schema]))
    return ranked.join(F.broadcast(named), "q").select(F.col("item").cast(item_type).alias("item"), "rank", "id", "score")


def _shards(it: Iterator[pa.RecordBatch], total: int, length: int, n_terms: int) -> Iterator[Shard]:
    held, size = [], 0
    for batch in it:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= SHARD:
            yield _shard(held, total, length, n_terms)
            held, size = [], 0
    if held:
        yield _shard(held, total, length, n_terms)


def _shard(held: list[pa.RecordBatch], total: int, length: int, n_terms: int) -> Shard:
    rows = pa.Table.from_batches(held).combine_chunks()
    terms, tf, ids = (rows.column(c).combine_chunks() for c in ("terms", "tf", "id"))
    sizes = np.diff(terms.offsets.to_numpy())
    m = 75 + 25 * rows.column("n").to_numpy() * total // length
    times = tf.flatten().to_numpy().astype(np.int64)
    impacts = 1_000_000_000 * times // (1000 * times + 12 * np.repeat(m, sizes))
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    return Shard(ids.fill_null(0).to_numpy(), nulls, np.concatenate([[0], np.cumsum(sizes)]), terms.flatten().to_numpy(), impacts, n_terms)
