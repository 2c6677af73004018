"""Operator 2: toxicity by subword bags: hashed character n-gram embeddings, averaged, into a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import mix, saved, small_batches, steps, text_bytes

#: Character n-grams of these sizes, word borders included, go to so many buckets.
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 16
DIMENSIONS = 8
#: Words of a window; a text is as toxic as its most toxic window, so that a long text does not thin out one insult.
WINDOW = 4
#: At most so many labelled texts of each class are learnt from, taken in the order of a hash of their ids.
SAMPLE_PER_CLASS = 1000

#: Bytes to symbols: ASCII letters in lower case; white space and marks that end a word are the border, 0.
SYMBOL = np.arange(256, dtype=np.uint64)
SYMBOL[65:91] = SYMBOL[97:123]
SYMBOL[[*range(33), *b".,;:?\"()[]{}|<>/\\`~^=+_#", 127]] = 0


def _grams(symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-grams at each place of a bordered text: their buckets, and which lie within one word and its two borders."""
    size = len(symbols) - n + 1
    h = np.full(size, n, np.uint64)
    inner = np.zeros(size, bool)
    for j in range(n):
        part = symbols[j : j + size]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1)
        if 0 < j < n - 1:
            inner |= part == 0
    whole = ~inner & (symbols[1 : 1 + size] != 0)
    return (mix(h) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), whole


def _bordered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with a border before each and after the last, and where each text begins among them."""
    at = offsets[:-1] + np.arange(len(offsets) - 1)
    symbols = np.zeros(len(data) + len(offsets), np.uint64)
    place = np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 1
    symbols[place] = SYMBOL[data]
    return symbols, np.append(at, len(symbols) - 1)


def _words(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start, and the index of each text's first word."""
    starts = np.flatnonzero((symbols[1:] != 0) & (symbols[:-1] == 0)) + 1
    return starts, np.searchsorted(starts, begins)


@dataclass
class Toxicity:
    """A trained model. As the softmax of two classes is linear in averages, each bucket comes down to one number."""

    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text, 0 to 1. A text without words has the score of an empty bag."""
        symbols, begins = _bordered(data, offsets)
        starts, first = _words(symbols, begins)
        sums, counts = np.zeros(len(symbols) + 1), np.zeros(len(symbols) + 1)
        for n in GRAMS:
            if len(symbols) >= n:
                bucket, whole = _grams(symbols, n)
                sums[1 : 1 + len(bucket)] += np.where(whole, self.weight[bucket], 0.0)
                counts[1 : 1 + len(bucket)] += whole
        sums, counts = np.cumsum(sums), np.cumsum(counts)
        # n-grams of a word begin at its border or within it: from one before its start to one before the next word's start
        edge = np.append(starts - 1, len(symbols) - 1)
        word = (sums[edge[1:]] - sums[edge[:-1]]) / np.maximum(counts[edge[1:]] - counts[edge[:-1]], 1)
        logit = np.full(len(offsets) - 1, self.bias)
        has = np.diff(first) > 0
        best, owners = window_means(word, first)
        if len(best):
            logit[has] = np.maximum.reduceat(best, np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def window_means(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean over the WINDOW words from each word on (fewer at a text's end), and the text of each. One value a word."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    sums = np.concatenate([[0.0], np.cumsum(word)])
    begin = np.arange(len(word))
    end = np.minimum(begin + WINDOW, first[1:][owner]) if len(word) else begin
    return (sums[end] - sums[begin]) / WINDOW, owner


def train(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), rounds: int = 60, seed: int = 7) -> Toxicity:
    """Embeddings and softmax learnt jointly by Adagrad over whole passes.

    Each round scores all windows, and follows the gradient of the log loss at each text's highest window.
    weights: of labels 0 and 1, which bring a sample back to the classes' true shares.
    """
    rng = np.random.default_rng(seed)
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    # distinct words: the buckets of each, as one list with offsets
    index: dict[bytes, int] = {}
    bags: list[np.ndarray] = []
    word_ids, counts = [], []
    for i, j in steps(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        symbols, begins = _bordered(part, own)
        starts, first = _words(symbols, begins)
        plain = symbols.astype(np.uint8).tobytes()
        ends = starts + np.array([plain.find(b"\0", s) - s for s in starts], np.int64) if len(starts) else starts
        for s, e in zip(starts, ends, strict=True):
            w = plain[s:e]
            if w not in index:
                index[w] = len(bags)
                own_symbols = np.concatenate([[0], np.frombuffer(w, np.uint8), [0]]).astype(np.uint64)
                found = [b[k] for n in GRAMS if len(own_symbols) >= n for b, k in [_grams(own_symbols, n)]]
                bags.append(np.concatenate(found) if found else np.zeros(0, np.int64))
            word_ids.append(index[w])
        counts.append(np.diff(first))
    y = np.array(labels, float)
    word_ids = np.array(word_ids, np.int64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    has = np.diff(first) > 0
    if not has.any() or not bags:
        share = (y.mean() if len(y) else 0.0) * 0.98 + 0.01
        return Toxicity(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    sizes = np.array([len(b) for b in bags])
    bag_of = np.repeat(np.arange(len(bags)), sizes)
    buckets = np.concatenate(bags)
    per = 1 / np.maximum(sizes, 1)

    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out = rng.normal(0, 0.1, DIMENSIONS)
    bias, g_table, g_out, g_bias = -2.0, np.full(BUCKETS, 1e-8), np.full(DIMENSIONS, 1e-8), 1e-8
    importance = np.where(y == 1, weights[1], weights[0])[has]
    importance = importance / importance.sum()
    target = y[has]
    heads = first[:-1][has]
    for _ in range(rounds):
        score = np.bincount(bag_of, (table @ out)[buckets], len(bags)) * per
        best, owners = window_means(score[word_ids], first)
        top = np.maximum.reduceat(best, heads)
        place = np.flatnonzero(best == np.repeat(top, np.diff(first)[has]))
        place = place[np.r_[True, owners[place][1:] != owners[place][:-1]]]
        error = importance * (1 / (1 + np.exp(-(top + bias))) - target)
        # the words of each text's highest window
        end = np.minimum(place + WINDOW, first[1:][has])
        span = end - place
        at = np.repeat(place, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        pull = np.bincount(word_ids[at], np.repeat(error / WINDOW, span), len(bags)) * per
        used = np.bincount(buckets, pull[bag_of], BUCKETS)
        d_out = used @ table
        d_table = used[:, None] * out[None, :]
        d_bias = error.sum()
        g_table += (d_table**2).sum(axis=1)
        g_out += d_out**2
        g_bias += d_bias**2
        table -= 0.5 * d_table / np.sqrt(g_table)[:, None]
        out -= 0.3 * d_out / np.sqrt(g_out)
        bias -= 0.1 * d_bias / np.sqrt(g_bias)
    return Toxicity(table @ out, float(bias))


def fit(documents: DataFrame, labels: DataFrame, keep=None, per_class: int = SAMPLE_PER_CLASS) -> Toxicity:
    """Train on at most per_class texts of each label. keep: a condition on doc_id that labels must meet to be learnt from.

    labels: doc_id, toxic. Of repeated labels of an id the greatest counts; rows with a null id or label are left out.
    Of several texts of an id the least is learnt from, so that what is collected is at most 2 * per_class texts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if keep is not None:
        known = known.filter(keep)
    known = saved(known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_class).select("doc_id", "toxic")
    one = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("toxic", "doc_id").agg(F.min("text").alias("text"))
    found = sorted(one.collect(), key=lambda r: (r["toxic"], r["doc_id"]))
    texts, marks = [r["text"] or "" for r in found], [r["toxic"] for r in found]
    got = [max(1, marks.count(m)) for m in (0, 1)]
    return train(texts, marks, (shares.get(0, 0) / got[0], shares.get(1, 0) / got[1]))


def toxicity_scores(documents: DataFrame, model: Toxicity, passing: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns passing and score (0 to 1, of the whole text) of every row.

    A null text is an empty one; an empty text has the score of an empty bag of words. Ids may be null or repeated:
    each row is scored by its text alone. Other columns are not read; an empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.select(*passing).schema

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in it:
            data, offsets = text_bytes(batch.column("__text"))
            found = [model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)]
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate([np.zeros(0), *found]))], names=[*passing, "score"])

    return documents.select(*passing, F.col("text").alias("__text")).mapInArrow(score, schema.add("score", "double"))
