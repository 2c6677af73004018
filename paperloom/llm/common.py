"""What several operators share: tables, written steps, and words and hashes of whole batches of texts in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.steps import saved, spread

__all__ = ["saved"]

#: Bytes of text that one numpy step works on, and texts; a longer text is a step of its own.
STEP_BYTES, STEP_TEXTS = 1 << 20, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0]) if name in ("documents", "pages") else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold the Arrow batches of text columns to so many rows, so that a Python worker's memory stays bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def bounded(it: Iterator[pa.RecordBatch], name: str, most: int = STEP_BYTES << 3) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many bytes of the named text column, or of one longer text, so that what is made of them stays bounded too."""
    for batch in it:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        for i, j in steps(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), most):
            yield batch.slice(i, j - i)


#: Characters of text that a block of dealt_by_id is to hold.
BLOCK_CHARS = 4 << 20


#: Borders of blocks that are collected and compared with ids; beyond so many, ranges between two borders are cut evenly.
BORDERS = 1024


def dealt_by_id(rows: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """The rows with a column block, dealt by it, and the number of blocks: ranges of ids of about BLOCK_CHARS characters, rising.

    Rows without an id are in the last block. The borders are at most BORDERS quantiles of the ids, which are collected;
    where more blocks are needed, each range between two borders is cut into equal parts.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = rows.agg(F.sum(F.length(text_column))).first()[0] or 0
    blocks = max(parts, -(-chars // BLOCK_CHARS))
    coarse = min(blocks, BORDERS)
    facts = rows.agg(F.percentile_approx(id_column, [i / coarse for i in range(1, max(coarse, 2))], 20 * coarse).alias("at"), F.min(id_column).alias("low"), F.max(id_column).alias("high")).first()
    borders = sorted(set(facts["at"] or [])) if coarse > 1 else []
    fine = -(-blocks // coarse)
    block = count_below(F.col(id_column), borders)
    if fine > 1 and facts["low"] is not None:
        edges = [facts["low"] - 1, *borders, max(facts["high"], *borders)]
        of = lambda values: F.element_at(F.array(*[F.lit(v).cast("double") for v in values]), block + 1)
        low, high = of(edges[:-1]), of(edges[1:])
        share = (F.col(id_column) - low) / F.greatest(high - low, F.lit(1.0))
        block = block * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.ceil(share * fine) - 1))
    count = (len(borders) + 1) * fine
    return rows.withColumn("block", F.when(F.col(id_column).isNull(), count - 1).otherwise(block).cast("long")).repartition(partitions_of(spark, count), "block"), count


#: Partitions that blocks are dealt to at most, unless the session asks for more.
PARTITIONS = 1 << 14


def partitions_of(spark: SparkSession, blocks: int) -> int:
    """A partition for each block, so that a task's share does not grow with the table, as far as PARTITIONS go."""
    return min(blocks, max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def count_below(value: Column, borders: list[int]) -> Column:
    """How many of the rising borders are below the value: found among every 64th, then among 64."""
    if not borders:
        return F.lit(0)
    coarse = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in borders[63::64]] or [F.lit(2**63 - 1).cast("long")]), lambda b: b < value))
    return coarse * 64 + F.size(F.filter(F.slice(F.array(*[F.lit(b).cast("long") for b in borders]), coarse * 64 + 1, F.lit(64)), lambda b: b < value))


# -- texts as bytes ---------------------------------------------------------------------------------------------------

#: ASCII white space: what separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_P = 0x9E3779B97F4A7C15 | 5
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, min(int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1, i + STEP_TEXTS))
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, STEP_BYTES + 1)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, p, np.uint64))]) for p in (_P, _P_INVERSE)]
    return _POWERS[0], _POWERS[1]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word. offsets begin at 0 and end at len(data); between tells the bytes that separate words."""
    inside = ~between[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edges[1:-1]
    ends[:-1] &= ~inside[1:] | edges[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, from differences of one running sum."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_LOWER if lower else BYTE)[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the index of each text's first word (one more at the end)."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends, lower), first


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every window of so many consecutive words, by doubling; windows over text borders are there too."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    got, have, block, size, factor = None, 0, words, 1, 0xD6E8FEB86659FD93
    while True:
        if width & size:
            got, have = (block, size) if got is None else (got[: len(block) - have] * np.uint64(factor) + block[have:], have + size)
        if have == width:
            return mix(got)
        block = block[: len(block) - size] * np.uint64(factor) + block[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text and the index of each text's first; a text of fewer words is one shingle, one without words none."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    rolled = windows(words, width)
    inside = owner[: len(rolled)] == owner[width - 1 :][: len(rolled)]
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    full = np.ones(len(out), bool)
    full[starts[short]] = False
    out[full] = rolled[inside]
    for i in short:
        out[starts[i]] = windows(words[first[i] : first[i + 1]], int(counts[i]))[0] ^ np.uint64(counts[i])
    return out, starts


def batches(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Steps over a batch's texts: first row, row after the last, their bytes, their offsets from 0."""
    data, offsets = text_bytes(batch.column(name))
    for i, j in steps(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
