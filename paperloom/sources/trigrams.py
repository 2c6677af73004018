"""Substring search over stored chunks by a written index of trigrams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from paperloom.functions import text as T
from paperloom.sources import readers, tables
from paperloom.sources.steps import saved

#: Trigrams of a pattern that are looked up at most; the others could only rule out more.
LOOKED_UP = 8
#: Characters of texts that a task has as numbers at once; a longer text is taken alone.
CHARS = 1 << 21


def grams(c: Column) -> Column:
    """The distinct trigrams of a text in lower case; none of a shorter one. The text is split into characters once."""
    of = lambda x: F.when(F.size(x) >= 3, F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2))))
    every = F.flatten(F.transform(F.array(F.split(F.lower(F.coalesce(c, F.lit(""))), "")), of))
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def index_path(chunks_path: str) -> str:
    """Where the index of a chunk table is stored, beside it."""
    return f"{chunks_path.rstrip('/')}-grams"


def _met_in(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct trigrams of texts, where the places of each begin and end, and the places of the texts that have it, one after the other."""
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    within = owner[:-2] == owner[2:]
    codes = (chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[within]
    known = pa.array(codes).dictionary_encode()
    bits = len(texts).bit_length()
    keys = np.sort(known.indices.to_numpy().astype(np.int64) << bits | owner[:-2][within])
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    ends = np.searchsorted(keys, np.arange(len(known.dictionary) + 1) << bits)
    each = known.dictionary.to_numpy()[:, None] >> np.array([42, 21, 0]) & (1 << 21) - 1
    every = each.astype("<u4").tobytes().decode("utf-32-le")
    return [every[i : i + 3] for i in range(0, len(every), 3)], ends, keys & (1 << bits) - 1


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, paper_ids, chunk_ids of each distinct trigram of so many rows (paper_id, chunk_id, text) as have CHARS characters."""
    for batch in batches:
        upto = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHARS, "right")))
            part = batch.slice(at, to - at)
            grams, ends, places = _met_in(part.column("text"))
            ids = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), part.column(c).take(pa.array(places))) for c in ("paper_id", "chunk_id")]
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *ids], names=["gram", "paper_ids", "chunk_ids"])
            at = to


def append_index(chunks: DataFrame, chunks_path: str, batch: str | None = None) -> None:
    """Index chunks (paper_id, chunk_id, text) as one batch: rows of a trigram and the chunks that have it, dealt to folders by trigram and in order of it within files, so that a search reads its own.

    The chunks of a trigram are gathered where their texts are read, so that a row is shuffled for each trigram of a stretch of texts and not for each one of a text.
    """
    rows = chunks.filter(F.col("paper_id").isNotNull() & F.col("chunk_id").isNotNull()).select("paper_id", "chunk_id", F.lower("text").alias("text")).filter(F.length("text") >= 3)
    kinds = [StructField(f"{c}s", ArrayType(rows.schema[c].dataType)) for c in ("paper_id", "chunk_id")]
    tables.append(rows.mapInArrow(_indexed, StructType([StructField("gram", StringType()), *kinds])), index_path(chunks_path), "gram", batch, order="gram")


def wanted(spark: SparkSession, pattern: str) -> list[str]:
    """Trigrams that a text must have to be like %pattern%: of the stretches between wild characters. None if there is no such stretch, or an escape."""
    if "\\" in pattern:
        return []
    stretches = [s for s in pattern.replace("_", "%").split("%") if s]
    found = spark.range(1).select(F.flatten(F.array(*[grams(F.lit(s)) for s in stretches] or [F.array().cast("array<string>")])).alias("g")).first()["g"]
    found = sorted(set(found))
    return found[:: max(1, -(-len(found) // LOOKED_UP))]


def candidates(spark: SparkSession, chunks_path: str, pattern: str) -> DataFrame | None:
    """paper_id, chunk_id of the chunks that have the pattern's trigrams, read from their folders of the index; None if the pattern has none or there is no index."""
    known = wanted(spark, pattern)
    asked = spark.createDataFrame([(g,) for g in known], "gram string")
    rows = tables.read(spark, index_path(chunks_path), tables.met(asked, "gram")) if known else None
    if rows is None:
        return None
    each = rows.filter(F.col("gram").isin(known)).select("gram", F.inline(F.arrays_zip("paper_ids", "chunk_ids"))).toDF("gram", "paper_id", "chunk_id")
    # a bit for each trigram, so that a chunk that is indexed twice counts once
    bit = reduce(lambda out, i: out.when(F.col("gram") == known[i], 1 << i), range(1, len(known)), F.when(F.col("gram") == known[0], 1))
    return each.groupBy("paper_id", "chunk_id").agg(F.bit_or(bit).alias("met")).filter(F.col("met") == (1 << len(known)) - 1).select("paper_id", "chunk_id")


def search(spark: SparkSession, chunks_path: str, patterns: Sequence[str]) -> DataFrame:
    """The stored chunks that are like %pattern% for any of the patterns, whatever their case, % and _ being wild.

    What the index finds is confirmed by the same comparison that a scan makes, and only the folders of candidates' papers
    are read. If a pattern has no stretch of three characters, all chunks are.
    """
    found = [candidates(spark, chunks_path, p) for p in patterns]
    like = T.any_like(F.col("text"), patterns)
    if not found or any(f is None for f in found):
        return readers.read_chunks(spark, chunks_path).filter(like) if found else readers.read_chunks(spark, chunks_path).limit(0)
    met = saved(reduce(DataFrame.unionByName, found).distinct())
    rows = tables.read(spark, chunks_path, tables.met(met, "paper_id")).drop("batch", "bucket")
    return rows.join(met, ["paper_id", "chunk_id"], "left_semi").filter(like)
