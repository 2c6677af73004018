"""Operator 6: document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import shingle_hashes, small_batches, steps, text_bytes, word_hashes

#: Hashes that a sketch keeps, and the words of a shingle.
SKETCH, SHINGLE = 256, 5
#: Hashes are kept as their top 48 bits.
BITS = 48


class BottomK:
    """The k smallest distinct shingle hashes of a set. All methods are static and work on sorted arrays."""

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> np.ndarray:
        """The sketch of the union of two sets, from their sketches alone."""
        return np.union1d(a, b)[:k]

    @staticmethod
    def count(a: np.ndarray, k: int = SKETCH) -> float:
        """The number of distinct shingles: exact below k, else estimated from the kth smallest hash."""
        return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2**BITS)

    @staticmethod
    def resemblance(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
        """The Jaccard likeness of two sets: the share of the union's sketch that both have. Two empty sets are alike."""
        if not len(a) and not len(b):
            return 1.0
        union = BottomK.merge(a, b, k)
        both = np.intersect1d(a, b, assume_unique=True)
        return float(np.isin(union, both, assume_unique=True).sum()) / len(union)

    @staticmethod
    def containment(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
        """The share of a that is in b; an empty set is in any."""
        if not len(a):
            return 1.0
        return min(1.0, BottomK.resemblance(a, b, k) * BottomK.count(BottomK.merge(a, b, k), k) / BottomK.count(a, k))

    @staticmethod
    def text(a: np.ndarray) -> str:
        """A sketch as a string: base64 of its hashes, six bytes each."""
        return base64.b64encode(np.ascontiguousarray(a.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()

    @staticmethod
    def parse(s: str) -> np.ndarray:
        raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
        return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def sketches(column: pa.Array, k: int = SKETCH, width: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text: of its shingles of width words (of all its words, if fewer). Case counts. Null is empty."""
    out: list[np.ndarray] = []
    data, offsets = text_bytes(column)
    for i, j in steps(offsets):
        part = data[offsets[i] : offsets[j]]
        hashes, first = shingle_hashes(*word_hashes(part, offsets[i : j + 1] - offsets[i]), width)
        hashes >>= np.uint64(64 - BITS)
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = hashes[a:b]
            # of a long text only the smallest can be in the sketch: those below a bound that well over k distinct ones stay under
            if len(own) > 8 * k:
                low = own[own <= np.partition(own, 4 * k)[4 * k]]
                own = low if len(np.unique(low)) >= k else own
            out.append(np.unique(own)[:k])
    return out


def fingerprints(documents: DataFrame, passing: tuple[str, ...] = ("doc_id",), k: int = SKETCH) -> DataFrame:
    """The columns passing, fingerprint string and n_shingles double (distinct, estimated from k on) of every row.

    A null text is an empty one; without words the fingerprint is an empty string. Equal texts have equal fingerprints.
    Ids may be null or repeated: a row's fingerprint depends on its text alone. An empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    schema = documents.select(*passing).schema.add("fingerprint", "string").add("n_shingles", "double")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = sketches(batch.column("__text"), k)
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([BottomK.text(x) for x in found]), pa.array([BottomK.count(x, k) for x in found], pa.float64())], schema=None, names=[*passing, "fingerprint", "n_shingles"])

    return documents.select(*passing, F.col("text").alias("__text")).mapInArrow(work, schema)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _heads_from(value: Column, heads: list[int]) -> Column:
    """How many of the heads, which fall, are not less than the value: found among every 64th, then among 64."""
    if not heads:
        return F.lit(0)
    every = F.array(*[F.lit(h).cast("long") for h in heads])
    coarse = F.size(F.filter(F.array(*[F.lit(h).cast("long") for h in heads[::64]]), lambda h: h >= value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * 64 + F.size(F.filter(F.slice(every, (coarse - 1) * 64 + 1, F.lit(64)), lambda h: h >= value)))


def neighbour_edits(documents: DataFrame, k: int = SKETCH) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document, by descending doc_id (after the last: the first).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: see the operator's query.
    A null text is an empty one. Rows with a null doc_id come last in the order, rows of equal ids are in the order of
    their texts; each row has one next row. A single row is its own next. Further columns are not read; an empty table
    gives an empty result.

    Documents are dealt to id ranges whose borders are true ids, chosen from quantiles; a range also gets a copy of the
    first row of the next range, so that each range is done alone. What is collected: one border per range.
    """
    spark = documents.sparkSession
    small_batches(spark, 500)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    facts = rows.agg(F.percentile_approx("doc_id", shares, 100 * parts).alias("at"), F.max("doc_id").alias("top"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # range i holds ids in (heads[i + 1], heads[i]]; the last one all below and the nulls
    heads = sorted({*(facts["at"] or []), *([facts["top"]] if facts["top"] is not None else [])}, reverse=True)
    where = _heads_from(F.coalesce(F.col("doc_id"), F.lit(-(2**63))), heads)
    own = rows.withColumn("range", where).withColumn("peek", F.lit(False))
    # the first row of a range: of the rows with the range's greatest id (nulls, if there are only nulls) the one with the smallest text
    firsts = own.filter(F.col("doc_id").isin(heads) if heads else F.lit(True)).groupBy("range").agg(F.max_by("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).alias("doc_id"), F.min("text").alias("text"))
    ranges = len(heads) if heads else 1
    before = F.when(F.col("range") == (1 if heads else 0), ranges if heads else 0).otherwise(F.col("range") - 1)
    peeks = firsts.select("doc_id", "text", before.alias("range"), F.lit(True).alias("peek"))
    dealt = own.unionByName(peeks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range")
    ordered = dealt.sortWithinPartitions("range", "peek", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in it:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at, peek = batch.column("range").to_pylist(), batch.column("peek").to_pylist()
            marks = sketches(batch.column("text"), k)
            rows = [*([held] if held else []), *zip(ids, texts, at, peek, marks, strict=True)]
            held = rows[-1] if rows else held
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[2] == b[2] and not a[3]]
            changed = [edited(a[1], b[1]) for a, b in pairs]
            new = sketches(pa.array(changed, pa.string()), k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                    pa.array([BottomK.text(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([BottomK.text(x) for x in new], pa.string()),
                    pa.array([BottomK.resemblance(a[4], x, k) for (a, _), x in zip(pairs, new, strict=True)], pa.float64()),
                    pa.array([BottomK.resemblance(a[4], b[4], k) for a, b in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return ordered.mapInArrow(work, schema)
