"""Operator 7: substring de-duplication by Rabin-Karp hashes of every window of words, counted in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.llm.common import SPACE, dealt_by_id, mix, partitions_of, small_batches, span_hashes, steps, text_bytes, windows

#: Words of a window.
WIDTH = 20
_OTHER = np.uint64(0xA0761D6478BD642F)


def bordered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with one space after each text, and the offsets of the texts among them."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    return out, offsets + np.arange(n + 1)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of bordered texts, and the index of each text's first word."""
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


class Block:
    """The words and windows of a block's texts, taken a step at a time."""

    def __init__(self, column: pa.Array, width: int) -> None:
        self.width = width
        self.parts = []
        data, offsets = text_bytes(column)
        hashes, bits = [], []
        for i, j in steps(offsets):
            own, at = bordered(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            starts, ends, first = spans(own, at)
            words = span_hashes(own, starts, ends)
            owner = np.repeat(np.arange(j - i), np.diff(first))
            begins = np.flatnonzero(owner[: max(0, len(owner) - width + 1)] == owner[width - 1 :])
            hashes.append(windows(words, width)[begins])
            bits.append(windows(mix(words ^ _OTHER), width)[begins])
            self.parts.append((own, starts, ends, first, begins))
        none = np.zeros(0, np.uint64)
        hashes = np.concatenate([none, *hashes])
        # of equal windows of this block the first can be the first of all; the others never are
        _, firsts, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.argsort(firsts, kind="stable")
        self.of = np.argsort(order, kind="stable")[self.of]
        self.firsts = firsts[order]
        self.hashes, self.bits = hashes[self.firsts], np.concatenate([none, *bits])[self.firsts]

    def buckets(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows dealt to buckets by a hash of their own: their order, the buckets that have some, and where each begins."""
        bucket = (self.bits % np.uint64(count)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        some, begins = np.unique(bucket[order], return_index=True)
        return order, some, np.append(begins, len(order))

    def cleaned(self, known: np.ndarray) -> Iterator[tuple[bytes, int, list[list[int]]]]:
        """Per text: the kept words joined by spaces, the number of words, and the removed intervals of words. known: of distinct windows, whether an earlier block has them."""
        again = np.ones(len(self.of), bool)
        again[self.firsts] = known
        at = 0
        for own, starts, ends, first, begins in self.parts:
            marks = np.zeros(len(starts) + 1, np.int64)
            hit = begins[again[at : at + len(begins)]]
            at += len(begins)
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + self.width, -1)
            removed = np.cumsum(marks)[:-1] > 0
            # a kept word's bytes and the one after it
            cover = np.zeros(len(own) + 2, np.int8)
            cover[starts[~removed]] += 1
            cover[ends[~removed] + 1] -= 1
            keep = np.cumsum(cover, dtype=np.int8)[: len(own)] > 0
            own = own.copy()
            own[ends[~removed]] = 0x20
            text = own[keep].tobytes()
            sizes = np.concatenate([[0], np.cumsum(np.where(removed, 0, ends - starts + 1))])[first]
            for k in range(len(first) - 1):
                a, b = first[k], first[k + 1]
                found = removed[a:b]
                gaps = []
                if found.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).view(np.int8)))
                    gaps = edges.reshape(-1, 2).tolist()
                yield text[sizes[k] : max(sizes[k], sizes[k + 1] - 1)], int(b - a), gaps


def drop_repeats(documents: DataFrame, passing: tuple[str, ...] = ("doc_id",), width: int = WIDTH, spacing: bool = False) -> DataFrame:
    """The columns passing, text (kept words joined by single spaces; with spacing, texts that lose nothing stay as they are), n_words, n_removed and removed (intervals of words) of every row.

    A word is removed if a window of width words covers it whose words also stand earlier: in a row of a smaller doc_id,
    or in the same row from an earlier word on. Windows are judged on the input. Rows of one doc_id are in the order of
    their texts, those without doc_id come last; of wholly repeated rows all but one are removed. A null text is an
    empty one; texts of fewer words keep all. Clashing names among further columns do no harm: only doc_id, text and
    the columns passing are read. An empty table gives an empty result.

    Rows are dealt to blocks of consecutive doc_ids. A block sends each distinct window once, as eight bytes of hash in
    the bucket that a second hash names, in the order of its words; a bucket takes the blocks in order and tells each
    which of its windows an earlier block has, as one bit each. The texts are shuffled once, for both passes.
    Two different windows pass for one if both hashes agree, which is to be expected once in 2**64 times the number of
    buckets of pairs.
    """
    spark = documents.sparkSession
    small_batches(spark, 500)
    names = [c for c in passing if c not in ("doc_id", "text")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *names)
    dealt, blocks = dealt_by_id(rows, "doc_id", "text")
    buckets = max(1, blocks)

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()

    def text_of(table: pa.Table) -> pa.Array:
        column = table.column("text").cast(pa.large_string()).combine_chunks()
        return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else (column if isinstance(column, pa.Array) else pa.array([], pa.large_string()))

    def send(table: pa.Table) -> pa.Table:
        block = Block(text_of(ordered(table)), width)
        order, some, begins = block.buckets(buckets)
        raw = block.hashes[order].tobytes()
        return pa.table(
            {
                "bucket": pa.array(some, pa.int64()),
                "block": pa.array([table.column("block")[0].as_py()] * len(some), pa.int64()),
                "hashes": pa.array([raw[8 * a : 8 * b] for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary()),
            }
        )

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        raw = table.column("hashes").to_pylist()
        sizes = np.array([len(x) // 8 for x in raw], np.int64)
        hashes = np.frombuffer(b"".join(raw), np.uint64)
        order = np.argsort(hashes, kind="stable")
        found = hashes[order]
        known = np.zeros(len(hashes), bool)
        known[order[1:]] = found[1:] == found[:-1]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        some = [i for i in range(len(raw)) if known[begins[i] : begins[i + 1]].any()]
        return pa.table(
            {
                "block": table.column("block").take(pa.array(some, pa.int64())),
                "bucket": table.column("bucket").take(pa.array(some, pa.int64())),
                "known": pa.array([np.packbits(known[begins[i] : begins[i + 1]]).tobytes() for i in some], pa.binary()),
            }
        )

    kept = rows.select("doc_id", *names).schema.fields
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])

    def clean(texts: pa.Table, marks: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, arrow_types, strict=True)})
        texts = ordered(texts)
        block = Block(text_of(texts), width)
        order, some, begins = block.buckets(buckets)
        known = np.zeros(len(order), bool)
        place = {b: i for i, b in enumerate(some.tolist())}
        for bucket, bits in zip(marks.column("bucket").to_pylist(), marks.column("known").to_pylist(), strict=True):
            i = place[bucket]
            own = order[begins[i] : begins[i + 1]]
            known[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        found = list(block.cleaned(known))
        cleaned = [x.decode() for x, _, _ in found]
        if spacing:
            cleaned = [x if gaps else was for x, (_, _, gaps), was in zip(cleaned, found, texts.column("text").to_pylist(), strict=True)]
        columns = {c: texts.column(c) for c in ("doc_id", *names)}
        return pa.table(
            {
                **columns,
                "text": pa.array(cleaned, pa.string()),
                "n_words": pa.array([n for _, n, _ in found], pa.int64()),
                "n_removed": pa.array([sum(b - a for a, b in gaps) for _, _, gaps in found], pa.int64()),
                "removed": pa.array([gaps for _, _, gaps in found], pa.list_(pa.list_(pa.int64()))),
            }
        )

    arrow_types = [to_arrow_type(f.dataType) for f in schema.fields]
    parts = partitions_of(spark, blocks)
    sent = dealt.groupBy("block").applyInArrow(send, "bucket long, block long, hashes binary")
    judged = sent.groupBy("bucket").applyInArrow(judge, "block long, bucket long, known binary")
    out = dealt.groupBy("block").cogroup(judged.repartition(parts, "block").groupBy("block")).applyInArrow(clean, schema)
    return out.select(*passing, *[c for c in ("text", "n_words", "n_removed", "removed") if c not in passing])
