"""Operator 13: byte-level BPE by recursive queries of DuckDB, run in each Spark task over the task's distinct words."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import bounded, span_hashes, text_bytes

#: Bytes of text that a task takes at once (one longer text is taken alone), and words and bytes that one recursive query contracts (one longer word is taken alone).
PIECE_BYTES, QUERY_WORDS, QUERY_BYTES = 4 << 20, 1 << 16, 1 << 20
#: A process's table of encoded words starts anew beyond so many words.
KEPT_WORDS = 1 << 20
#: Words of more bytes are contracted by the query that takes all equal pairs at once.
LONG = 64
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Of this process: encoders by file.
_ENCODERS: dict[str, WordEncoder] = {}

#: Contracts the leftmost pair of the least rank in every word, until no word has a pair with a rank.
CONTRACT = """
WITH RECURSIVE t AS (
  SELECT w, g, id, false AS done FROM pieces
  UNION ALL
  (WITH s AS (SELECT w, g, id, CASE WHEN lead(w) OVER z = w THEN lead(id) OVER z END AS next_id FROM t WHERE NOT done WINDOW z AS (ORDER BY g)),
    j AS (SELECT s.*, (m.r::BIGINT << 32) + g AS k FROM s LEFT JOIN merges m ON m.a = s.id AND m.b = s.next_id),
    b AS (SELECT w, min(k) AS best FROM j GROUP BY w),
    c AS (SELECT j.w, g, id, k, lag(k) OVER (ORDER BY g) AS before, best FROM j JOIN b USING (w))
   SELECT w, g, CASE WHEN k = best THEN (k >> 32)::INT ELSE id END, best IS NULL FROM c WHERE best IS NULL OR before IS DISTINCT FROM best))
SELECT w, id FROM t WHERE done ORDER BY g
"""
#: The same, but takes all pairs of a word's least rank together, from the left, where no pair that they make can have a lower rank.
CONTRACT_LONG = """
WITH RECURSIVE t AS (
  SELECT w, g, id, false AS done FROM pieces
  UNION ALL
  (WITH s AS (SELECT w, g, id, CASE WHEN lead(w) OVER z = w THEN lead(id) OVER z END AS next_id FROM t WHERE NOT done WINDOW z AS (ORDER BY g)),
    j AS (SELECT s.*, m.r, m.together, (m.r::BIGINT << 32) + g AS k FROM s LEFT JOIN merges m ON m.a = s.id AND m.b = s.next_id),
    b AS (SELECT w, min(k) AS best FROM j GROUP BY w),
    h AS (SELECT j.w, g, id, r, best, coalesce(k = best OR together AND r = best >> 32, false) AS hit FROM j JOIN b USING (w)),
    i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (ORDER BY g) AS island FROM h),
    n AS (SELECT *, hit AND row_number() OVER (PARTITION BY island, hit ORDER BY g) % 2 = 1 AS taken FROM i),
    c AS (SELECT *, lag(taken) OVER (ORDER BY g) AS gone FROM n)
   SELECT w, g, CASE WHEN taken THEN r ELSE id END, best IS NULL FROM c WHERE gone IS NOT TRUE))
SELECT w, id FROM t WHERE done ORDER BY g
"""
#: The text of every row's ids, in order.
DECODE = "SELECT w, string_agg(v.token, '' ORDER BY g) AS text FROM coded JOIN vocabulary v USING (id) GROUP BY w ORDER BY w"


def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other, as tiktoken's own expressions have them."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    for expression, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
        found = tiktoken.Encoding(expression, pat_str=expression, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def match_starts(points: np.ndarray, kinds: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the matches of public_tokenizers.PATTERN begin among code points of these classes. edges: where texts begin, and the end.

    A word is a run of letters, of numbers or of other characters, with one blank before it, if there is one. White space
    before a word ends one character early, at its end not at all. An apostrophe alone, without a blank, takes s, t, re,
    ve, m, ll or d from the letters after it.
    """
    n = len(points)
    begins = np.zeros(n + 1, bool)  # of runs
    begins[edges] = True
    begins[1:n] |= kinds[1:] != kinds[:-1]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    starts = begins[:n].copy()
    space = kinds == _SPACE
    words = np.flatnonzero(begins[1:n] & ~edge[1:n] & ~space[1:] & space[:-1]) + 1  # runs after white space
    starts[words - 1] = True
    starts[words[points[words - 1] == 0x20]] = False
    after = np.concatenate([points, [0, 0, 0]])
    alone = np.flatnonzero((points == 0x27) & starts & begins[1:])
    alone = alone[(alone + 1 < n) & ~edge[alone + 1]]
    one, two = after[alone + 1], after[alone + 2]
    taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    taken = np.where(pair & ~edge[np.minimum(alone + 2, n)], 2, taken)
    alone, taken = alone[taken > 0], taken[taken > 0]
    starts[alone + 1] = False
    rest = alone + 1 + taken
    starts[rest[(rest < n)]] = True
    return np.flatnonzero(starts)


def spread_spans(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of pool, one after the other."""
    ends = np.cumsum(lengths)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class WordEncoder:
    """Encodes the matches of the pattern, each distinct one once, by the ranks of a file; keeps what it has encoded.

    A match that is a token itself is that token. Any other begins as its bytes' tokens, as position rows; a recursive
    query joins neighbours with the table of merges and contracts until no match has a pair in it. Words are told apart by
    64-bit hashes; as every text's decoded bytes are held against the text, a clash cannot pass unseen.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.classes = character_classes()
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = np.array(pairs, np.int64).reshape(-1, 3).T
        least = np.full(max(ranks.values()) + 1, np.iinfo(np.int64).max)  # rank of the first pair that a token can be part of
        np.minimum.at(least, a, r)
        np.minimum.at(least, b, r)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._table("merges", a=a.astype(np.int32), b=b.astype(np.int32), r=r.astype(np.int32), together=least[r] > r)
        # a token's bytes as characters from 256 on, so that each is two bytes of UTF-8
        self._table("vocabulary", id=np.array(list(ranks.values()), np.int32), token=["".join(chr(256 + x) for x in t) for t in ranks])
        ends = np.cumsum([len(t) for t in ranks])
        hashes = span_hashes(np.frombuffer(b"".join(ranks), np.uint8), np.append(0, ends[:-1]), ends)
        order = np.argsort(hashes)
        self.tokens, self.token_ids = hashes[order], np.array(list(ranks.values()), np.uint32)[order]
        self.forget()

    def _table(self, name: str, **columns) -> None:
        self.db.register("rows_of", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_of")
        self.db.unregister("rows_of")

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.id_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.text, self.text_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _contract(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, query: str) -> tuple[np.ndarray, np.ndarray]:
        self._table("pieces", w=np.repeat(np.arange(len(begin), dtype=np.int32), size), g=np.arange(size.sum(), dtype=np.int32), id=self.byte_ids[spread_spans(data, begin, size)])
        found = self.db.execute(query).fetchnumpy()
        return np.asarray(found["id"], np.uint32), np.bincount(found["w"], minlength=len(begin))

    def encode(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words that begin at these bytes, one word after the other, and how many each word has."""
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        single = self.tokens[at] == hashes
        order, ids, counts = [np.flatnonzero(single)], [self.token_ids[at[single]]], [np.ones(single.sum(), np.int64)]
        for kind, query in ((size <= LONG, CONTRACT), (size > LONG, CONTRACT_LONG)):
            rest = np.flatnonzero(~single & kind)
            upto = np.concatenate([[0], np.cumsum(size[rest])])
            i = 0
            while i < len(rest):
                j = max(i + 1, min(i + QUERY_WORDS, int(np.searchsorted(upto, upto[i] + QUERY_BYTES, "right")) - 1))
                own = rest[i:j]
                found, n = self._contract(data, begin[own], size[own], query)
                order.append(own)
                ids.append(found)
                counts.append(n)
                i = j
        n, back = np.concatenate(counts), np.argsort(np.concatenate(order))
        return spread_spans(np.concatenate(ids), (np.cumsum(n) - n)[back], n[back]), n[back]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of sequences of so many ids each, one after the other, and how many bytes each has."""
        self._table("coded", w=np.repeat(np.arange(len(counts), dtype=np.int32), counts), g=np.arange(len(ids), dtype=np.int32), id=ids.astype(np.int32))
        found = self.db.sql(DECODE).to_arrow_table()
        utf8, ends = text_bytes(found.column("text").combine_chunks())
        two = utf8[ends[0] : ends[-1]].reshape(-1, 2)
        sizes = np.zeros(len(counts), np.int64)
        sizes[found.column("w").to_numpy()] = np.diff(ends) // 2
        return ((two[:, 0] & 0x1F) << 6) | (two[:, 1] & 0x3F), sizes  # in eight bits 256 is gone

    def _learn(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> None:
        ids, counts = self.encode(data, begin, size, hashes)
        text, sizes = self.decode(ids, counts)
        slots = np.arange(len(self.id_ends) - 1, len(self.id_ends) - 1 + len(hashes))
        self.ids, self.id_ends = np.concatenate([self.ids, ids]), np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(counts)])
        self.text, self.text_ends = np.concatenate([self.text, text]), np.concatenate([self.text_ends, self.text_ends[-1] + np.cumsum(sizes)])
        self.hashes, self.slots = np.concatenate([self.hashes, hashes]), np.concatenate([self.slots, slots])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.slots = self.hashes[order], self.slots[order]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts and the ends of each text's, and their decoded bytes and the ends of each text's (both from 0 on)."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        begin = chars[match_starts(points, self.classes[points], np.searchsorted(chars, offsets))]
        size = np.diff(np.append(begin, len(data)))
        first = np.searchsorted(begin, offsets)  # each text's first match
        distinct, some, of = np.unique(span_hashes(data, begin, begin + size), return_index=True, return_inverse=True)
        if len(self.hashes) > KEPT_WORDS:
            self.forget()
        fresh = ~np.isin(distinct, self.hashes, assume_unique=True)
        if fresh.any():
            self._learn(data, begin[some[fresh]], size[some[fresh]], distinct[fresh])
        slot = self.slots[np.searchsorted(self.hashes, distinct)][of]
        count, length = np.diff(self.id_ends)[slot], np.diff(self.text_ends)[slot]
        decoded = spread_spans(self.text, self.text_ends[slot], length)
        if not np.array_equal(decoded, data):
            raise ValueError("two words of these texts have one hash")
        upto = lambda lengths: np.concatenate([[0], np.cumsum(lengths)])[first]
        return spread_spans(self.ids, self.id_ends[slot], count), upto(count), decoded, upto(length)


def encode_documents(documents: DataFrame, path: str, passing: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns passing, ids binary (little-endian unsigned 32-bit) and decoded binary of every row's whole text.

    ids are those that tiktoken's encode_ordinary gives with the ranks of the file at path (which each executor must
    have) and the pattern that match_starts follows; decoded are the bytes that these ids stand for. A null or empty text
    has no ids. Null and repeated ids of documents are encoded row by row, other columns are not read (passing names those
    that are kept, text_column may be any), an empty table gives an empty result. A text is one piece of work, however
    long; a match of any length is contracted in one query. What a process keeps of encoded words is bounded and lost
    with it; nothing else is shared between tasks, so a lost executor costs its running tasks.
    """
    schema = documents.select(*passing).schema.add("ids", "binary").add("decoded", "binary")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        encoder = _ENCODERS[path]
        for batch in bounded(it, "__text", PIECE_BYTES):
            data, offsets = text_bytes(batch.column("__text"))
            ids, id_ends, decoded, ends = encoder.texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            coded = [pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(x.tobytes())]) for x, at in ((ids, 4 * id_ends), (decoded, ends))]
            yield pa.RecordBatch.from_arrays([*kept, *coded], names=[*passing, "ids", "decoded"])

    return documents.select(*passing, F.col(text_column).alias("__text")).mapInArrow(work, schema)
