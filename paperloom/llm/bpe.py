"""Operator 10: BPE encoding and decoding with content-defined chunks that are encoded once, and joins that are re-encoded."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm.common import STEP_BYTES, bounded, small_batches

#: Rolling hashes cover so many bytes; a chunk ends where the top CUT_BITS bits are zero and it has LEAST bytes: some 1,300 bytes on average.
ROLL, CUT_BITS, LEAST = 16, 10, 256
#: Ids on each side of a join among which the words are sought that are encoded anew with it, where white space counts.
NEAR = 40
#: A process's tables start anew beyond so many characters of chunks, so many joins, and so many words.
KEPT_CHARS, JOINS, WORDS = 1 << 24, 50_000, 300_000
#: Blanks and line ends, which are white space to every tokenizer, and what stands between them.
_BLANKS, _WORD = re.compile(r"[ \t\n\r\x0b\x0c]"), re.compile(r"[^ \t\n\r\x0b\x0c]+")
_GEAR = np.random.default_rng(5).integers(1, 2**32, 256, dtype=np.uint32)
#: Of this process: what has been loaded, and the encoder whose tables later tasks go on with.
_TOKENIZERS: dict[str, Tokenizer] = {}
_ENCODERS: dict[str, ChunkEncoder] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding, loaded once in a process; it works on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks may end: after each byte at which the rolling hash of the ROLL bytes up to it says so. It depends on those bytes alone."""
    if len(data) < ROLL:
        return np.zeros(0, np.int64)
    h, size, factor = _GEAR[data], 1, 0x01000193
    while size < ROLL:
        h = h[:-size] * np.uint32(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 32)
    return np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + ROLL


def cuts_of(text: str) -> list[str]:
    """The chunks of a text. Cuts lie between characters, and none is nearer than LEAST bytes to the one before or the end."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = chunk_ends(data)
    starts = (data & 0xC0) != 0x80
    chars = np.cumsum(starts)
    out, last, begin = [], 0, 0
    for e in ends.tolist():
        if e - last >= LEAST and len(data) - e >= LEAST:
            at = int(chars[e - 1])  # the character that the cut falls into belongs to the chunk before it
            out.append(text[begin:at])
            last, begin = e, at
    return [*out, text[begin:]]


@dataclass
class Chunk:
    """Ids of a chunk, and what is near its ends: the last words (tail: their text, from the id `low` on) and the first (head: up to the id `high`).

    tail_of, tail_at: how many ids the tail's first word and the next id are, and where the latter stands. head_of,
    head_at: how many the head's last word and the id before are, and where that word begins.
    """

    ids: np.ndarray
    tail: str
    low: int
    tail_of: int
    tail_at: int
    head: str
    high: int
    head_of: int
    head_at: int


class ChunkEncoder:
    """Encodes texts from tables of chunks and joins.

    Each chunk is encoded once. Where white space has no ids and is in no piece of the vocabulary (looked up when it is
    read), that goes word by word, and each distinct word is encoded once; else the library takes the chunk as it is. At a
    join the last three words begun before it and the first three after it are encoded anew together by the library, and
    the result must agree with both chunks: its first word and the id after that, and its last word and the id before
    that, must be those of the chunks, at the same characters. What the join can change lies between. A text with a join
    that does not agree, or with a chunk of too few words, is encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = np.array([(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)], object)
        # white space has no ids and is in no piece, so that a word's ids do not depend on what stands around it
        self.by_words = not self.tokenizer.encode(" \n\t", add_special_tokens=False).ids and not any(_BLANKS.search(self.tokenizer.id_to_token(i) or "") for i in range(size))
        self.plain = self.tokenizer.decoder is None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, Chunk | None] = {}
        self.joins: dict[tuple[str, str], np.ndarray | None] = {}
        self.chars = 0
        self.seen = self.encoded = self.whole = 0

    def _by_words(self, texts: list[str]) -> list[tuple[list[str], bytes]]:
        """The words of each text, and its ids."""
        split = [_WORD.findall(x) for x in texts]
        if len(self.words) > WORDS:
            self.words.clear()
        new = list(set().union(*split) - self.words.keys())
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()
        get = self.words.__getitem__
        return [(own, b"".join(map(get, own))) for own in split]

    def _learn(self, chunks: list[str]) -> None:
        """Chunks word by word."""
        for x, (own, raw) in zip(chunks, self._by_words(chunks), strict=True):
            self.chars += len(x)
            self.chunks[x] = None
            begun = len(own) - (not _BLANKS.match(x))  # words that begin after a blank
            if begun < 6:
                continue
            count = lambda words: sum(len(self.words[w]) for w in words) // 4
            places = [m.start() for m in _WORD.finditer(x) if m.start()]
            ahead, behind = places[:3], places[-3:]
            lead = len(own) - begun
            tail, head = own[-3:], own[: lead + 2]
            ids = np.frombuffer(raw, "<u4")
            low, high = len(ids) - count(tail), count(head)
            if low < high or not self.words[tail[1]] or not self.words[head[-1]]:
                continue
            self.chunks[x] = Chunk(ids, x[behind[0] :], low, count(tail[:1]) + 1, behind[1] - behind[0], x[: ahead[2]], high, count(head[-1:]) + 1, ahead[1])

    def _learn_at_once(self, chunks: list[str]) -> None:
        """Chunks for a vocabulary in which white space counts: encoded by the library as they are, which tells where ids stand."""
        for x, e in zip(chunks, self.tokenizer.encode_batch(chunks, add_special_tokens=False), strict=True):
            self.chars += len(x)
            n = len(e)
            first, last = [], []  # ids that begin words, from the chunk's begin and from its end
            for found, order in ((first, range(1, min(n, NEAR))), (last, range(n - 1, max(0, n - NEAR), -1))):
                for i in order:
                    at = e.token_to_chars(i)[0]
                    if (x[at].isspace() or x[at - 1].isspace()) and e.token_to_chars(i - 1)[1] <= at:
                        found.append((i, at))
                        if len(found) == 3:
                            break
            if len(first) < 3 or len(last) < 3 or last[2][0] < first[2][0]:
                self.chunks[x] = None
                continue
            (low, begin), (next_, after) = last[2], last[1]
            (high, end), (word, at) = first[2], first[1]
            self.chunks[x] = Chunk(np.array(e.ids, "<u4"), x[begin:], low, next_ - low + 1, after - begin, x[:end], high, high - word + 1, at)

    def _join(self, pairs: list[tuple[Chunk, Chunk]]) -> None:
        """Learn the ids of the joins of these chunks, or None where they do not agree."""
        for (a, b), e in zip(pairs, self.tokenizer.encode_batch([a.tail + b.head for a, b in pairs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            i, j = a.tail_of, len(ids) - b.head_of
            agreed = i + b.head_of <= len(ids) and (ids[:i] == a.ids[a.low : a.low + i]).all() and (ids[j:] == b.ids[b.high - b.head_of : b.high]).all()
            agreed = agreed and e.token_to_chars(i - 1)[0] == a.tail_at and e.token_to_chars(j + 1)[0] == len(a.tail) + b.head_at
            self.joins[a.tail, b.head] = ids if agreed else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.chars > KEPT_CHARS or len(self.joins) > JOINS:
            self.chunks.clear()
            self.joins.clear()
            self.chars = 0
        dealt = [cuts_of(t) for t in texts]
        cut = [own for own in dealt if len(own) > 1]
        fresh = list({x for own in cut for x in own if x not in self.chunks})
        self.seen, self.encoded = self.seen + sum(map(len, dealt)), self.encoded + len(fresh)
        (self._learn if self.by_words else self._learn_at_once)(fresh)
        known = self.chunks
        pairs = {}
        for own in cut:
            for x, y in itertools.pairwise(own):
                a, b = known[x], known[y]
                if a and b and (a.tail, b.head) not in self.joins:
                    pairs[a.tail, b.head] = a, b
        self._join(list(pairs.values()))
        out: list[np.ndarray | None] = []
        for own in dealt:
            parts = [known[x] for x in own] if len(own) > 1 else [None]
            joins = [self.joins[a.tail, b.head] for a, b in itertools.pairwise(parts)] if None not in parts else []
            if not joins or any(j is None for j in joins):
                out.append(None)
                continue
            line = [parts[0].ids[: parts[0].low]]
            for j, part in zip(joins, parts[1:], strict=True):
                line += [j, part.ids[part.high : part.low]]
            line[-1] = parts[-1].ids[parts[-1].high :]
            out.append(np.concatenate(line))
        rest = list(dict.fromkeys(t for t, x in zip(texts, out, strict=True) if x is None))
        self.whole += len(rest)
        if self.by_words:
            whole = {t: np.frombuffer(raw, "<u4") for t, (_, raw) in zip(rest, self._by_words(rest), strict=True)}
        else:
            whole = {t: np.array(e.ids, "<u4") for t, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        return [whole[t] if x is None else x for t, x in zip(texts, out, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode gives, special tokens kept: names joined by blanks, unless the file has a decoder."""
        return b" ".join(self.names[ids].tolist()).decode() if self.plain else self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def encode_documents(documents: DataFrame, path: str, passing: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns passing, ids binary (little-endian unsigned 32-bit) and decoded string of every row's whole text.

    ids are those of the tokenizers library for the file at path (which each executor must have; a path is a parameter
    and the file is not copied), without special tokens added, truncation or padding; decoded is its decode of them,
    special tokens kept. A null text is an empty one: no ids. Ids may be null or repeated, an empty table gives an empty
    result, and other columns are not read. The chunk and join tables are a Python worker's own and bounded, so no row
    waits for another task; a text is one piece of work, however long.
    """
    small_batches(documents.sparkSession)
    schema = documents.select(*passing).schema.add("ids", "binary").add("decoded", "string")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(path)
        encoder = _ENCODERS[path]
        for batch in bounded(it, "__text", STEP_BYTES):
            ids = encoder.encode([x or "" for x in batch.column("__text").to_pylist()])
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())], names=[*passing, "ids", "decoded"])

    return documents.select(*passing, F.col("text").alias("__text")).mapInArrow(work, schema)
