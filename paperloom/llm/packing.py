"""Operator 5: packing token ids into sequences by dynamic programming over the documents in their order."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import tokenizer
from paperloom.llm.common import small_batches

#: Penalties in tokens of padding: for a cut within a document at a sentence's end, and within a sentence.
SENTENCE_CUT, INNER_CUT = 2, 12
#: Within a sentence, cuts are thought of every so many ids.
INNER_STEP = 32
#: Ids that one run of the dynamic programme covers; what follows its last sequence goes to the next run.
HORIZON = 1 << 18
#: A process's table of encoded units becomes the older one beyond so many entries; what the older one holds is used on, until the next time.
UNITS = 200_000
#: New units are encoded so many to a text.
UNITS_TOGETHER = 128
#: White space that the unit split does not know, and a space beside other white space: such texts take a slower way.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BESIDE = re.compile(rb" [\x20\x09-\x0d]|[\x09-\x0d] ")
_BLANK = b" \t\n\r\x0b\x0c"
_SENTENCE_END = re.compile("[.!?\u3002\uff01\uff1f][\"')\\]\u201d\u2019]*$|\n")
#: Of this process: the encoder and the sentence ends for each path.
_ENCODERS: dict[str, tuple] = {}


class UnitEncoder:
    """Encodes texts for a byte-level vocabulary unit by unit: a unit is what stands between single spaces, with the space before it.

    The vocabulary's pieces begin at such a space and never reach over one, so a unit's ids do not depend on what stands
    around it, and each distinct unit is encoded once. Texts with other white space, with a space beside white space, or
    that spell an added token, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        # a piece may reach over a space only in texts that are encoded whole
        over = [i for i, p in enumerate(pieces) if any(a != "\u0120" and b == "\u0120" for a, b in zip(p, p[1:]))]  # noqa: B905
        if not all(_OTHER_SPACE.search(self.tokenizer.decode([i], skip_special_tokens=False)) for i in over):
            raise ValueError(f"{path} has pieces that reach over a space")
        self.begins = np.array([p.startswith("\u0120") for p in pieces])
        self.spaced: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.first: dict[bytes, bytes] = {}

    def _learn(self, known: dict[bytes, bytes], units: list[bytes], before: str) -> None:
        for u, e in zip(units, self.tokenizer.encode_batch_fast([before + u.decode() for u in units], add_special_tokens=False), strict=True):
            known[u] = np.array(e.ids, "<u4").tobytes()

    def _learn_spaced(self, units: set[bytes]) -> None:
        """Many units make one text; each unit's first id is the only one that begins with a space."""
        alone = [u for u in units if not u or u[-1] in _BLANK or u[0] in _BLANK]
        new = list(units.difference(alone))
        groups = [new[i : i + UNITS_TOGETHER] for i in range(0, len(new), UNITS_TOGETHER)]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast([(b" " + b" ".join(g)).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.begins[ids]).tolist()
            if len(at) != len(own) or at[0]:
                alone += own
                continue
            raw = ids.tobytes()
            self.spaced.update(zip(own, [raw[4 * a : 4 * b] for a, b in zip(at, [*at[1:], len(ids)], strict=True)], strict=True))
        self._learn(self.spaced, alone, " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        if len(self.spaced) > UNITS:
            self.spaced, self.older = {}, self.spaced
        if len(self.first) > UNITS // 8:
            self.first.clear()
        out: list[bytes | None] = [None] * len(texts)
        dealt, hard = {}, []
        for i, text in enumerate(texts):
            raw = text.encode()
            if _BESIDE.search(raw) or _OTHER_SPACE.search(text) or any(a in text for a in self.added):
                hard.append(i)
            else:
                dealt[i] = raw.split(b" ")
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        self._learn(self.first, list({x[0] for x in dealt.values()} - self.first.keys()), "")
        units = set().union(*[x[1:] for x in dealt.values()]) - self.spaced.keys()
        again = units & self.older.keys()
        self.spaced.update((u, self.older[u]) for u in again)
        self._learn_spaced(units - again)
        spaced = self.spaced.__getitem__
        for i, x in dealt.items():
            out[i] = b"".join([self.first[x[0]], *map(spaced, x[1:])])
        return out


def sentence_ends(path: str) -> np.ndarray:
    """For each id: whether its text ends a sentence or a line."""
    t = tokenizer(path)
    return np.array([bool(_SENTENCE_END.search(t.decode([i], skip_special_tokens=False))) for i in range(t.get_vocab_size(with_added_tokens=True))])


def cut_places(ids: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a cut may be, and its penalty. ends: indices after documents' last ids; inner: of ids, whether a sentence ends there."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[INNER_STEP::INNER_STEP] = INNER_CUT
    cost[1:][inner[ids]] = SENTENCE_CUT
    cost[ends] = 0
    cost[0] = -1
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: np.ndarray, costs: np.ndarray, size: int, last: bool) -> list[int]:
    """The cuts of least padding plus penalties. last: the final place is a cut; else the best place within the last size ids is the last cut.

    f(j) = cost(j) + min over i in reach of f(i) + size - (j - i): a queue keeps the i in reach with f(i) + i rising, so
    each place enters and leaves it once.
    """
    at, cost = [0, *places.tolist()], [0, *costs.tolist()]
    f, back = [0] * len(at), [0] * len(at)
    queue = deque([(0, 0)])  # (f(i) + i, index)
    pop, popleft, append = queue.pop, queue.popleft, queue.append
    for j in range(1, len(at)):
        x = at[j]
        while at[queue[0][1]] < x - size:
            popleft()
        value, i = queue[0]
        f[j] = total = value + size - x + cost[j]
        back[j] = i
        total += x
        while queue and queue[-1][0] >= total:
            pop()
        append((total, j))
    j = len(at) - 1
    if not last:
        j = min(range(max(1, next(k for k, x in enumerate(at) if x > at[-1] - size)), len(at)), key=lambda k: (f[k], -k))
    cuts = []
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(start: int, end: int, size: int) -> list[int]:
    """Cuts of a last, short sequence: powers of two need no padding, and a rest that wants at most 48 ids is padded."""
    cuts = []
    while (left := end - start) and left & (left - 1) and size - left > 48:
        start += 1 << (left.bit_length() - 1)
        cuts.append(start)
    return [*cuts, end] if end > start else cuts


def pack(documents: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents' ids, dealt to sequences of at most size ids.

    A row for each piece: doc_id, start (its document's ids before it), length, ids (binary, little-endian unsigned
    32-bit), doc_tokens (its document's ids, with end_id after the last), sequence_id, offset (of the piece in its
    sequence; pieces fill it from 0 without a gap). Documents keep their order in the table's partitions and each
    partition is packed alone, without a shuffle; a cut lies at a document's end, else at a sentence's end, else within
    it, whichever least adds padding and penalties. Each partition's last sequence is split at powers of two.
    A null text is an empty one, whose only id is end_id. Null and repeated doc_ids are packed like others, other
    columns are not read, an empty table gives an empty result. path: a tokenizers file that each executor must have.
    """
    small_batches(documents.sparkSession, 500)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = UnitEncoder(path), sentence_ends(path)
        encoder, inner = _ENCODERS[path]
        sequence = TaskContext.get().partitionId() << 40
        # documents not yet packed: id, its ids, of which so many are packed
        held: list[tuple[int | None, np.ndarray, int]] = []
        waiting = 0

        def run(last: bool) -> pa.RecordBatch:
            nonlocal held, waiting, sequence
            ids = np.concatenate([x[done:] for _, x, done in held])
            ends = np.cumsum([len(x) - done for _, x, done in held])
            cuts = best_cuts(*cut_places(ids, ends, inner), size, last)
            if last and cuts:
                begin = cuts[-2] if len(cuts) > 1 else 0
                cuts[-1:] = tail_cuts(begin, cuts[-1], size)
            upto = cuts[-1]
            borders = np.union1d(np.append(0, cuts), ends[ends < upto])
            doc = np.searchsorted(ends, borders[:-1], "right")
            seq = np.searchsorted(cuts, borders[:-1], "right")
            begins = np.append(0, cuts)[seq]
            raw = ids.tobytes()
            first = np.append(0, ends)[doc]
            done = np.array([x for _, _, x in held])[doc]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d in doc], pa.int64()),
                    pa.array(borders[:-1] - first + done, pa.int64()),
                    pa.array(np.diff(borders), pa.int64()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary()),
                    pa.array([len(held[d][1]) for d in doc], pa.int64()),
                    pa.array(sequence + seq, pa.int64()),
                    pa.array(borders[:-1] - begins, pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts)
            d = int(np.searchsorted(ends, upto, "right"))
            rest = [(held[d][0], held[d][1], int(len(held[d][1]) - (ends[d] - upto)))] if d < len(held) else []
            held = rest + held[d + 1 :]
            waiting = sum(len(x) - done for _, x, done in held)
            return out

        for batch in it:
            names = batch.column("doc_id").to_pylist()
            for name, ids in zip(names, encoder.encode([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                own = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)).astype("<u4")
                held.append((name, own, 0))
                waiting += len(own)
                while waiting >= HORIZON:
                    yield run(False)
        if held:
            yield run(True)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)
