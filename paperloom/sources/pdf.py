"""What a PDF file says of itself, read from its bytes within tasks: whether it is encrypted and how many pages it has."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

#: Bytes that a compressed stream of objects is read to at most.
MOST_STREAM = 64 << 20
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_STREAM = re.compile(rb"\bstream\r?\n")
_REF = rb"\s+(\d{1,10})\s+\d{1,5}\s+R\b"
_END = rb"(?=[\s/\[\]<>()])"


def dictionary(data: bytes, at: int) -> bytes:
    """The dictionary << >> that begins at or after `at`, with those within it; strings are passed over. Empty if it does not end."""
    begin = data.find(b"<<", at)
    depth, i = 0, begin
    while 0 <= i < len(data):
        two = data[i : i + 2]
        if two == b"<<":
            depth, i = depth + 1, i + 2
        elif two == b">>":
            depth, i = depth - 1, i + 2
            if not depth:
                return data[begin:i]
        elif data[i : i + 1] == b"(":
            open_ = 0
            while i < len(data):
                c = data[i : i + 1]
                open_ += (c == b"(") - (c == b")")
                i += 2 if c == b"\\" else 1
                if not open_:
                    break
        else:
            i = min((x for x in (data.find(c, i + 1) for c in (b"<", b">", b"(")) if x >= 0), default=len(data))
    return b""


def _trailers(data: bytes) -> list[bytes]:
    """The dictionaries of the file's trailers, and of its cross-reference streams, which stand for them; last ones first."""
    found = [(m.start(), dictionary(data, m.end())) for m in re.finditer(rb"\btrailer\b", data)]
    for m in _OBJECT.finditer(data):
        head = data[m.end() : m.end() + 2000]
        if re.search(rb"/Type\s*/XRef\b", head):
            found.append((m.start(), dictionary(data, m.end())))
    return [x for _, x in sorted(found, reverse=True)]


class _Objects:
    """A file's objects by number: the last of each, or one within a stream of objects."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.packed: dict[int, bytes] | None = None

    def get(self, number: int) -> bytes:
        if number in self.places:
            return dictionary(self.data, self.places[number])
        if self.packed is None:
            self.packed = {}
            for at in self.places.values():
                own = dictionary(self.data, at)
                if not re.search(rb"/Type\s*/ObjStm\b", own):
                    continue
                first, stream = re.search(rb"/First\s+(\d+)", own), _STREAM.search(self.data, at)
                if not first or not stream:
                    continue
                body = self.data[stream.end() : self.data.find(b"endstream", stream.end())]
                try:
                    body = zlib.decompressobj().decompress(body, MOST_STREAM) if b"/FlateDecode" in own else body
                except zlib.error:
                    continue
                start = int(first[1])
                head = [int(x) for x in body[:start].split() if x.isdigit()]
                for n, offset in zip(head[::2], head[1::2], strict=False):
                    self.packed[n] = dictionary(body, start + offset)
        return self.packed.get(number, b"")


def facts(data: bytes) -> tuple[bool, int | None]:
    """Whether a file's trailer names an encryption, and the count of its page tree's root; None if no such tree is found."""
    trailers = _trailers(data)
    if any(re.search(rb"/Encrypt" + _END, t) for t in trailers):
        return True, None
    objects = _Objects(data)
    for trailer in trailers:
        root = re.search(rb"/Root" + _REF, trailer)
        pages = root and re.search(rb"/Pages" + _REF, objects.get(int(root[1])))
        tree = objects.get(int(pages[1])) if pages else b""
        outer = re.sub(rb"(?s)(?<=.)<<.*>>(?=.)", b"", tree[2:-2])
        if count := re.search(rb"/Count\s+(\d{1,9})(?!\d|\s+\d+\s+R)", outer):
            return False, int(count[1])
    return False, None


def file_problem(content: Column, most_pages: int = 200) -> Column:
    """`encrypted`, `too many pages`, or null: what is wrong with a PDF file before its pages are read. Null for null, and for a file without a page tree, whose reader will tell."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for value in column:
                encrypted, pages = facts(value.as_py()) if value.is_valid else (False, None)
                out.append("encrypted" if encrypted else "too many pages" if (pages or 0) > most_pages else None)
            yield pa.array(out, pa.string())

    return F.arrow_udf(work, "string", ArrowUDFType.SCALAR_ITER)(content)
