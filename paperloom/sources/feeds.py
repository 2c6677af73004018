"""Saved feeds as a data source of Spark, in batch and as a stream: a partition for each file, offsets by the files' times.

    spark.dataSource.register(PaperFeed)
    spark.read.format("paper_feed").option("path", folder).option("kind", "atom").load()
    spark.readStream.format("paper_feed").option("path", folder).option("kind", "works").load()

Folders may be of any file system that Arrow knows by its address (files, HDFS, object stores).
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "title string, abstract string, authors array<string>, categories array<string>, published_date string, source string, source_id string, arxiv_id string, doi string, pdf_url string"
SUFFIXES = {"atom": ".xml", "works": ".json"}


@dataclass
class FeedFile(InputPartition):
    """One file, which one task reads."""

    path: str


def _one_space(text: str | None) -> str | None:
    return None if text is None else " ".join(text.split())


def atom_rows(file: Any) -> Iterator[tuple]:
    """Entries of an Atom feed, one at a time; namespaces are left out."""
    for _, entry in ElementTree.iterparse(file):
        if entry.tag.rpartition("}")[2] != "entry":
            continue
        child = lambda name, of=entry: [x for x in of if x.tag.rpartition("}")[2] == name]
        text = lambda name: next((x.text for x in child(name)), None)
        link = text("id")
        number = re.search(r"/abs/([^/]+)$", link or "")
        own = number[1] if number else ""
        names = [n.text for a in child("author") for n in child("name", a)]
        summary = text("summary")
        yield (
            _one_space(text("title")), summary.strip() if summary is not None else None, names, [c.get("term") for c in child("category")], text("published"), "arxiv",
            own, own, None, link.replace("/abs/", "/pdf/") + ".pdf" if link is not None else None,
        )
        entry.clear()


def work_rows(file: Any) -> Iterator[tuple]:
    """Works of a file with one JSON object a line; lines that are none are left out. An abstract is put together from its inverted index."""
    for line in file:
        try:
            w = json.loads(line)
        except ValueError:
            continue
        if not isinstance(w, dict):
            continue
        places = sorted((at, word) for word, found in (w.get("abstract_inverted_index") or {}).items() for at in found or [])
        topics = [t.get("display_name") for t in [w.get("primary_topic"), *(w.get("topics") or [])] if t and t.get("display_name")]
        names = [(a.get("author") or {}).get("display_name") for a in w.get("authorships") or []]
        yield (
            w.get("display_name"), " ".join(word for _, word in places) if places else None, names, list(dict.fromkeys(topics)), w.get("publication_date"), "openalex",
            w.get("id"), None, w.get("doi"), (w.get("primary_location") or {}).get("pdf_url"),
        )


class _Files:
    """What both readers share: the files of a folder and their rows."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind = options["path"], options.get("kind", "atom")
        if self.kind not in SUFFIXES:
            raise ValueError(f"kind must be one of {sorted(SUFFIXES)}")

    def files(self) -> list[tuple[int, str]]:
        """Modification time in nanoseconds and path of the feed's files, oldest first."""
        where, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        listed = where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path) for f in listed if f.is_file and f.path.endswith(SUFFIXES[self.kind]))

    def read(self, partition: FeedFile) -> Iterator[tuple]:
        where, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        with io.BufferedReader(where.open_input_stream(partition.path)) as file:
            yield from (atom_rows if self.kind == "atom" else work_rows)(file)


class FeedReader(_Files, DataSourceReader):
    def partitions(self) -> Sequence[FeedFile]:
        return [FeedFile(path) for _, path in self.files()]


class FeedStreamReader(_Files, DataSourceStreamReader):
    """Files come in the order of their times; an offset is the last file's time and path, so a file must not be older than those before it."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.files()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[FeedFile]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return [FeedFile(path) for time, path in self.files() if low < (time, path) <= high]


class PaperFeed(DataSource):
    """Raw metadata of papers from saved feeds. Options: path (a folder), kind (atom: .xml files of entries; works: .json files with a work a line)."""

    @classmethod
    def name(cls) -> str:
        return "paper_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(self.options)
