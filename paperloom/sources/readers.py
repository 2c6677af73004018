"""Readers and writers: research feeds as files, PDF files with a pluggable extractor, chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import dedup
from paperloom.sources import tables
from paperloom.sources.pdf import file_problem
from paperloom.sources.steps import saved

FEED = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>"


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of saved Atom feeds as raw metadata."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(FEED).load(path)
    arxiv = F.regexp_extract("id", r"/abs/([^/]+)$", 1)
    return rows.select(
        T.one_space(F.col("title")).alias("title"), T.strip(F.col("summary")).alias("abstract"), F.transform("author", lambda a: a["name"]).alias("authors"),
        F.transform("category", lambda c: c["_term"]).alias("categories"), F.col("published").alias("published_date"), F.lit("arxiv").alias("source"),
        arxiv.alias("source_id"), arxiv.alias("arxiv_id"), F.concat(F.replace("id", F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf")).alias("pdf_url"), F.lit(None).cast("string").alias("doi"),
    )


WORK = (
    "id string, doi string, display_name string, publication_date string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, "
    "primary_topic struct<display_name:string>, topics array<struct<display_name:string>>, primary_location struct<pdf_url:string>, best_oa_location struct<pdf_url:string>"
)


def works(spark: SparkSession, path: str) -> DataFrame:
    """Works of saved JSON results (one work a line) as raw metadata; the abstract comes from its inverted index."""
    rows = spark.read.schema(WORK).json(path)
    return rows.select(
        F.col("display_name").alias("title"), F.when(F.size("abstract_inverted_index") > 0, T.abstract_of(F.col("abstract_inverted_index"))).alias("abstract"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        T.first_categories(F.col("primary_topic.display_name"), F.transform("topics", lambda t: t["display_name"])).alias("categories"),
        F.col("publication_date").alias("published_date"), F.lit("openalex").alias("source"), F.col("id").alias("source_id"), "doi",
        F.col("primary_location.pdf_url").alias("pdf_url"), F.col("best_oa_location.pdf_url").alias("best_pdf_url"),
    )


def pdf_files(spark: SparkSession, path: str, most_bytes: int = 25 << 20, most_pages: int = 200) -> DataFrame:
    """path, length, content and problem (null, empty, too large, no PDF, encrypted, too many pages) of files; Spark leaves out empty ones."""
    return with_problems(spark.read.format("binaryFile").load(path), most_bytes, most_pages)


def with_problems(rows: DataFrame, most_bytes: int = 25 << 20, most_pages: int = 200) -> DataFrame:
    """The first problem of each file; only files of a good size and beginning are looked into."""
    simple = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "no PDF")
    rows = rows.select("path", "length", "content", simple.alias("simple"))
    inside = file_problem(F.when(F.col("simple").isNull(), F.col("content")), most_pages)
    return rows.select("path", "length", "content", F.coalesce("simple", inside).alias("problem"))


def extracted_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page_number, text of the files without a problem. extract: bytes to page texts; a file that it fails on has no pages."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    pages = extract(bytes(content))
                except ValueError:
                    pages = []
                rows += [(path, i + 1, text) for i, text in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    pages = files.filter(F.col("problem").isNull()).select("path", "content").mapInPandas(work, "path string, page_number int, text string")
    return pages.withColumn("text", T.clean_page_text(F.col("text")))


def append_chunks(chunks: DataFrame, path: str, batch: str | None = None) -> None:
    """Append chunks as a batch, dealt to folders by a hash of their paper, so that a paper's chunks are found in one."""
    tables.append(chunks, path, "paper_id", batch)


def read_chunks(spark: SparkSession, path: str, paper_id: int | None = None) -> DataFrame:
    """The chunks of committed batches, or those of one paper, of which only its bucket is read."""
    buckets = None if paper_id is None else tables.met(spark.range(1).select(F.lit(paper_id).cast("long").alias("paper_id")), "paper_id")
    rows = tables.read(spark, path, buckets).drop("batch", "bucket")
    return rows if paper_id is None else of_id(rows, paper_id, "paper_id")


def full_texts(pages: DataFrame) -> DataFrame:
    """path, n_pages, n_chars, full_text, title, authors of extracted pages: the pages with text joined by blank lines, and what the first page tells where a file's metadata is silent."""
    rows = pages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("xs"))
    texts = F.filter(F.transform("xs", lambda x: x["text"]), lambda t: T.strip(F.coalesce(t, F.lit(""))) != "")
    rows = rows.select("path", F.size("xs").cast("long").alias("n_pages"), F.array_join(texts, "\n\n").alias("full_text"), F.explode(F.array(T.page_lines(F.col("xs")[0]["text"]))).alias("lines"))
    title = T.title_line(F.col("lines"))
    return rows.select("path", "n_pages", F.length("full_text").cast("long").alias("n_chars"), "full_text", title.alias("title"), T.author_block(F.col("lines"), title).alias("authors"))


def newest_first(papers: DataFrame) -> DataFrame:
    return papers.orderBy(F.desc("id"))


def of_id(rows: DataFrame, value: int, column: str = "id") -> DataFrame:
    """The rows of one id; the comparison reaches the file scan."""
    return rows.filter(F.col(column) == F.lit(value))


def append_papers(papers: DataFrame, path: str, batch: str | None = None) -> None:
    tables.append(papers, path, "id", batch)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return tables.read(spark, path).drop("batch", "bucket")


def keys_path(papers_path: str) -> str:
    """Where the identity keys of a paper table's papers are stored, beside it."""
    return f"{papers_path.rstrip('/')}-keys"


def delete_duplicates(spark: SparkSession, papers_path: str, chunks_path: str, duplicates: DataFrame) -> tuple[int, int]:
    """Delete papers (id) that are duplicates, their chunks and their identity keys; the numbers of papers and chunks.

    The keys, which are dealt by key, go first: the deleted papers tell which they are.
    """
    gone = duplicates.select("id").distinct()
    papers = tables.read(spark, papers_path, tables.met(gone, "id"))
    if papers is not None and "doi" in papers.columns:
        held = saved(dedup.identity_keys(papers.join(gone, "id", "left_semi"), stored=True))
        tables.delete_pairs(spark, keys_path(papers_path), held, "key", "id")
    return tables.delete(spark, papers_path, gone, "id", "id"), tables.delete(spark, chunks_path, gone.withColumnRenamed("id", "paper_id"), "paper_id", "paper_id")
