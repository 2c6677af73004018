"""Documents to chunks: sentence-aware chunks with overlap, and windows of words."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.vectors import sliced


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])", re.ASCII)


def cut_places(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of sentences of these lengths, as (first, after the last): whole sentences of at most size characters, or one longer one.

    A chunk begins with the last sentences of the one before that fit into overlap, spaces between them counted.
    """
    out, first, chars = [], 0, 0
    for at, n in enumerate(lengths):
        if at > first and chars + n + 1 > size:
            out.append((first, at))
            first, chars = at, 0
            while first > out[-1][0] and chars + lengths[first - 1] <= overlap:
                first -= 1
                chars += lengths[first] + 1
        chars += n + 1
    return out + [(first, len(lengths))] if len(lengths) > first else out


def packed(clean: Column, size: int = 1200, overlap: int = 200, keep_noise: bool = False) -> Column:
    """The chunks of a cleaned text (see text.clean_chunk_text) without noise, as an array: an Arrow function, as the fold over sentences would be interpreted element by element otherwise."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def chunks_of(text: str | None) -> list[str]:
        own = [s for s in map(str.strip, _SENTENCE.split(text)) if s] if text else []
        found = [" ".join(own[i:j]) for i, j in cut_places([len(s) for s in own], size, overlap)]
        return found if keep_noise else [t for t in found if not T.noise(t)]

    def work(column: pa.Array) -> pa.Array:
        return pa.array([chunks_of(x) for x in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(sliced(work), "array<string>")(clean)


def chunked(pages: DataFrame, id_column: str = "paper_id", text_column: str = "text", page_column: str | None = None, size: int = 1200, overlap: int = 200, keep_noise: bool = False, passing: tuple[str, ...] = ()) -> DataFrame:
    """paper_id, chunk_id (from 1, of the kept chunks of a paper), page_number, text, and the columns passing. Chunks that are noise are left out. Null and blank texts have no chunks. Without page_column each row is a paper of its own."""
    page = F.col(page_column) if page_column else F.lit(1)
    rows = pages.select(F.col(id_column).alias("paper_id"), page.cast("int").alias("page_number"), *passing, packed(T.clean_chunk_text(F.col(text_column)), size, overlap, keep_noise).alias("texts"))
    rows = rows.select("paper_id", "page_number", *passing, F.posexplode("texts").alias("at", "text"))
    if keep_noise:
        rows = rows.withColumn("noise", T.low_quality(F.col("text")))
    if page_column or keep_noise:
        number = F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", "at"))
    else:
        number = F.col("at") + 1  # a paper is one row, so its chunks are counted where they are made
    return rows.select("paper_id", number.cast("long").alias("chunk_id"), "page_number", "text", *passing, *(["noise"] if keep_noise else []))


def word_windows(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 700, overlap: int = 100) -> DataFrame:
    """id, window (from 0), n_words, text of windows of words; the last is the first that reaches the end."""
    step = size - overlap
    split = documents.select(F.col(id_column), F.explode(F.array(T.words(F.col(text_column)))).alias("w")).filter(F.size("w") > 0)
    count = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int")
    rows = split.select(id_column, F.posexplode(F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(F.col("w"), i * step + 1, F.lit(size)))).alias("window", "own"))
    return rows.select(id_column, F.col("window").cast("long").alias("window"), F.size("own").cast("long").alias("n_words"), F.array_join("own", " ").alias("text"))


def embedding_queue(chunks: DataFrame, text_column: str = "text", vector: str = "embedding") -> DataFrame:
    """waiting, blank, done: chunks that want an embedding, those without text, which never get one, and those that have one."""
    has = T.strip(F.coalesce(F.col(text_column), F.lit(""))) != ""
    none = F.col(vector).isNull()
    return chunks.agg(F.count_if(none & has).alias("waiting"), F.count_if(none & ~has).alias("blank"), F.count_if(~none).alias("done"))


def filled(chunks: DataFrame, embed: Callable[[Column], Column], text_column: str = "text", vector: str = "embedding") -> DataFrame:
    """chunks with embeddings for those that have a text and none yet; embed: a Column function of a text, such as vectors.model_embedding. Others stay as they are, and so do rows on which the model gives null."""
    wants = F.col(vector).isNull() & (T.strip(F.coalesce(F.col(text_column), F.lit(""))) != "")
    own = chunks.withColumn("__text", F.when(wants, F.col(text_column)))
    return own.withColumn(vector, F.coalesce(vector, embed(F.col("__text")))).drop("__text")
