"""Vector rules as Column functions over arrays of numbers, and a deterministic text embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 if a vector is empty or zero, or the lengths differ."""
    same = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(same, let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


def unit_similarity(a: Column, b: Column) -> Column:
    """The inner product of unit vectors, within 0 and 1; lengths that differ are an error."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))
    return F.when(F.size(a) == F.size(b), held).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def hashed_vectors(tokens: pa.Array, dimensions: int = 64) -> np.ndarray:
    """Unit vectors of token counts by md5 bucket, one for each list of tokens; each distinct token is hashed once."""
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    flat = tokens.flatten().dictionary_encode()
    digests = b"".join([hashlib.md5(t.encode()).digest() for t in flat.dictionary.to_numpy(zero_copy_only=False)])
    bucket = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % dimensions  # of the first 32 bits
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(np.arange(len(sizes)), sizes) * dimensions + (bucket[flat.indices.to_numpy()] if len(bucket) else np.zeros(0, np.int64))
    return unit_rows(np.bincount(place, minlength=len(sizes) * dimensions).astype(float).reshape(len(sizes), dimensions))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n > 0, n, 1)


#: Texts of a batch that an Arrow function has as Python objects at once.
SLICE = 256


def sliced(work: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """work, called on SLICE rows of a batch at a time, so that its objects do not grow with the batch."""
    return lambda column: pa.concat_arrays([work(column.slice(at, SLICE)) for at in range(0, max(1, len(column)), SLICE)])


def lists_of(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), pa.float64()))


def hashed_embedding(tokens: Column, dimensions: int = 64) -> Column:
    """A unit vector of token counts by md5 bucket: the embedding that needs no model. tokens: an array of strings without blanks, which go to an Arrow function as one string."""

    def work(column: pa.Array) -> pa.Array:
        lists = pc.split_pattern(column, " ")
        some = pc.if_else(pc.equal(column, ""), pa.scalar([], lists.type), lists)
        return lists_of(hashed_vectors(some, dimensions))

    return F.arrow_udf(work, "array<double>")(F.array_join(tokens, " "))


def model_embedding(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Column:
    """Unit vectors of texts by a model: load() gives a function from a list of texts to a matrix, and is called once in a task. A null or blank text has a null vector."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            texts = batch.to_pylist()
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            found = unit_rows(np.asarray(model([texts[i] for i in some]), float)).tolist() if some else []
            out = dict(zip(some, found, strict=True))
            yield pa.array([out.get(i) for i in range(len(texts))], pa.list_(pa.float64()))

    return F.arrow_udf(work, "array<double>", ArrowUDFType.SCALAR_ITER)(text)


def hybrid_score(similarity: Column, keywords: Column) -> Column:
    return similarity * 0.8 + keywords * 0.2
