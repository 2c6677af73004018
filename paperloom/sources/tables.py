"""Stored tables in folders batch=.../bucket=...: appends that may run again, reads of some buckets, deletes where the rows are.

A batch is written while its mark lies in the table's folder _pending, and readers leave out marked batches; taking the mark
away is what commits. A batch that is appended again under its name replaces what it left before.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.steps import saved

#: Folders that a batch's rows are dealt to by a hash of the table's key.
BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def batch_name(name: object = None) -> str:
    """The folder name of a batch: of its number or name, or a new one."""
    return f"b-{uuid.uuid4().hex if name is None else name}"


def _path(spark: SparkSession, *parts: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def pending(spark: SparkSession, path: str) -> list[str]:
    """Names of batches that are being written, or were when their writer failed."""
    files, at = _path(spark, path, "_pending")
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def begin(spark: SparkSession, path: str, batch: str) -> None:
    """Mark a batch, and take away what an earlier try has left of it."""
    files, at = _path(spark, path, "_pending", batch)
    files.create(at, True).close()
    files, at = _path(spark, path, f"batch={batch}")
    files.delete(at, True)


def commit(spark: SparkSession, path: str, batch: str) -> None:
    files, at = _path(spark, path, "_pending", batch)
    files.delete(at, False)


def write(rows: DataFrame, path: str, key: str, batch: str, buckets: int = BUCKETS, order: str | None = None) -> None:
    """The rows of a batch, marked until commit() is called. Files of a bucket grow and split with its rows. order: a column whose order the rows of a file have."""
    begin(rows.sparkSession, path, batch)
    dealt = rows.withColumn("batch", F.lit(batch)).withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket")
    (dealt.sortWithinPartitions("batch", "bucket", order) if order else dealt).write.mode("append").partitionBy("batch", "bucket").parquet(path)


def append(rows: DataFrame, path: str, key: str, batch: str | None = None, buckets: int = BUCKETS, order: str | None = None) -> None:
    """Append rows as one committed batch; see write()."""
    batch = batch or batch_name()
    write(rows, path, key, batch, buckets, order)
    commit(rows.sparkSession, path, batch)


def read(spark: SparkSession, path: str, buckets: Collection[int] | None = None, without: str | None = None) -> DataFrame | None:
    """The committed rows with batch and bucket, of some buckets only, and without one batch; None if there is no table yet."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None
    hidden = [*pending(spark, path), *([without] if without else [])]
    rows = rows.filter(~F.col("batch").isin(hidden)) if hidden else rows
    return rows if buckets is None else rows.filter(F.col("bucket").isin(sorted(buckets)))


def met(rows: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """The buckets that the keys of these rows are in."""
    return [r["bucket"] for r in rows.select(bucket_of(F.col(key), buckets).alias("bucket")).distinct().collect()]


def delete(spark: SparkSession, path: str, gone: DataFrame, column: str, key: str, buckets: int = BUCKETS) -> int:
    """Take out the rows whose column is among gone's; how many they were. key: what the table is dealt by.

    Only folders that hold such rows are written anew, by dynamic partition overwrite, from rows that have been written to
    the shared folder first; where nothing is left the folder goes. All other folders keep their files. Run again after a
    failure, it ends what is left to do.
    """
    ids = gone.select(column).filter(F.col(column).isNotNull()).distinct()
    return _without(spark, path, read(spark, path, met(ids, column, buckets) if key == column else None), ids, [column])


def delete_pairs(spark: SparkSession, path: str, gone: DataFrame, key: str, column: str, buckets: int = BUCKETS) -> int:
    """Take out the rows whose key (what the table is dealt by) and column are a pair of gone's; how many they were. Only the keys' buckets are read."""
    return _without(spark, path, read(spark, path, met(gone, key, buckets)), gone.select(key, column).distinct(), [key, column])


def _without(spark: SparkSession, path: str, rows: DataFrame | None, ids: DataFrame, on: list[str]) -> int:
    if rows is None:
        return 0
    folder = F.concat_ws("/", "batch", "bucket")
    counts = {r["at"]: r["count"] for r in rows.join(ids, on, "left_semi").groupBy(folder.alias("at")).count().collect()}
    if counts:
        kept = saved(rows.filter(folder.isin(list(counts))).join(ids, on, "left_anti"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)
        left = {r["at"] for r in kept.select(folder.alias("at")).distinct().collect()}
        for at in counts.keys() - left:
            batch, bucket = at.split("/")
            files, old = _path(spark, path, f"batch={batch}", f"bucket={bucket}")
            files.delete(old, True)
    return sum(counts.values())
