"""Written steps: tables that several jobs need, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder for written steps: spark.checkpoint.dir. Only a local master, whose executors share the machine's disk, may do without."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/steps-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here, and a lost executor costs no earlier step.

    by: a column of few values whose every value has a folder, so that a filter on it reads no others. The folder is the application's own (steps-<application id>); clear() ends it once no result is read any more.
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of fewer bytes may lie in one block of one file, so that a scan would keep one core busy.
SMALL_TABLE = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table just read, dealt to all cores by a key and put in its order there if it is small, so that what depends on the order of rows can be repeated; a large one has blocks enough and stays as it is."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL_TABLE:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key)


def clear(spark: SparkSession) -> None:
    """Delete all written steps of this application. DataFrames that read them cannot be computed afterwards."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
