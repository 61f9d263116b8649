"""Parquet tables of a folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def split_bytes(spark: SparkSession) -> int:
    """What one task reads at most, as the session has it."""
    jvm = spark.sparkContext._jvm
    return int(jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table that fits into one split, which a single task would read and work on.

    Larger tables come in splits of their own and are left as they lie, so nothing large is shuffled.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and size <= split_bytes(spark) else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; it goes when the driver's Python ends."""
    from skerry.operators.graph import _shared

    _shared(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may be stopped by then
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)
    return folder
