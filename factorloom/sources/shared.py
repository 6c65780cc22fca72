"""Folders and tables for intermediate data that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, or else beside its warehouse; removed when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    folder = f"{base.rstrip('/')}/factorloom-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


#: Whether shuffle files go when the query that made them ends, instead of at some later garbage collection of the driver.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write the rows to a shared folder and read them back: later uses neither compute them again nor lose them with an executor.

    The shuffles that made the rows leave the disks once these are written.
    """
    spark = df.sparkSession
    folder, before = shared_folder(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(f"{folder}/rows", compression=compression)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
