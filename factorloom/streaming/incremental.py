"""Incremental bars as a stream: every row is checked against the stored table, however late it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from factorloom.operators.ingest import keep_first


def read_bars(
    spark: SparkSession, directory: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream the Parquet files appearing in a directory and below it."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def stored_rows(spark: SparkSession, table_dir: str, schema: T.StructType) -> DataFrame:
    """The batches stored so far, with their number ``batch``; none at first."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], with_batch)
    return spark.read.schema(with_batch).parquet(table_dir)


def new_rows(batch: DataFrame, batch_id: int, table_dir: str, keys: Sequence[str], time: str) -> DataFrame:
    """The first row of each key in the batch whose key no earlier batch has stored."""
    first = keep_first(batch, keys, [time, *sorted(c for c in batch.columns if c not in (*keys, time))])
    known = stored_rows(batch.sparkSession, table_dir, batch.schema).where(F.col("batch") < batch_id)
    return first.join(known.select(*keys), list(keys), "left_anti").select(*batch.columns)


def write_first_arrivals(
    stream: DataFrame, table_dir: str, checkpoint: str, keys: Sequence[str], time: str, coverage_dir: str | None = None, key: str | None = None
) -> DataStreamWriter:
    """Append the rows with new keys to a table, and on demand their last time and count per ``key`` to a coverage table.

    There is no watermark: a row of any age is stored if its key is new, and no state is held outside the table. Batch
    directories carry the batch's number, so a batch that is retried after a failure replaces its own output and is compared
    with earlier batches only.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = f"{table_dir}/batch={batch_id}"
        new_rows(batch, batch_id, table_dir, keys, time).write.mode("overwrite").parquet(mine)
        if coverage_dir:
            last = spark.read.schema(batch.schema).parquet(mine).groupBy(key)
            last = last.agg(F.max(time).alias("last_time"), F.count(F.lit(1)).alias("n_events"))
            last.write.mode("overwrite").parquet(f"{coverage_dir}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)


def coverage(spark: SparkSession, coverage_dir: str, key: str) -> DataFrame:
    """Last time and row count per key over all batches."""
    batches = spark.read.parquet(coverage_dir).groupBy(key)
    return batches.agg(F.max("last_time").alias("last_time"), F.sum("n_events").alias("n_events"))
