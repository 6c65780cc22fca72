"""Intermediate tables in the folder that all executors share, and Python functions over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset, a folder beside the warehouse is set."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")
        base = context.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back.

    Unlike a cached table these files outlive an executor. They are removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factorloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, rows: Callable[[], Callable[..., Iterator[tuple]]], schema: StructType | str) -> DataFrame:
    """Apply a Python generator to each row, in Arrow batches.

    ``rows`` is called once per task and returns a function from the columns' values to result tuples, so it may set up
    caches. Results leave in slices, which bounds memory for long texts.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = rows()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                columns = [c.to_pylist() for c in batch.slice(start, SLICE).columns]
                out = [result for values in zip(*columns) for result in one(*values)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_slices(df: DataFrame, rows: Callable[[], Callable[..., tuple | None]], schema: StructType, slice_chars: int = 2_000_000) -> DataFrame:
    """As ``map_rows``, for functions that take the column lists of several rows and return one array per result column.

    A slice ends when its texts, the column ``text``, exceed ``slice_chars``, so memory stays bounded for long texts while
    short ones share each numpy call.
    """
    arrow, place = to_arrow_schema(schema), df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = rows()
        for batch in batches:
            sizes = np.cumsum([len(t) if t else 0 for t in batch.column(place).to_pylist()]) // slice_chars
            starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                if end > start:
                    out = several(*(c.to_pylist() for c in batch.slice(start, end - start).columns))
                    if out is not None and len(out[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def content_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hash of a row's ``doc_id`` and text: only repeated rows share it, so joins by it have no hot key.

    Joins compare ``doc_id`` as well, so equal hashes of different documents do no harm.
    """
    return F.xxhash64(F.col(doc_id), F.col(text), F.length(text)).alias("content_key")
