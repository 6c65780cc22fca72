"""Readers for raw exports (one file per symbol) and for the factor pool.

Reads are declarative scans of a directory with an explicit schema, so filters and
column selections reach the files; nothing is listed or opened by the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.functions.calendar import first_ten_characters_as_date
from factorloom.functions.frames import DATE, INSTRUMENT

def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def symbol_from_file_name(extension: str = "parquet") -> Column:
    """The file's base name, for directories that hold one file per symbol."""
    return F.regexp_extract(F.col("_metadata.file_name"), rf"(.+)\.{extension}$", 1)


#: Columns of one symbol's Parquet export.
SYMBOL_SCHEMA = T.StructType([T.StructField("date", T.StringType()), *_doubles("open", "high", "low", "close", "volume", "amount")])


def scan_symbol_files(
    spark: SparkSession, directory: str, start: str | None = None, end: str | None = None, schema: T.StructType = SYMBOL_SCHEMA
) -> DataFrame:
    """Scan per-symbol Parquet files; the instrument comes from the file name, dates filter the scan."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(directory)
    if start is not None:
        df = df.where(F.col("date") >= start)
    if end is not None:
        df = df.where(F.col("date") <= end)
    return df.withColumn(INSTRUMENT, symbol_from_file_name())


def with_export_date(df: DataFrame) -> DataFrame:
    """``date`` from ``bob`` or ``trade_date``, given as text or as a timestamp."""
    types = dict(df.dtypes)
    source = next(c for c in ("bob", "trade_date", "date") if c in types)
    parsed = (
        first_ten_characters_as_date(F.col(source)) if types[source] == "string" else F.to_date(F.col(source))
    )
    return df.withColumn("date", parsed).withColumn("symbol", F.col("symbol").cast("string"))


def scan_export_csv(spark: SparkSession, directory: str, fields: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Read per-symbol CSV files whose headers drift: order may differ and columns may be absent.

    A file's first line is its header. Each header says once where the fields stand, and this joins its rows on the file's path, so
    cells and whole lines may hold any text, the header's own included; every row splits its line once. Cells
    may be quoted, with commas and doubled quotes inside, but not with line ends. ``encoding`` may be one of Spark's, or any
    that extends ASCII and that Python knows, such as ``GBK``: such files are read byte by byte and decoded line by line.
    """
    first = _lines(spark, directory, encoding, False).where("block = 0")
    # Lines of a file's first block have rising numbers, so the smallest is its header.
    headers = first.groupBy("path").agg(F.min_by("line", "place").alias("header")).withColumn("names", _cells("header"))
    places = F.array(*(F.nullif(F.array_position("names", f), F.lit(0)).cast("int") for f in fields))
    rows = _lines(spark, directory, encoding, True).where(F.trim("line") != "").withColumn("cells", _cells("line"))
    placed = rows.select("path", "cells").join(headers.select("path", places.alias("places")), "path")
    cell = [F.nullif(F.try_element_at("cells", F.col("places")[i]), F.lit("")).alias(f) for i, f in enumerate(fields)]
    return placed.select(*cell)


def _lines(spark: SparkSession, directory: str, encoding: str, after_header: bool) -> DataFrame:
    """``line, path, block, place`` of text files; where asked for, without each file's first line, which Spark's reader skips."""
    native = encoding.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1")
    lines = (
        spark.read.option("encoding", encoding if native else "ISO-8859-1")
        .option("header", after_header)
        .option("sep", "\u0001")
        .option("quote", "")
        .schema("line string")
        .csv(directory)
        .select(
            "line",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    if native:
        return lines

    @F.pandas_udf(T.StringType())
    def decoded(line: pd.Series) -> pd.Series:
        return line.str.encode("latin-1").str.decode(encoding)

    return lines.withColumn("line", decoded("line"))


def _cells(line: str) -> Column:
    """The cells of a CSV line; only a line with quotes needs commas to be told apart."""
    quoted = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    cells = F.when(F.contains(F.col(line), F.lit('"')), quoted).otherwise(F.split(line, ",", -1))
    return F.transform(cells, lambda c: F.replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))


def read_factor_pool(spark: SparkSession, path: str) -> DataFrame:
    """Read the factor panel; a textual ``datetime`` becomes a timestamp."""
    df = spark.read.parquet(path)
    if dict(df.dtypes)[DATE] == "string":
        df = df.withColumn(DATE, F.to_timestamp(DATE))
    return df


def without_timezone(c: Column) -> Column:
    """Wall-clock timestamp without a time zone."""
    return c.cast("timestamp_ntz")
