"""Writers. Tables are laid out by year, so date ranges prune files, and sorted by instrument inside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.frames import DATE, INSTRUMENT
from factorloom.sources.shared import stored


def write_by_year(df: DataFrame, path: str, date: str = DATE, key: str = INSTRUMENT) -> None:
    """Partitioned by year; adaptive execution splits a large year and joins small ones, so files follow the data's size."""
    (
        df.withColumn("year", F.year(date))
        .hint("rebalance", "year")
        .sortWithinPartitions("year", key, date)
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def upsert_by_year(increment: DataFrame, path: str, keys: Sequence[str] = (INSTRUMENT, DATE), date: str = DATE, key: str = INSTRUMENT) -> None:
    """Merge rows into a table of ``write_by_year``: a row replaces the stored one of its keys, or is added.

    Only the years that occur in the increment are read and written again; the others' files are untouched. All tasks have written
    before the commit puts new files in the place of a year's old ones, and merging an increment again changes nothing, so a call
    that failed earlier may be repeated. The commit itself moves one year after the other: a driver lost in that moment can leave
    a year without its files, as with any overwrite of plain directories.
    ``increment`` has one row per key, no missing key or date, and the table's columns.
    """
    spark, keys = increment.sparkSession, list(keys)
    fresh = stored(increment.withColumn("year", F.year(date)), "increment")
    years = sorted(r.year for r in fresh.select("year").distinct().collect())
    kept = spark.read.parquet(path).where(F.col("year").isin(years)).join(fresh.select(*keys), keys, "left_anti")
    merged = stored(kept.unionByName(fresh), "merged")
    ordered = merged.hint("rebalance", "year").sortWithinPartitions("year", key, date)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_by_instrument(df: DataFrame, table: str, buckets: int, key: str = INSTRUMENT, order: str = DATE) -> None:
    """One table bucketed and sorted by instrument: later history windows and key joins need no shuffle.

    Replaces one file per symbol, which does not scale in the number of symbols.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).format("parquet").saveAsTable(table)


def write_factor_pool(df: DataFrame, path: str) -> DataFrame:
    """Write the factor panel and return its one-row summary, read back from the written files."""
    write_by_year(df, path)
    return pool_summary(df.sparkSession.read.parquet(path).drop("year"))


def pool_summary(pool: DataFrame) -> DataFrame:
    """Row, symbol, factor and label counts with the date range."""
    labels = [c for c in pool.columns if c.startswith("label")]
    factors = [c for c in pool.columns if c not in (DATE, INSTRUMENT, "close") and c not in labels]
    return pool.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(INSTRUMENT).alias("n_symbols"),
        F.lit(len(factors)).cast("bigint").alias("n_factors"),
        F.lit(len(labels)).cast("bigint").alias("n_labels"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
    )


def write_filtered_pool(pool: DataFrame, factors: list[str], path: str) -> None:
    """Keys, the surviving factors and all labels."""
    labels = [c for c in pool.columns if c.startswith("label")]
    write_by_year(pool.select(DATE, INSTRUMENT, *factors, *labels), path)


def write_tables(tables: dict[str, DataFrame], directory: str) -> None:
    """One Parquet directory per named result table (tear-sheet output)."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{directory}/{name}")
