"""Market inputs derived from the star-schema tables (the mapping is described in FIXTURES.md).

A supplier is an instrument, a month is a bar, and the unit price of its order lines is the
price. Every derivation is an aggregation with map-side partial results, so a supplier or a
user holding a large share of the raw rows shrinks to one row per period before the shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.calendar import with_date_index
from factorloom.functions.numeric import round_double


def _line_order() -> Column:
    """The order of lines in one number: day, order, line, part (11 digits) and price in cents (8 digits).

    A primitive order lets bars be aggregated by hash, without sorting the raw lines first. Each half is whole-number
    arithmetic: digits put together as text cost more than the rest of the aggregate.
    """
    keys = {c: F.col(c).cast("bigint") for c in ("l_orderkey", "l_linenumber", "l_partkey")}
    day = (F.unix_date(F.to_date("l_shipdate")) + 100_000).cast("bigint")
    cents = round_double(F.col("l_extendedprice") * 100, 0).cast("bigint")
    line = (day * 10**12 + keys["l_orderkey"]) * 10 + keys["l_linenumber"]
    rest = keys["l_partkey"] * 10**8 + cents
    whole = "decimal(19,0)"
    return (line.cast(whole) * F.lit(Decimal(10**19)) + rest.cast(whole)).cast("decimal(38,0)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _monthly(lines: DataFrame, instrument: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    priced = lines.select(
        F.col(instrument).cast("bigint").alias("instrument"),
        F.to_date(F.trunc("l_shipdate", "month")).alias("datetime"),
        price.alias("price"),
        _line_order().alias("line"),
        "l_quantity",
        "l_extendedprice",
    )
    return priced.groupBy("instrument", "datetime").agg(
        F.min_by("price", "line").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "line").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars per instrument: open, high, low, close, volume, amount."""
    return _monthly(table(spark, sf_dir, "lineitem"), "l_suppkey")


def basket_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars per nation: the fixed, short asset list of the rotation study."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return _monthly(lines, "s_nationkey")


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(instrument, datetime, close)`` only."""
    return bars(spark, sf_dir).select("instrument", "datetime", "close")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(instrument, datetime, price)`` on a log scale: unit prices jump too much to be compounded."""
    return bars(spark, sf_dir).select("instrument", "datetime", (F.log("close") + 10).alias("price"))


def _quarterly(spark: SparkSession, sf_dir: str):
    quarter = F.to_date(F.trunc("l_shipdate", "quarter"))
    report = F.date_sub(F.add_months(quarter, 3), 1)
    return table(spark, sf_dir, "lineitem").withColumn("rpt_date", report).withColumnRenamed("l_suppkey", "symbol")


def income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statement, published 45 days after the quarter's end."""
    return (
        _quarterly(spark, sf_dir)
        .groupBy("symbol", "rpt_date")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net_prof"))
        .select("symbol", F.date_add("rpt_date", 45).alias("pub_date"), "rpt_date", "net_prof")
    )


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second statement on the same keys; quarters without returned lines are absent."""
    return (
        _quarterly(spark, sf_dir)
        .where(F.col("l_returnflag") == "A")
        .groupBy("symbol", "rpt_date")
        .agg(F.sum("l_quantity").alias("ttl_ast"))
        .select("symbol", F.date_add("rpt_date", 45).alias("pub_date"), "rpt_date", "ttl_ast")
    )


def supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily category that exists only on every other date of the calendar."""
    indexed = with_date_index(bars(spark, sf_dir))
    return indexed.where(F.col("date_idx") % 2 == 0).select(
        "instrument", "datetime", (F.col("volume") / F.col("amount")).alias("turnrate")
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .where(F.col("s_acctbal") > 0)
        .select(F.col("s_suppkey").alias("instrument"))
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument to group: the supplier's region."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("instrument"), F.col("n_regionkey").alias("group"))
    )


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event value per user, with natural gaps."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("date"))
        .agg(F.round(F.sum("value"), 2).alias("value"))
    )
