"""Point-in-time statements: cleaning, combining and the backward as-of join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.ingest import keep_first

# Statement keys.
KEYS = ("symbol", "pub_date", "rpt_date")
TEXT_KEYS = ("rpt_type", "data_type")


def typed_statement(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keys as text and dates, ``fields`` as doubles; an absent or unreadable field is null."""
    keys = [
        F.col("symbol").cast("string").alias("symbol"),
        *[F.to_date(F.col(c)).alias(c) for c in ("pub_date", "rpt_date") if c in df.columns],
        *[c for c in TEXT_KEYS if c in df.columns],
    ]
    values = [
        (F.col(f).try_cast("double") if f in df.columns else F.lit(None).cast("double")).alias(f) for f in fields
    ]
    return df.select(*keys, *values)


def deduplicated(statement: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: the smallest by the remaining columns, so that reruns agree."""
    return keep_first(statement, keys, sorted(c for c in statement.columns if c not in keys))


def full_outer(statements: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Full outer join on the keys; a column already present is taken from the earlier statement."""

    def combine(left: DataFrame, right: DataFrame) -> DataFrame:
        repeated = [c for c in right.columns if c in left.columns and c not in keys]
        return left.join(right.drop(*repeated), list(keys), "full")

    return reduce(combine, statements)


def stacked(statements: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """All statements below each other, tagged ``_source``, one row per key and source."""
    tagged = [df.withColumn("_source", F.lit(name)) for name, df in statements.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return deduplicated(union, (*keys, "_source"))


def merged_field_batches(batches: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Outer merge of field batches fetched separately for the same keys.

    One union and one aggregation instead of a chain of joins.
    """
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
    values = [c for c in union.columns if c not in keys]
    return union.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def as_of_join(
    spine: DataFrame,
    statements: DataFrame,
    by: str = "symbol",
    date: str = "date",
    published: str = "pub_date",
    period: Column | str = "year",
) -> DataFrame:
    """Each spine row with the latest statement published on or before its date.

    Of statements published on the same day the latest ``rpt_date`` (or, without one, the
    largest remaining columns) wins.

    Both sides are merged into one ordered sequence per symbol, and the last statement seen is
    carried along. A symbol is cut into calendar periods (``period`` as in ``trunc``), and each
    period starts from the last statement of the earlier ones, so a symbol with a long history
    is spread over many tasks.
    """
    fields = [c for c in statements.columns if c != by]
    tie = [c for c in ("rpt_date",) if c in fields] + sorted(c for c in fields if c not in ("rpt_date", published))
    payload = F.struct(*fields)
    bucket = lambda c: F.trunc(c, period)

    right = keep_latest(statements.withColumn("_at", F.col(published)), by, "_at", tie, payload)
    right = right.withColumn("_bucket", bucket(F.col("_at")))
    left = spine.withColumn("_at", F.to_date(F.col(date))).withColumn("_bucket", bucket(F.col("_at")))

    # One row per symbol and period: the statement in force when the period starts.
    last = right.groupBy(by, "_bucket").agg(F.max_by("_payload", "_at").alias("_last"))
    needed = left.select(by, "_bucket").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
    steps = last.unionByName(needed).groupBy(by, "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    opening = steps.withColumn("_payload", F.last("_last", ignorenulls=True).over(earlier)).where(
        F.col("_payload").isNotNull()
    )

    sequence = (
        left.select("*", F.lit(2).alias("_side"))
        .unionByName(right.select(by, "_bucket", "_at", "_payload", F.lit(1).alias("_side")), allowMissingColumns=True)
        .unionByName(
            opening.select(by, "_bucket", F.col("_bucket").alias("_at"), "_payload", F.lit(0).alias("_side")),
            allowMissingColumns=True,
        )
    )
    so_far = (
        Window.partitionBy(by, "_bucket")
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = sequence.withColumn("_match", F.last("_payload", ignorenulls=True).over(so_far))
    return matched.where(F.col("_side") == 2).select(*spine.columns, "_match.*")


def keep_latest(statements: DataFrame, by: str, at: str, tie: Sequence[str], payload: Column) -> DataFrame:
    """One ``_payload`` per symbol and publication day, the largest by ``tie``."""
    return statements.groupBy(by, at).agg(F.max_by(payload, F.struct(*tie)).alias("_payload"))
