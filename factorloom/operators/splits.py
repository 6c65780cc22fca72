"""Time splits: purged train/validation/test ranges and walk-forward windows.

Split arithmetic runs on the distinct dates, gathered into one array: a calendar, not data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.frames import DATE, INSTRUMENT

# Trading days per month on short calendars, and the minimum months before
# the first step of an expanding window.
SHORT_CALENDAR = 30
DAYS_PER_MONTH = 21
MIN_EXPANDING_MONTHS = 3


def calendar_array(panel: DataFrame) -> DataFrame:
    """One row: ``dates`` ascending and their number ``n``."""
    dates = panel.select(F.to_date(DATE).alias(DATE)).distinct().agg(F.sort_array(F.collect_list(DATE)).alias("dates"))
    return dates.withColumn("n", F.size("dates"))


def _at(index: Column) -> Column:
    return F.element_at("dates", (index + 1).cast("int"))


def static_splits(
    panel: DataFrame, horizon: int, train: tuple[str, str], val: tuple[str, str], test: tuple[str, str | None], purge: bool = True
) -> DataFrame:
    """``(split, start, end)``; train and validation end ``horizon`` calendar dates early, so labels do not overlap."""

    def purged(end: str) -> Column:
        day = F.lit(end).cast("date")
        if not purge:
            return day
        known = F.size(F.filter("dates", lambda d: d <= day))
        return F.when(known == 0, day).otherwise(_at(F.greatest(known - 1 - horizon, F.lit(0))))

    rows = [
        F.struct(F.lit("train").alias("split"), F.lit(train[0]).cast("date").alias("start"), purged(train[1]).alias("end")),
        F.struct(F.lit("val").alias("split"), F.lit(val[0]).cast("date").alias("start"), purged(val[1]).alias("end")),
        F.struct(F.lit("test").alias("split"), F.lit(test[0]).cast("date").alias("start"), F.lit(test[1]).cast("date").alias("end")),
    ]
    return calendar_array(panel).select(F.inline(F.array(*rows)))


def walk_forward_windows(
    panel: DataFrame,
    start: str,
    step_months: int = 3,
    val_months: int = 3,
    train_months: int = 12,
    embargo: int = 5,
    mode: str = "expanding",
) -> DataFrame:
    """``(window_id, train_start, train_end, val_start, val_end, oos_start, oos_end)``.

    Months become dates by the calendar's own density. Training starts at the last date on or
    before ``start``.
    """
    n = F.col("n")
    span = F.date_diff(_at(n - 1), _at(F.lit(0)))
    density = F.when(span > 0, n / span * 30).otherwise(F.lit(float(DAYS_PER_MONTH)))

    def days(months: int) -> Column:
        dense = F.greatest(F.lit(1), F.floor(months * F.col("_density")).cast("int"))
        return F.when(n < SHORT_CALENDAR, months * DAYS_PER_MONTH).otherwise(dense)

    first_months = train_months if mode == "rolling" else MIN_EXPANDING_MONTHS
    plan = (
        calendar_array(panel)
        .withColumn("_density", density)
        .withColumns(
            {
                "_step": days(step_months),
                "_val": days(val_months),
                "_start": F.greatest(
                    F.size(F.filter("dates", lambda d: d <= F.lit(start).cast("date"))) - 1, F.lit(0)
                ),
                "_train": days(train_months),
                "_first": days(first_months),
            }
        )
        .withColumn("_first_end", F.least(F.col("_start") + F.col("_first"), n - 1))
        .withColumn("window_id", F.explode(F.sequence(F.lit(0), F.floor(n / F.col("_step")).cast("int"))))
        .withColumn("_train_end", F.col("_first_end") + F.col("window_id") * F.col("_step"))
    )
    train_start = (
        F.greatest(F.col("_start"), F.col("_train_end") - F.col("_train")) if mode == "rolling" else F.col("_start")
    )
    steps = (
        plan.withColumn("_train_start", train_start)
        .withColumn("_val_start", F.col("_train_end") + embargo)
        .withColumn("_val_end", F.least(F.col("_val_start") + F.col("_val"), n - 1))
        .withColumn("_oos_start", F.col("_val_end") + 1)
        .withColumn("_oos_end", F.least(F.col("_oos_start") + F.col("_step") - 1, n - 1))
        .where((F.col("window_id") == 0) | (F.col("_train_end") < n - F.col("_val") - embargo))
        .where((F.col("_val_start") < n) & (F.col("_oos_start") < n))
    )
    edges = ("train_start", "train_end", "val_start", "val_end", "oos_start", "oos_end")
    return steps.select(F.col("window_id").cast("bigint").alias("window_id"), *[_at(F.col(f"_{e}")).alias(e) for e in edges])


def window_dates(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """``(window_id, role, datetime)``: every calendar date of each window's ranges."""
    if dict(panel.dtypes)[DATE] != "date":
        raise TypeError("windows are ranges of dates: cast the panel's datetime to a date first")
    dates = panel.select(DATE).distinct().agg(F.collect_list(DATE)).scalar()
    roles = windows.select(
        "window_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r).alias("role"), F.col(f"{r}_start").alias("_from"), F.col(f"{r}_end").alias("_to"))
                    for r in ("train", "val", "oos")
                ]
            )
        ),
    )
    inside = F.filter("_dates", lambda d: (F.to_date(d) >= F.col("_from")) & (F.to_date(d) <= F.col("_to")))
    return roles.withColumn("_dates", dates).select("window_id", "role", F.explode(inside).alias(DATE))


def window_rows(panel: DataFrame, windows: DataFrame, label: str) -> DataFrame:
    """Labelled rows of each window, tagged with window and role.

    Membership is resolved on dates first, so rows join on equality of the date, with a table of dates that is broadcast.
    """
    return panel.where(F.col(label).isNotNull()).join(F.broadcast(window_dates(panel, windows)), DATE)


def concatenated_signals(predictions: DataFrame, value: str | Sequence[str] = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Out-of-sample predictions of all windows (per model ``by``, or in a column for each); where windows overlap the latest one wins."""
    values, keys = [value] if isinstance(value, str) else list(value), [*by, DATE, INSTRUMENT]
    # Dealt before they are aggregated: windows hardly overlap, so partial results of a task would be as large as its rows.
    return predictions.repartition(*keys).groupBy(*keys).agg(*[F.max_by(v, "window_id").alias(v) for v in values])
