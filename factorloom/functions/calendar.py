"""Date grids: shifts by calendar position instead of by an instrument's own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.frames import DATE


def date_index(df: DataFrame, date: str = DATE, index: str = "date_idx") -> DataFrame:
    """The distinct dates numbered from 0.

    One row per date, so the single ordered window is bounded by the calendar.
    """
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    return dates.withColumn(index, F.row_number().over(Window.orderBy(date)).cast("bigint") - 1)


def join_dates(df: DataFrame, per_date: DataFrame, date: str = DATE, how: str = "inner") -> DataFrame:
    """Join a table that has one row per date.

    With a ``date`` key it is broadcast: the type allows four million days, a few dozen
    megabytes at most, and rows need not move. Timestamps have no such bound, so there the
    strategy is left to the optimizer.
    """
    small = F.broadcast(per_date) if dict(per_date.dtypes)[date] == "date" else per_date
    return df.join(small, date, how)


def with_date_index(df: DataFrame, date: str = DATE, index: str = "date_idx") -> DataFrame:
    """Attach the position of each row's date in the table's own calendar."""
    return join_dates(df, date_index(df, date, index), date)


def month_end_dates(df: DataFrame, date: str = DATE, period: str = "month") -> DataFrame:
    """Last available date of each calendar period."""
    return df.groupBy(F.trunc(date, period).alias("period")).agg(F.max(date).alias(date)).select(date)


def first_ten_characters_as_date(c: Column) -> Column:
    """Date from a timestamp string such as ``2024-01-02 00:00:00+08:00``."""
    return F.to_date(F.substring(c, 1, 10))
