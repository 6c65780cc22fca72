"""Daily table assembly: supplements, de-duplication, forward fill, coverage and universe."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.calendar import date_index, join_dates
from factorloom.functions.frames import DATE, INSTRUMENT, so_far
from factorloom.functions.numeric import div
from factorloom.functions.ranks import group_quantiles
from factorloom.operators.scans import last_known, running

# Price and volume columns, which are never filled forward.
NEVER_FILLED = ("open", "high", "low", "close", "volume", "amount", "pre_close")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate, not a row number: duplicates of a hot key shrink before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def with_supplements(
    spine: DataFrame, supplements: Iterable[DataFrame], on: Sequence[str] = (INSTRUMENT, DATE)
) -> DataFrame:
    """Left-join each supplement on instrument and date."""
    return reduce(lambda left, right: left.join(right, list(on), "left"), supplements, spine)


def available(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The keys and those of ``fields`` the table has, as doubles."""
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields if f in df.columns])


def with_adjustment_factor(spine: DataFrame, factors: DataFrame, on: Sequence[str] = (INSTRUMENT, DATE)) -> DataFrame:
    """``factor`` from the adjustment table's ``adj_factor_fwd``, 1.0 where there is none."""
    joined = spine.join(factors, list(on), "left")
    return joined.withColumn("factor", F.coalesce("adj_factor_fwd", F.lit(1.0)))


def adjusted_prices(df: DataFrame, columns: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices times the adjustment factor, and whether the bar is usable (positive prices and volume)."""
    valid = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in [*columns, "volume"]])
    return df.withColumns({**{f"adj_{c}": F.col(c) * F.col("factor") for c in columns}, "is_valid_bar": valid})


def forward_fill(
    df: DataFrame,
    columns: Iterable[str],
    key: str = INSTRUMENT,
    date: str = DATE,
    limit: int | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Carry the last known value forward, over at most ``limit`` rows if given.

    ``df`` has one row per key and date, so a key's window is bounded by the calendar. For longer histories ``block``, a
    non-decreasing function of the date, splits an unlimited fill into blocks with the same result.
    """
    if block is not None and limit is None:
        return running(df, {c: last_known(c, date) for c in columns}, [key], date, block)
    spec = Window.partitionBy(key).orderBy(date)
    frame = so_far(spec) if limit is None else spec.rowsBetween(-limit, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in columns})


def assemble_daily(
    spine: DataFrame, supplements: Iterable[DataFrame], key: str = INSTRUMENT, date: str = DATE
) -> DataFrame:
    """Spine with supplements, low-frequency fields carried forward, one row per key and date."""
    wide = with_supplements(spine, supplements, (key, date))
    filled = [c for c in wide.columns if c not in (key, date, *NEVER_FILLED)]
    wide = keep_first(wide, [key, date], [c for c in wide.columns if c not in (key, date)])
    return forward_fill(wide, filled, key, date)


def on_calendar_grid(df: DataFrame, key: str = INSTRUMENT, date: str = DATE) -> DataFrame:
    """A row for every key on every date of the table, values carried forward.

    Each key gets the list of dates, which is bounded by the calendar, and is expanded in place.
    """
    dates = df.select(date).distinct().agg(F.collect_list(date)).scalar()
    grid = df.select(key).distinct().withColumn("_dates", dates).select(key, F.explode("_dates").alias(date))
    values = [c for c in df.columns if c not in (key, date)]
    return forward_fill(grid.join(df, [key, date], "left"), values, key, date)


def listing_range(df: DataFrame, key: str = INSTRUMENT, date: str = DATE) -> DataFrame:
    """First and last date of each instrument, and their positions in the calendar."""
    spans = df.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    index = date_index(df, date)
    for side in ("first", "last"):
        positions = index.select(F.col(date).alias(f"{side}_date"), F.col("date_idx").alias(f"{side}_idx"))
        spans = spans.join(positions, f"{side}_date")
    return spans.select(key, "first_date", "last_date", "first_idx", "last_idx")


def in_universe(df: DataFrame, universe: DataFrame, key: str = INSTRUMENT) -> DataFrame:
    """Rows of the instruments listed in ``universe``."""
    return df.join(universe.select(key), key, "left_semi")


def without_index_codes(df: DataFrame, suffixes: Iterable[str], key: str = "symbol") -> DataFrame:
    """Drop index series, recognised by the end of their code."""
    return reduce(lambda d, s: d.where(~F.col(key).endswith(s)), suffixes, df)


# --- incremental ----------------------------------------------------------------------


def append_new(existing: DataFrame, increment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of both tables, one row per key; the existing row wins."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(
        increment.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    rest = sorted(c for c in both.columns if c not in (*keys, "_batch"))
    return keep_first(both, keys, ["_batch", *rest]).drop("_batch")


def time_coverage(df: DataFrame, end: str, key: str = INSTRUMENT, date: str = DATE) -> DataFrame:
    """Last date per key, whether it reaches ``end``, and the first missing day if not."""
    last = df.groupBy(key).agg(F.to_date(F.max(date)).alias("last_date"))
    covered = F.col("last_date") >= F.lit(end).cast("date")
    return last.select(
        key, "last_date", covered.alias("covered"), F.when(~covered, F.date_add("last_date", 1)).alias("gap_start")
    )


def missing_symbols(pool: DataFrame, existing: DataFrame, key: str = INSTRUMENT) -> DataFrame:
    """Symbols of the pool that have no data."""
    return pool.select(key).distinct().join(existing.select(key), key, "left_anti")


def existing_symbols(pool: DataFrame, existing: DataFrame, key: str = INSTRUMENT) -> DataFrame:
    """Symbols of the pool that have data."""
    return pool.select(key).distinct().join(existing.select(key), key, "left_semi")


# --- tradability ----------------------------------------------------------------------


def tradability(
    bars: DataFrame, liquidity_days: int = 20, limit: float = 0.098, min_listed_days: int = 60
) -> DataFrame:
    """Limit moves, days since listing, average turnover, and whether the next open can be bought.

    A bar is at its limit when it closes at its high (low) after a move of at least ``limit``.
    """
    spec = Window.partitionBy(INSTRUMENT).orderBy(DATE)
    ret = div(F.col("close"), F.lag("close").over(spec)) - 1
    first = F.min(DATE).over(Window.partitionBy(INSTRUMENT))
    amount = F.avg("amount").over(spec.rowsBetween(-(liquidity_days - 1), Window.currentRow))
    staged = bars.withColumns({"_ret": ret, "listed_days": F.date_diff(F.col(DATE), first).cast("bigint"), "liquidity": amount})
    up = F.coalesce((F.col("_ret") >= limit) & (F.col("close") >= F.col("high")), F.lit(False))
    down = F.coalesce((F.col("_ret") <= -limit) & (F.col("close") <= F.col("low")), F.lit(False))
    next_open = div(F.lead("open").over(spec), F.col("close")) - 1
    return staged.select(
        INSTRUMENT,
        DATE,
        up.alias("at_upper_limit"),
        down.alias("at_lower_limit"),
        "listed_days",
        (F.col("listed_days") >= min_listed_days).alias("is_seasoned"),
        "liquidity",
        F.coalesce(next_open < limit, F.lit(False)).alias("next_open_buyable"),
    )


def tradable_universe(
    flags: DataFrame, masks: dict[str, Column] | None = None, liquidity_quantile: float = 0.2
) -> DataFrame:
    """``(instrument, datetime)`` of seasoned, liquid names whose next open can be bought.

    ``flags`` comes from ``tradability``. ``masks`` are further exclusions by name, such as
    special treatment or suspension. Liquid means at or above the date's quantile.
    """
    floors = group_quantiles(flags, [DATE], "liquidity", {"_floor": liquidity_quantile})
    kept = F.col("is_seasoned") & F.col("next_open_buyable") & (F.col("liquidity") >= F.col("_floor"))
    for excluded in (masks or {}).values():
        kept &= ~F.coalesce(excluded, F.lit(False))
    return join_dates(flags, floors).where(kept).select(INSTRUMENT, DATE)
