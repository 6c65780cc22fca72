"""Top-k portfolio evaluation on the date grid: returns, book, turnover, costs and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.calendar import date_index, join_dates, with_date_index
from factorloom.functions.frames import DATE, INSTRUMENT, so_far
from factorloom.functions.numeric import div
from factorloom.operators.scans import maximum, product, running
from factorloom.sources.shared import stored

YEAR = 252


def grid_returns(prices: DataFrame, price: str = "close") -> DataFrame:
    """Return over one step of the calendar; null where the instrument has no price on the previous date.

    Adds ``date_idx``.
    """
    spec = Window.partitionBy(INSTRUMENT).orderBy("date_idx")
    step = F.col("date_idx") - F.lag("date_idx").over(spec)
    ret = F.when(step == 1, div(F.col(price), F.lag(price).over(spec)) - 1)
    return with_date_index(prices).select(INSTRUMENT, DATE, "date_idx", ret.alias("ret"))


def returns_from_label(panel: DataFrame, label: str = "label_1d") -> DataFrame:
    """Grid returns where no price is known: the one-day forward return, moved one date ahead."""
    index = date_index(panel)
    ahead = index.select((F.col("date_idx") + 1).alias("_next"), F.col(DATE).alias("_from"))
    moved = ahead.join(index.withColumnRenamed("date_idx", "_next"), "_next").select("_from", F.col(DATE).alias("_to"))
    rows = panel.select(INSTRUMENT, F.col(DATE).alias("_from"), F.col(label).alias("ret"))
    return join_dates(rows, moved, "_from").select(INSTRUMENT, F.col("_to").alias(DATE), "ret")


def common_dates(returns: DataFrame, signals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dates present in both tables, numbered from 0 as ``day``; with ``by``, for each series of signals on its own."""
    both = signals.select(*by, DATE).distinct().join(returns.select(DATE).distinct(), DATE, "left_semi")
    if not by:
        return date_index(both, index="day")
    # One row per series and date of the calendar.
    return both.withColumn("day", F.row_number().over(Window.partitionBy(*by).orderBy(DATE)).cast("bigint") - 1)


def topk_weights(
    signals: DataFrame, days: DataFrame, topk: int, shift: int = 1, signal: str = "signal", by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, day, instrument, weight)``: equal weights on the ``topk`` largest signals of ``shift`` days before.

    Days with fewer than ``topk`` signals hold nothing. Ties go to the smaller instrument code.
    The limit on the row number is applied before the shuffle, so a date sends at most ``topk``
    rows per task.
    """
    best = Window.partitionBy(*by, "day").orderBy(F.desc(signal), INSTRUMENT)
    known = signals.where(F.col(signal).isNotNull())
    dated = known.join(days, [*by, DATE]) if by else join_dates(known, days)
    held = (
        dated.select(*by, (F.col("day") + shift).alias("day"), INSTRUMENT, signal)
        .withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") <= topk)
    )
    full = held.withColumn("_held", F.count(F.lit(1)).over(Window.partitionBy(*by, "day")))
    return (
        full.where(F.col("_held") == topk)
        .join(days.select(*by, "day"), [*by, "day"], "left_semi")
        .select(*by, "day", INSTRUMENT, F.lit(1.0 / topk).alias("weight"))
    )


def book_turnover(weights: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, day, turnover)``: half the absolute weight change against the day before, for every day."""
    now = weights.select(*by, "day", INSTRUMENT, "weight")
    before = weights.select(*by, (F.col("day") + 1).alias("day"), INSTRUMENT, (-F.col("weight")).alias("weight"))
    change = now.unionByName(before).groupBy(*by, "day", INSTRUMENT).agg(F.sum("weight").alias("_change"))
    moved = change.groupBy(*by, "day").agg((F.sum(F.abs("_change")) / 2).alias("_turnover"))
    joined = days.join(moved, [*by, "day"], "left")
    return joined.select(*by, "day", DATE, F.coalesce("_turnover", F.lit(0.0)).alias("turnover"))


def topk_backtest(
    returns: DataFrame,
    signals: DataFrame,
    topk: int = 50,
    cost_bps: float = 10,
    shift: int = 1,
    signal: str = "signal",
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per date (and series ``by``): net portfolio return, excess over the equal-weight mean, turnover.

    The return is null on days without a book; a held name without a return counts as zero.
    """
    keys = [*by, "day"]
    # Small tables that several joins read: a row per series and date, and the names held there.
    days = stored(common_dates(returns, signals, by), "days")
    weights = stored(topk_weights(signals, days, topk, shift, signal, by), "weights")
    benchmark = returns.groupBy(DATE).agg(F.avg("ret").alias("benchmark"))
    held = weights.join(days, keys).join(returns.select(DATE, INSTRUMENT, "ret"), [DATE, INSTRUMENT], "left")
    gross = held.groupBy(*keys).agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("_gross"))
    net = F.col("_gross") - F.col("turnover") * (cost_bps / 10000)
    return (
        book_turnover(weights, days, by)
        .join(gross, keys, "left")
        .join(benchmark, DATE, "left")
        .select(
            *by,
            DATE,
            net.alias("portfolio_return"),
            (net - F.col("benchmark")).alias("excess_return"),
            "turnover",
            "benchmark",
        )
    )


def cumulative(
    series: DataFrame, value: str, by: Sequence[str] = (), out: str = "cumulative", block: Column | None = None
) -> DataFrame:
    """Running product of ``1 + value`` over the dates of each series; missing values are left out.

    ``block``, a non-decreasing function of the date, splits long series without changing the result.
    """
    spec = so_far(Window.partitionBy(*by).orderBy(DATE))
    known = series.where(F.col(value).isNotNull())
    if block is not None:
        return running(known, {out: product(1 + F.col(value))}, by, DATE, block)
    return known.withColumn(out, F.product(1 + F.col(value)).over(spec))


def drawdown(
    series: DataFrame,
    cumulative_column: str = "cumulative",
    by: Sequence[str] = (),
    out: str = "drawdown",
    block: Column | None = None,
) -> DataFrame:
    """Cumulative value relative to its running maximum, minus one; ``block`` as for ``cumulative``."""
    if block is not None:
        peaks = running(series, {"_peak": maximum(F.col(cumulative_column))}, by, DATE, block)
        return peaks.withColumn(out, div(F.col(cumulative_column), F.col("_peak")) - 1).drop("_peak")
    spec = so_far(Window.partitionBy(*by).orderBy(DATE))
    peak = F.max(cumulative_column).over(spec)
    return series.withColumn(out, div(F.col(cumulative_column), peak) - 1)


def backtest_metrics(daily: DataFrame, by: Sequence[str] = (), year: int = YEAR) -> DataFrame:
    """Annualised return and excess, Sharpe ratios, drawdown, win rate, turnover, number of periods.

    A series has one row per date, so its ordered window is bounded by the calendar.
    """
    port, excess = F.col("portfolio_return"), F.col("excess_return")

    def sharpe(c):
        std = F.stddev_samp(c)
        return F.when(std > 0, div(F.avg(c), std) * F.sqrt(F.lit(float(year)))).otherwise(0.0)

    path = drawdown(cumulative(daily, "portfolio_return", by), by=by)
    worst = path.groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))
    stats = daily.groupBy(*by).agg(
        (F.pow(F.product(1 + port), F.lit(float(year)) / F.count(port)) - 1).alias("ann_return"),
        (F.avg(excess) * year).alias("ann_excess_return"),
        sharpe(port).alias("sharpe"),
        sharpe(excess).alias("excess_sharpe"),
        F.avg((port > 0).cast("double")).alias("win_rate"),
        F.avg("turnover").alias("avg_turnover"),
        F.count(port).alias("n_periods"),
    )
    if by:
        return stats.join(worst, list(by), "left")
    return stats.withColumn("max_drawdown", worst.scalar())
