"""Forward returns and the per-date label transforms used for training."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from factorloom.functions.bins import with_quantile_bin
from factorloom.functions.calendar import join_dates
from factorloom.functions.frames import DATE, INSTRUMENT, full, history
from factorloom.functions.numeric import clip, div
from factorloom.functions.ranks import group_quantiles, with_ordinal

# Default horizons.
PERIODS = (1, 5, 10, 20)


def with_forward_returns(
    df: DataFrame, periods: Iterable[int] = PERIODS, price: str = "close", spec: WindowSpec | None = None
) -> DataFrame:
    """Add ``label_{p}d``: the return over the instrument's next ``p`` rows."""
    spec = spec or history()
    return df.withColumns({f"label_{p}d": div(F.lead(price, p).over(spec), F.col(price)) - 1 for p in periods})


def forward_returns(prices: DataFrame, periods: Iterable[int] = PERIODS, price: str = "close") -> DataFrame:
    """Instrument, date, price and the forward returns."""
    periods = tuple(periods)
    labels = [f"label_{p}d" for p in periods]
    return with_forward_returns(prices, periods, price).select(INSTRUMENT, DATE, price, *labels)


def labels_in_range(
    prices: DataFrame, start: str, end: str, periods: Iterable[int] = PERIODS, price: str = "close"
) -> DataFrame:
    """Labels of rows within ``[start, end]``, computed on prices up to ``max(p) + 5`` calendar days later."""
    last = F.date_add(F.lit(end).cast("date"), max(periods) + 5)
    buffered = prices.where((F.col(DATE) >= F.lit(start).cast("date")) & (F.col(DATE) <= last))
    return forward_returns(buffered, periods, price).where(F.col(DATE) <= F.lit(end).cast("date"))


def attach_labels(factors: DataFrame, labels: DataFrame) -> DataFrame:
    """Factors with their labels and close, by instrument and date."""
    return factors.join(labels, [INSTRUMENT, DATE], "left")


def risk_adjusted_return(prices: DataFrame, horizon: int = 20, price: str = "close") -> DataFrame:
    """Forward return over ``horizon`` rows divided by the volatility of those same future rows."""
    spec = history()
    ahead = spec.rowsBetween(1, horizon)
    ret = F.col("_ret")
    forward = div(F.lead(price, horizon).over(spec), F.col(price)) - 1
    volatility = full(F.stddev_samp(ret), ret, ahead, horizon)
    staged = prices.withColumn("_ret", div(F.col(price), F.lag(price, 1).over(spec)) - 1)
    return staged.select(
        INSTRUMENT, DATE, div(forward, volatility * F.sqrt(F.lit(float(horizon))) + 1e-9).alias("risk_adjusted")
    )


def winsorised_label(df: DataFrame, label: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clip the label to its per-date quantiles; a date with fewer than two labels gets null."""
    edges = group_quantiles(df, [DATE], label, {"_lo": lower, "_hi": upper})
    clipped = F.when(F.col("total") >= 2, clip(F.col(label), F.col("_lo"), F.col("_hi")))
    return join_dates(df, edges, how="left").withColumn(label, clipped).drop("_lo", "_hi", "total")


def rank_label(df: DataFrame, label: str, bins: int = 5, min_names: int = 30, out: str = "rank_label") -> DataFrame:
    """Equal-count ordinal bins 0..bins-1 per date, ties broken by instrument; null on thin dates.

    Bin edges are quantiles of the ranks 1..n: rank r falls into bin ceil((r-1)/(n-1)*bins)-1.
    """
    placed = with_ordinal(df, [DATE], label, INSTRUMENT, "_r", "_n")
    # (a - 1) div b is ceil(a / b) - 1 for positive integers, and 0 for the lowest rank.
    bin_ = F.expr(f"((_r - 1) * {int(bins)} - 1) div greatest(_n - 1, 1)")
    chosen = F.when(F.col("_n") >= min_names, F.greatest(bin_, F.lit(0).cast("bigint")))
    return placed.withColumn(out, chosen).drop("_r", "_n")


def binary_label(
    df: DataFrame,
    label: str,
    top: float = 0.8,
    bottom: float = 0.2,
    min_names: int = 30,
    out: str = "binary_label",
    mask: str = "is_extreme",
) -> DataFrame:
    """1 for the top names of a date, 0 for the rest; ``mask`` marks the top and bottom names.

    A name on both edges counts as bottom. Dates with fewer than ``min_names`` labels are null
    and unmasked.
    """
    edges = group_quantiles(df, [DATE], label, {"_bottom": bottom, "_top": top})
    x = F.col(label)
    enough = F.coalesce(F.col("total"), F.lit(0)) >= min_names
    low, high = F.coalesce(x <= F.col("_bottom"), F.lit(False)), F.coalesce(x >= F.col("_top"), F.lit(False))
    return (
        join_dates(df, edges, how="left")
        .withColumn(out, F.when(enough, F.when(high & ~low, 1.0).otherwise(0.0)))
        .withColumn(mask, enough & (low | high))
        .drop("_bottom", "_top", "total")
    )


def quintile_target(df: DataFrame, label: str, bins: int = 5, out: str = "target") -> DataFrame:
    """Quantile bin 0..bins-1 per date, repeated edges merged, missing labels set to 0."""
    binned = with_quantile_bin(df, [DATE], label, bins, "_bin")
    return binned.withColumn(out, F.coalesce(F.col("_bin"), F.lit(0).cast("bigint"))).drop("_bin")
