"""Tear-sheet tables of one factor: clean data, IC, quantile returns, turnover, summaries.

The clean table is ``(datetime, instrument, factor, quantile, [group], ret_{p})`` with one forward
return per period on the price calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.bins import with_quantile_bin, with_width_bin, with_zero_aware_bin
from factorloom.functions.calendar import date_index, with_date_index
from factorloom.functions.frames import DATE, INSTRUMENT
from factorloom.functions.numeric import correlation, div, finite
from factorloom.functions.ranks import with_average_rank
from factorloom.operators.book import YEAR, cumulative, drawdown
from factorloom.operators.ic import ic_summary, rank_correlation
from factorloom.operators.scans import previous, product, running, total
from factorloom.sources.shared import stored

FACTOR, QUANTILE, PERIOD = "factor", "quantile", "period"
# Viability thresholds and the |IC| level that is reported.
VIABLE = {"ic_ir": 0.4, "ic_mean": 0.02, "monotonicity": 0.7, "net_ic": 0.02, "sharpe": 1.0}
NOTABLE_IC = 0.02


# --- inputs ---------------------------------------------------------------------------


def clean_factor(factor: DataFrame, order: str, value: str = FACTOR) -> DataFrame:
    """Finite factor values, one per date and name (the last by ``order``), rows marked invalid left out."""
    rows = factor
    if "quality_status" in rows.columns:
        rows = rows.where(F.coalesce("quality_status", F.lit("valid")) != "invalid")
    rows = rows.withColumn(FACTOR, finite(F.col(value))).where(
        F.col(FACTOR).isNotNull() & F.col(DATE).isNotNull() & F.col(INSTRUMENT).isNotNull()
    )
    return rows.groupBy(DATE, INSTRUMENT).agg(F.max_by(FACTOR, order).alias(FACTOR))


def price_paths(returns: DataFrame, ret: str = "ret", held: str | None = None, block: Column | None = None) -> DataFrame:
    """Price path compounded from returns, starting again at 1.0 after every gap.

    A row without return (or without ``held`` contract) has no price, and the first row after it
    ignores its own return. ``block``, a non-decreasing function of the date, splits long histories without changing the result.
    """
    spec = Window.partitionBy(INSTRUMENT).orderBy(DATE)
    gap = F.col(ret).isNull() if held is None else F.col(ret).isNull() | F.col(held).isNull()
    if block is not None:
        # Gaps so far number the runs; within a run the first row after the gap grows by nothing.
        marked = returns.withColumn("_gap", gap)
        scans = {"_run": total(F.col("_gap").cast("int")), "_after": previous(F.col("_gap"), DATE)}
        runs = running(marked, scans, [INSTRUMENT], DATE, block)
        first = F.coalesce("_after", F.lit(True))
        growth = F.when(~F.col("_gap"), F.when(first, 1.0).otherwise(1 + F.col(ret)))
        paths = running(runs, {"_price": product(growth)}, [INSTRUMENT, "_run"], DATE, block)
        return paths.select(INSTRUMENT, DATE, F.when(~F.col("_gap"), F.col("_price")).alias("price"))
    runs = returns.withColumn("_gap", gap).withColumn("_run", F.sum(F.col("_gap").cast("int")).over(spec))
    inside = Window.partitionBy(INSTRUMENT, "_run", "_gap").orderBy(DATE)
    growth = F.when(F.row_number().over(inside) == 1, 1.0).otherwise(1 + F.col(ret))
    price = F.product("_growth").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("_growth", growth).select(
        INSTRUMENT, DATE, F.when(~F.col("_gap"), price).alias("price")
    )


def trim_to_horizon(factor: DataFrame, prices: DataFrame, max_period: int) -> DataFrame:
    """Factor rows whose longest forward return lies within the price dates, for priced names."""
    index = date_index(prices)
    last = index.agg(F.max("date_idx") - max_period).scalar()
    allowed = index.where(F.col("date_idx") <= last).agg(F.max(DATE)).scalar()
    return factor.where(F.col(DATE) <= allowed).join(prices.select(INSTRUMENT), INSTRUMENT, "left_semi")


def grid_forward_returns(
    prices: DataFrame, periods: Sequence[int], price: str = "close", cumulative_returns: bool = True
) -> DataFrame:
    """``ret_{p}`` between a date and the ``p``-th date after it on the price calendar, null across gaps."""
    spec = Window.partitionBy(INSTRUMENT).orderBy("date_idx")

    def price_at(k: int) -> Column:
        return F.max(price).over(spec.rangeBetween(k, k))

    base = lambda p: F.col(price) if cumulative_returns else price_at(p - 1)
    returns = {f"ret_{p}": div(price_at(p), base(p)) - 1 for p in periods}
    return with_date_index(prices).select(INSTRUMENT, DATE, *[c.alias(n) for n, c in returns.items()])


def without_outliers(returns: DataFrame, columns: Sequence[str], zscore: float = 20.0) -> DataFrame:
    """Forward returns beyond ``zscore`` standard deviations of the instrument's mean become null."""
    own = Window.partitionBy(INSTRUMENT)

    def kept(c: str) -> Column:
        far = F.abs(F.col(c) - F.avg(c).over(own)) > zscore * F.stddev_samp(c).over(own)
        return F.when(~F.coalesce(far, F.lit(False)), F.col(c))

    return returns.withColumns({c: kept(c) for c in columns})


def with_group(factor: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach the group by instrument, or by date and instrument where the mapping is dated."""
    keys = [c for c in (DATE, INSTRUMENT) if c in groups.columns]
    return factor.join(groups, keys, "left")


def clean_factor_data(
    factor: DataFrame,
    prices: DataFrame,
    periods: Sequence[int] = (1, 5, 10),
    quantiles: int | None = 5,
    bins: int | None = None,
    groups: DataFrame | None = None,
    binning_by_group: bool = False,
    zscore: float | None = 20.0,
    zero_aware: bool = False,
    cumulative_returns: bool = True,
    price: str = "close",
    max_loss: float | None = None,
) -> DataFrame:
    """Factor, forward returns and quantile; rows lacking any of them are left out.

    Outliers are judged on the dates that carry a factor. With ``max_loss`` the query fails when a larger share of
    the factor rows is left out; the counts are part of its plan.
    """
    columns = [f"ret_{p}" for p in periods]
    returns = grid_forward_returns(prices, periods, price, cumulative_returns)
    if zscore is not None:
        dated = returns.join(factor.select(DATE).distinct(), DATE, "left_semi")
        returns = without_outliers(dated, columns, zscore)
    rows = factor.join(returns, [DATE, INSTRUMENT]).dropna(subset=[FACTOR, *columns])
    if groups is not None:
        rows = with_group(rows, groups).dropna(subset=["group"])
    by = [DATE, "group"] if binning_by_group else [DATE]
    count = quantiles if quantiles is not None else bins
    if zero_aware:
        binned = with_zero_aware_bin(rows, by, FACTOR, count, QUANTILE)
    elif quantiles is not None:
        binned = with_quantile_bin(rows, by, FACTOR, count, QUANTILE)
    else:
        binned = with_width_bin(rows, by, FACTOR, count, QUANTILE)
    clean = binned.withColumn(QUANTILE, F.col(QUANTILE) + 1)
    if max_loss is None:
        return clean
    loss = loss_ratio(factor, rows).select("loss").scalar()
    message = F.concat(F.lit("share of factor rows left out: "), loss.cast("string"), F.lit(f", allowed: {max_loss}"))
    return clean.where(F.when(F.coalesce(loss, F.lit(0.0)) > max_loss, F.raise_error(message).cast("boolean")).otherwise(True))


def loss_ratio(factor: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows before and after cleaning and the lost share."""
    kept = clean.agg(F.count(F.lit(1))).scalar()
    counts = factor.agg(F.count(F.lit(1)).alias("n_factor")).withColumn("n_clean", kept)
    return counts.withColumn("loss", 1 - div(F.col("n_clean").cast("double"), F.col("n_factor")))


def check_max_loss(factor: DataFrame, clean: DataFrame, max_loss: float = 0.35) -> None:
    """Raise if cleaning lost more than ``max_loss`` of the factor rows (runs a count)."""
    loss = loss_ratio(factor, clean).first()["loss"]
    if loss is not None and loss > max_loss:
        raise ValueError(f"max_loss ({max_loss:.1%}) exceeded: {loss:.1%} of the factor rows were lost")


def by_period(clean: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Long over periods: one row per date, name and ``period`` with its return ``ret``."""
    ids = [c for c in clean.columns if not c.startswith("ret_")]
    entries = [F.struct(F.lit(p).cast("bigint").alias(PERIOD), F.col(f"ret_{p}").alias("ret")) for p in periods]
    return clean.select(*ids, F.inline(F.array(*entries)))


# --- statistics -----------------------------------------------------------------------


def information_coefficient(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank IC per date and period, optionally within ``by`` (a group)."""
    ics = rank_correlation(long, [DATE, PERIOD, *by], FACTOR, "ret")
    return ics.where(F.col("ic").isNotNull()).select(DATE, PERIOD, *by, "ic")


def ic_statistics(ics: DataFrame) -> DataFrame:
    return ic_summary(ics, [PERIOD])


def _demeaned(long: DataFrame, by: Sequence[str] = (DATE, PERIOD)) -> DataFrame:
    means = long.groupBy(*by).agg(F.avg("ret").alias("_mean"))
    return long.join(means, list(by)).withColumn("ret", F.col("ret") - F.col("_mean")).drop("_mean")


def mean_return_by_quantile(long: DataFrame, by_date: bool = False, demeaned: bool = True) -> DataFrame:
    """Mean forward return and its standard error per quantile and period (and date)."""
    rows = _demeaned(long) if demeaned else long
    keys = [QUANTILE, PERIOD, *([DATE] if by_date else [])]
    return rows.groupBy(*keys).agg(
        F.avg("ret").alias("mean_ret"),
        div(F.stddev_samp("ret"), F.sqrt(F.count("ret").cast("double"))).alias("std_error"),
    )


def quantile_spread(means: DataFrame, top: int, bottom: int = 1) -> DataFrame:
    """Top minus bottom mean return with the joint standard error, per period (and date)."""
    keys = [c for c in (PERIOD, DATE) if c in means.columns]

    def pick(q: int, c: str) -> Column:
        return F.max(F.when(F.col(QUANTILE) == q, F.col(c)))

    error = F.sqrt(F.pow(pick(top, "std_error"), 2) + F.pow(pick(bottom, "std_error"), 2))
    return means.groupBy(*keys).agg(
        (pick(top, "mean_ret") - pick(bottom, "mean_ret")).alias("spread"), error.alias("std_error")
    )


def factor_weighted_returns(long: DataFrame) -> DataFrame:
    """Return per date and period of the portfolio weighted by the demeaned factor, gross exposure one."""
    means = long.groupBy(DATE, PERIOD).agg(F.avg(FACTOR).alias("_mean"))
    w = F.col(FACTOR) - F.col("_mean")
    return (
        long.join(means, [DATE, PERIOD])
        .groupBy(DATE, PERIOD)
        .agg(div(F.sum(w * F.col("ret")), F.sum(F.abs(w))).alias("factor_return"))
    )


def quantile_turnover(clean: DataFrame, period: int = 1) -> DataFrame:
    """Share of a quantile's names that were not in it ``period`` dates before."""
    spec = Window.partitionBy(INSTRUMENT).orderBy("date_idx").rangeBetween(-period, -period)
    was = F.max(QUANTILE).over(spec)
    marked = with_date_index(clean.select(DATE, INSTRUMENT, QUANTILE)).withColumn(
        "_new", F.coalesce(was != F.col(QUANTILE), F.lit(True)).cast("double")
    )
    return (
        marked.where(F.col("date_idx") >= period)
        .groupBy(DATE, QUANTILE)
        .agg(F.avg("_new").alias("turnover"))
    )


def rank_autocorrelation(clean: DataFrame, period: int = 1) -> DataFrame:
    """Correlation of the factor ranks with those of ``period`` dates before, per date."""
    ranked = with_average_rank(with_date_index(clean.select(DATE, INSTRUMENT, FACTOR)), [DATE, "date_idx"], FACTOR, "_rank")
    spec = Window.partitionBy(INSTRUMENT).orderBy("date_idx").rangeBetween(-period, -period)
    paired = ranked.withColumn("_was", F.max("_rank").over(spec))
    return (
        paired.where(F.col("date_idx") >= period)
        .groupBy(DATE)
        .agg(correlation(F.col("_rank"), F.col("_was")).alias("autocorrelation"))
    )


# --- return series --------------------------------------------------------------------


def quantile_series(long: DataFrame) -> DataFrame:
    """Daily mean return of each quantile and of all names (``series`` Q1.., EW), per period."""
    series = F.concat(F.lit("Q"), F.col(QUANTILE).cast("string"))
    each = long.groupBy(DATE, PERIOD, series.alias("series")).agg(F.avg("ret").alias("ret"))
    whole = long.groupBy(DATE, PERIOD, F.lit("EW").alias("series")).agg(F.avg("ret").alias("ret"))
    return each.unionByName(whole)


def cumulative_series(series: DataFrame) -> DataFrame:
    """Cumulative value and drawdown of every series."""
    keys = ["series", PERIOD]
    return drawdown(cumulative(series, "ret", keys), by=keys)


def long_short_series(series: DataFrame, top: int) -> DataFrame:
    """Long-short growth per date: compounded spread, and ratio of the two cumulative curves."""

    def pick(name: str, c: str) -> Column:
        return F.max(F.when(F.col("series") == name, F.col(c)))

    curves = cumulative(series, "ret", ["series", PERIOD])
    wide = curves.groupBy(DATE, PERIOD).agg(
        (pick(f"Q{top}", "ret") - pick("Q1", "ret")).alias("spread"),
        div(pick(f"Q{top}", "cumulative"), pick("Q1", "cumulative")).alias("curve_ratio"),
    )
    return cumulative(wide, "spread", [PERIOD], "spread_cumulative")


def compounded_returns(series: DataFrame, unit: str = "month", top: int = 5) -> DataFrame:
    """Return of each series compounded within calendar months or years, and the long-short difference."""
    keys = [PERIOD, F.to_date(F.trunc(DATE, unit)).alias("starts")]
    grown = series.groupBy("series", *keys).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    pick = lambda name: F.max(F.when(F.col("series") == name, F.col("ret")))
    difference = grown.groupBy(PERIOD, "starts").agg((pick(f"Q{top}") - pick("Q1")).alias("ret"))
    return grown.unionByName(difference.where(F.col("ret").isNotNull()).withColumn("series", F.lit("LS")))


# --- summary --------------------------------------------------------------------------


def summary(long: DataFrame, ics: DataFrame, factor_returns: DataFrame, top: int) -> DataFrame:
    """One row per period: direction, IC ratios, win rates, monotonicity, long-short Sharpe, viability."""
    ic = ics.groupBy(PERIOD).agg(
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("_ic_std"),
        F.count("ic").alias("n_periods"),
        F.avg((F.abs("ic") > NOTABLE_IC).cast("double")).alias("ic_gt_02"),
    )
    sign = F.when(F.col("ic_mean") >= 0, 1).otherwise(-1)
    wins = factor_returns.groupBy(PERIOD).agg(
        F.avg((F.col("factor_return") > 0).cast("double")).alias("_up"),
        F.avg((F.col("factor_return") < 0).cast("double")).alias("_down"),
    )
    by_quantile = long.groupBy(PERIOD, QUANTILE).agg(F.avg("ret").alias("_ret"))
    mono = rank_correlation(by_quantile.withColumn("_q", F.col(QUANTILE).cast("double")), [PERIOD], "_q", "_ret", out="_mono")
    pick = lambda q: F.avg(F.when(F.col(QUANTILE) == q, F.col("ret")))
    spreads = long.groupBy(DATE, PERIOD).agg((pick(top) - pick(1)).alias("_spread"))
    long_short = spreads.groupBy(PERIOD).agg(F.avg("_spread").alias("_ls"), F.stddev_samp("_spread").alias("_ls_std"))
    joined = ic.join(wins, PERIOD).join(mono.drop("n"), PERIOD).join(long_short, PERIOD).withColumn("direction", sign.cast("bigint"))
    d = F.col("direction")
    icir = div(F.col("ic_mean") * d, F.col("_ic_std"))
    sharpe = F.when(F.col("_ls_std") > 0, div(F.col("_ls") * d, F.col("_ls_std")) * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)
    table = joined.select(
        PERIOD,
        "direction",
        "ic_mean",
        icir.alias("ic_ir"),
        (icir * F.sqrt(F.col("n_periods").cast("double"))).alias("t_stat"),
        F.when(d == 1, F.col("_up")).otherwise(F.col("_down")).alias("win_rate"),
        # The share of returns with the sign of the direction.
        F.when(d == 1, F.col("_up")).otherwise(F.col("_down")).alias("win_rate_sym"),
        "ic_gt_02",
        "n_periods",
        (F.col("_mono") * d).alias("monotonicity"),
        (F.col("_ls") * d * YEAR).alias("ls_ann_ret"),
        sharpe.alias("ls_sharpe"),
        (F.col("ic_mean") * d).alias("net_ic"),
    )
    viable = (
        (F.abs("ic_ir") > VIABLE["ic_ir"])
        & (F.abs("ic_mean") > VIABLE["ic_mean"])
        & (F.col("monotonicity") > VIABLE["monotonicity"])
        & (F.col("net_ic") > VIABLE["net_ic"])
        & (F.col("ls_sharpe") > VIABLE["sharpe"])
    )
    return table.withColumn("viable", F.coalesce(viable, F.lit(False)))


def strength_bins(clean: DataFrame, ret: str, direction: int, bins: int) -> DataFrame:
    """Per bin of |factor| within its date, and for all rows: correlations, win share, mean return, odds."""
    # Stored for the quantiles and the rows that meet them, and binned for the measures and the ranks.
    sized = stored(clean.select(DATE, FACTOR, F.col(ret).alias("ret"), F.abs(FACTOR).alias("_size")), "sized")
    binned = with_quantile_bin(sized, [DATE], "_size", bins, "_bin").select(
        F.concat(F.lit("bin_"), (F.col("_bin") + 1).cast("string")).alias("bin"), FACTOR, "ret"
    )
    binned = stored(binned, "binned")
    rows = binned.select(F.explode(F.array("bin", F.lit("All"))).alias("bin"), FACTOR, "ret")
    aligned = F.col("ret") * direction
    gains = F.coalesce(F.sum(F.when(aligned > 0, aligned)), F.lit(0.0))
    losses = F.abs(F.sum(F.when(aligned < 0, aligned)))
    measures = rows.groupBy("bin").agg(
        correlation(F.col(FACTOR), F.col("ret")).alias("ic"),
        (F.avg((aligned > 0).cast("double")) * 100).alias("win_pct"),
        (F.avg(aligned) * 10000).alias("realized_bp"),
        div(gains, losses).alias("odds"),
    )
    ranked = rank_correlation(rows, ["bin"], FACTOR, "ret", out="rank_ic", pooled=True).drop("n")
    return measures.join(ranked, "bin", "left")
