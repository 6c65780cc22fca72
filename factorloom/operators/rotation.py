"""Asset-rotation study: features, trend gate, rebalancing, stop exits and capped allocation.

The asset list of a rotation study is fixed and short; assets are rows here all the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from factorloom.functions.bins import with_quantile_bin
from factorloom.functions.calendar import date_index, month_end_dates, with_date_index
from factorloom.functions.frames import DATE, INSTRUMENT, full, history, trailing
from factorloom.functions.numeric import div, finite
from factorloom.operators import gram
from factorloom.operators.history import number_rows
from factorloom.operators.scans import decayed_means
from factorloom.sources.shared import stored

SMA_ROWS = 20


# --- features -------------------------------------------------------------------------


def rotation_features(bars: DataFrame) -> DataFrame:
    """EMA gaps over the whole history, 20-row momentum, RSI, range and volume measures of each asset."""
    spec = history()
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    change = c - F.lag("close").over(spec)
    prior = F.col("_prior")
    numbered = number_rows(bars, F.year(DATE))
    staged = decayed_means(numbered, {"_ema_20": ("close", 20), "_ema_60": ("close", 60)}, [INSTRUMENT]).withColumns(
        {
            "_prior": F.lag("close").over(spec),
            # The missing first change counts as neither gain nor loss.
            "_gain": F.when(change > 0, change).otherwise(0.0),
            "_loss": F.when(change < 0, -change).otherwise(0.0),
        }
    ).withColumn("_range", F.greatest(h - low, F.abs(h - prior), F.abs(low - prior)))
    f14, f20 = trailing(spec, 14), trailing(spec, 20)

    def mean(x: str, frame: WindowSpec, rows: int) -> Column:
        return full(F.avg(x), F.col(x), frame, rows)

    strength = div(mean("_gain", f14, 14), mean("_loss", f14, 14) + 1e-9)
    return staged.select(
        INSTRUMENT,
        DATE,
        (div(F.col("_ema_20"), c) - 1).alias("ema_diff_20"),
        (div(F.col("_ema_60"), c) - 1).alias("ema_diff_60"),
        (div(c, F.lag("close", 20).over(spec)) - 1).alias("roc_20"),
        (100 - div(F.lit(100.0), 1 + strength)).alias("rsi_14"),
        div(mean("_range", f20, 20), c + 1e-9).alias("atr_norm_20"),
        div(v - mean("volume", f20, 20), full(F.stddev_samp(v), v, f20, 20) + 1e-9).alias("vol_z_20"),
    )


def close_ratio(prices: DataFrame, numerator, denominator, out: str = "ratio") -> DataFrame:
    """Ratio of two assets' closes per date, a feature shared by all assets."""
    pick = lambda asset: F.max(F.when(F.col(INSTRUMENT) == asset, F.col("close")))
    return prices.where(F.col(INSTRUMENT).isin(numerator, denominator)).groupBy(DATE).agg(
        div(pick(numerator), pick(denominator) + 1e-9).alias(out)
    )


def with_trend(bars: DataFrame, rows: int = SMA_ROWS) -> DataFrame:
    """Simple moving average of the close and whether the close is above it."""
    spec = history()
    c = F.col("close")
    sma = full(F.avg(c), c, trailing(spec, rows), rows)
    return bars.withColumn("sma", sma).withColumn("is_trending", F.coalesce(c > F.col("sma"), F.lit(False)))


# --- rebalancing ----------------------------------------------------------------------


def rebalance_dates(prices: DataFrame, unit: str = "month", warmup: int = 0) -> DataFrame:
    """Last available date of each period, with its calendar position, from position ``warmup`` on."""
    ends = month_end_dates(prices, DATE, unit)
    return ends.join(date_index(prices), DATE).where(F.col("date_idx") >= warmup)


def eligible_assets(grid: DataFrame, rebalances: DataFrame, window: int, fallback=None) -> DataFrame:
    """``(date_idx, instrument)`` held from each rebalance date on.

    Assets above their moving average qualify; if none is, the fallback asset, or all assets
    when it does not exist. Of these, only assets with a return on each of the last ``window``
    dates are held. ``grid`` has a row per asset and date, with ``sma`` from ``with_trend``.
    """
    spec = Window.partitionBy(INSTRUMENT).orderBy("date_idx")
    indexed = with_date_index(grid)
    indexed = indexed.withColumn("_ret", div(F.col("close"), F.lag("close").over(spec)) - 1)
    complete = F.count("_ret").over(spec.rangeBetween(-(window - 1), 0)) == window
    rows = indexed.withColumn("_complete", complete).join(rebalances.select("date_idx"), "date_idx", "left_semi")
    state = rows.groupBy("date_idx").agg(
        F.max("is_trending").alias("_any"), F.max(F.col(INSTRUMENT) == F.lit(fallback)).alias("_has_fallback")
    )
    chosen = F.when(F.col("_any"), F.col("is_trending")).otherwise(
        F.when(F.coalesce("_has_fallback", F.lit(False)), F.col(INSTRUMENT) == F.lit(fallback)).otherwise(True)
    )
    return rows.join(state, "date_idx").where(chosen & F.col("_complete")).select("date_idx", INSTRUMENT)


def equal_weights(held: DataFrame) -> DataFrame:
    """``(date_idx, instrument, weight)`` with equal weights per rebalance date."""
    counts = held.groupBy("date_idx").agg(F.count(F.lit(1)).alias("_n"))
    return held.join(counts, "date_idx").select("date_idx", INSTRUMENT, (1 / F.col("_n").cast("double")).alias("weight"))


def weights_in_force(weights: DataFrame, dates: DataFrame, lag: int = 1) -> DataFrame:
    """``(date_idx, instrument, weight)`` for every date: the last rebalance at least ``lag`` dates before.

    The lookup runs on the calendar, one row per date.
    """
    effective = weights.select("date_idx").distinct().select((F.col("date_idx") + lag).alias("date_idx"), F.col("date_idx").alias("_set"))
    so_far = Window.orderBy("date_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_force = dates.join(effective, "date_idx", "left").withColumn("_set", F.last("_set", ignorenulls=True).over(so_far))
    return in_force.where(F.col("_set").isNotNull()).select("date_idx", "_set").join(
        weights.withColumnRenamed("date_idx", "_set"), "_set"
    ).select("date_idx", INSTRUMENT, "weight")


def stop_exit_returns(grid: DataFrame) -> DataFrame:
    """Return of a holding per date, sold at the moving average when the low falls below it.

    The average and the trend are those of the date before. No position without a trend.
    ``grid`` has a row per asset and date.
    """
    spec = history()
    prior = F.lag("close").over(spec)
    line = F.lag("sma").over(spec)
    trending = F.coalesce(prior > line, F.lit(False))
    exit_price = F.greatest("open", line)
    ret = F.when(~trending, 0.0).otherwise(
        F.when(F.col("low") < line, div(exit_price, prior) - 1).otherwise(div(F.col("close"), prior) - 1)
    )
    return with_date_index(grid).select(DATE, "date_idx", INSTRUMENT, ret.alias("ret"))


def portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Weighted return per date; a missing return counts as zero."""
    joined = weights.join(returns, ["date_idx", INSTRUMENT])
    return joined.groupBy(DATE).agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def next_returns(grid: DataFrame) -> DataFrame:
    """Return from each date to the next, per asset."""
    spec = history()
    ret = div(F.lead("close").over(spec), F.col("close")) - 1
    return with_date_index(grid).select(DATE, "date_idx", INSTRUMENT, ret.alias("ret"))


def covariance_matrices(grid: DataFrame, held: DataFrame, window: int) -> DataFrame:
    """Sample covariance of each pair of held assets over the ``window`` dates up to each rebalance.

    A matrix of the study's fixed asset list: its pairs are the result. Returns of two assets meet once per date, and a frame
    slides over each pair's dates, so the rows made are dates times pairs, however much the windows overlap.
    """
    spec = Window.partitionBy(INSTRUMENT).orderBy("date_idx")
    returns = with_date_index(grid).withColumn("ret", div(F.col("close"), F.lag("close").over(spec)) - 1)
    held_at = held.select("date_idx", INSTRUMENT, F.lit(True).alias("_held"))
    returns = returns.select("date_idx", INSTRUMENT, "ret").join(held_at, ["date_idx", INSTRUMENT], "left")
    a = returns.select("date_idx", F.col(INSTRUMENT).alias("asset_a"), F.col("ret").alias("_a"), F.col("_held").alias("_held_a"))
    b = returns.select("date_idx", F.col(INSTRUMENT).alias("asset_b"), F.col("ret").alias("_b"), F.col("_held").alias("_held_b"))
    frame = Window.partitionBy("asset_a", "asset_b").orderBy("date_idx").rangeBetween(-(window - 1), 0)
    found = a.join(b, "date_idx").withColumn("covariance", F.covar_samp("_a", "_b").over(frame))
    return found.where("_held_a AND _held_b").select("date_idx", "asset_a", "asset_b", "covariance")


# --- a model per rebalance date -------------------------------------------------------

# Fixed value: score of an asset with a missing feature.
MISSING_SCORE = -999.0


def training_windows(prices: DataFrame, window: int = 750, purge: int = 20, unit: str = "month") -> DataFrame:
    """Per rebalance date, the training range from ``window`` to ``purge`` calendar dates before it.

    In the columns of ``splits.walk_forward_windows``: the validation range is empty, the later range is the rebalance date.
    """
    calendar = date_index(prices)
    ends = rebalance_dates(prices, unit, window + purge + 1)
    for name, back in (("train_start", window), ("train_end", purge)):
        earlier = calendar.select((F.col("date_idx") + back).alias("date_idx"), F.col(DATE).alias(name))
        ends = ends.join(earlier, "date_idx")
    return ends.select(
        F.col("date_idx").alias("window_id"),
        "train_start",
        "train_end",
        F.col(DATE).alias("val_start"),
        F.date_sub(DATE, 1).alias("val_end"),
        F.col(DATE).alias("oos_start"),
        F.col(DATE).alias("oos_end"),
    )


def trained_scores(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    label: str,
    bins: int = 5,
    alpha: float = 0.01,
    l1_ratio: float = 0.0,
) -> DataFrame:
    """``(datetime, instrument, score)`` on each rebalance date, from a model trained on the window before it.

    Trained are linear models of the label's bin within its date, all from one pass over ``rows``: windows overlap, and share the
    moments of the dates between their edges. Only rows with all features and a label are trained on; an asset without all
    features on a rebalance date gets ``MISSING_SCORE``. A date whose window holds no row to train on is left out.
    """
    features = list(features)
    clean = rows.select(INSTRUMENT, DATE, finite(F.col(label)).alias("_label"), *[finite(F.col(f)).alias(f) for f in features])
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    binned = with_quantile_bin(clean.withColumn("_known", known).withColumn("_label", F.when(known, F.col("_label"))), [DATE], "_label", bins, "_bin")
    binned = stored(binned.withColumn("_target", F.col("_bin").cast("double")).drop("_bin", "_label"), "targets")
    days = gram.window_days(windows)
    fitted = gram.window_models(binned.where("_target IS NOT NULL"), days, features, "_target", {"linear": (alpha, l1_ratio)})
    fitted = stored(fitted, "rotation-models")
    scored = gram.window_predictions(binned.where("_known"), days, features, "_target", fitted)
    trained = windows.join(fitted, "window_id", "left_semi").select(F.col("oos_start").alias(DATE))
    missing = binned.where("NOT _known").join(trained, DATE, "left_semi")
    return scored.select(DATE, INSTRUMENT, F.col("prediction").alias("score")).unionByName(
        missing.select(DATE, INSTRUMENT, F.lit(MISSING_SCORE).alias("score"))
    )


# --- allocation -----------------------------------------------------------------------


def _filled(rows: DataFrame, by: list[str], budget: str, cap: float, out: str) -> DataFrame:
    """Shares ``out`` of each group's ``budget`` in proportion to ``share``, none above ``cap``.

    In falling order of ``share`` the first names are held at the cap and the rest get what is left in proportion. The
    right number of held names is the smallest for which the next one stays below the cap. Groups are the few names
    chosen for a date.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("share"), INSTRUMENT)
    behind = F.sum("share").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The factor by which shares grow if exactly the names before this one are held at the cap.
    factor = div(F.col(budget) - (F.row_number().over(order) - 1) * cap, behind)
    staged = rows.withColumn("_factor", factor)
    fits = F.when(F.col("_factor") * F.col("share") <= cap, F.struct(-F.col("share"), F.col(INSTRUMENT), F.col("_factor").alias("factor")))
    first = F.min(fits).over(Window.partitionBy(*by))["factor"]
    return staged.withColumn(out, F.coalesce(F.least(F.lit(cap), first * F.col("share")), F.lit(cap))).drop("_factor")


def capped_allocation(
    scores: DataFrame, capped_group, fallbacks=(), top_n: int = 4, single_cap: float = 0.35, group_cap: float = 0.20
) -> DataFrame:
    """``(datetime, instrument, weight)`` of the best ``top_n`` scores per date, negative scores set to zero.

    Weights follow the scores under a cap for each name and a cap for the sum of the group; names without a score get
    something only when all others are at their cap. If the caps leave a part of the budget, all weights are scaled up to
    sum to one. Without a positive score the first of ``fallbacks`` that is scored on the date gets all.
    """
    best = Window.partitionBy(DATE).orderBy(F.desc("score"), INSTRUMENT)
    day = Window.partitionBy(DATE)
    top = scores.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= top_n)
    top = top.select(DATE, INSTRUMENT, F.greatest("score", F.lit(0.0)).alias("score"))
    top = top.withColumn("_total", F.sum("score").over(day)).where(F.col("_total") > 1e-9)
    # A hair for every name, so that names without a score share equally what the others cannot take.
    shares = top.withColumns(
        {"share": div(F.col("score"), F.col("_total")) + 1e-9, "_grouped": F.col(INSTRUMENT).isin(list(capped_group)), "_all": F.lit(1.0)}
    )
    alone = _filled(shares, [DATE], "_all", single_cap, "_alone")
    in_group = F.sum(F.when(F.col("_grouped"), F.col("_alone")).otherwise(0.0)).over(day)
    over = in_group > group_cap
    budget = F.when(F.col("_grouped"), F.lit(group_cap)).otherwise(1 - group_cap)
    split = _filled(alone.withColumns({"_over": over, "_budget": budget}), [DATE, "_grouped"], "_budget", single_cap, "_split")
    weight = F.when(F.col("_over"), F.col("_split")).otherwise(F.col("_alone"))
    weighted = split.withColumn("_w", weight)
    chosen = weighted.select(DATE, INSTRUMENT, div(F.col("_w"), F.sum("_w").over(day)).alias("weight"))

    order = F.array(*[F.lit(f) for f in fallbacks]).cast(f"array<{dict(scores.dtypes)[INSTRUMENT]}>")
    spare = scores.where(F.array_contains(order, F.col(INSTRUMENT))).join(top.select(DATE).distinct(), DATE, "left_anti").groupBy(DATE).agg(
        F.min_by(INSTRUMENT, F.array_position(order, F.col(INSTRUMENT))).alias(INSTRUMENT)
    )
    return chosen.unionByName(spare.select(DATE, INSTRUMENT, F.lit(1.0).alias("weight")))
