"""Factor screening, one table per ring: quality, profile, filter, stability, redundancy, choice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import cells
from factorloom.functions.frames import DATE, INSTRUMENT, full, trailing
from factorloom.functions.numeric import correlation, div, finite, rank_product_moment
from factorloom.functions.ranks import value_positions, with_average_rank, with_average_ranks
from factorloom.operators.ic import LABEL, column_rank_correlation, column_rank_correlations, daily_rank_ic, ic_summary, rank_correlation, yearly_ic
from factorloom.operators.xsection import CELL, FACTOR, VALUE, to_long
from factorloom.sources.shared import stored

# Screening thresholds and score weights.
MIN_COVERAGE = 0.5
CONSTANT_STD = 1e-8
MIN_ABS_IC = 0.01
MIN_DAY_COVERAGE = 0.60
ROLLING_DAYS = 60
STABILITY_WEIGHTS = (0.4, 0.3, 0.3)
CHOICE_WEIGHTS = {"icir": 0.30, "monotonicity": 0.20, "long_short": 0.20, "stability_score": 0.30}


# --- ring 0: data quality -------------------------------------------------------------


def without_infinite(panel: DataFrame, factors: Iterable[str]) -> DataFrame:
    """NaN and infinite factor values become null."""
    return panel.withColumns({f: finite(F.col(f)) for f in factors})


def factor_quality(
    panel: DataFrame, factors: Iterable[str], min_coverage: float = MIN_COVERAGE, constant_std: float = CONSTANT_STD
) -> DataFrame:
    """Coverage and spread of every factor from one scan, with the reason for rejection.

    Only low coverage removes a factor (``dropped``); a constant one is merely reported.
    """
    factors = list(factors)
    stats = panel.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(finite(F.col(f))).alias(f"n_{f}") for f in factors],
        *[F.stddev_samp(finite(F.col(f))).alias(f"s_{f}") for f in factors],
    )
    entries = [
        F.struct(
            F.lit(f).alias("factor"),
            div(F.col(f"n_{f}").cast("double"), F.col("_rows")).alias("coverage"),
            F.col(f"s_{f}").alias("std"),
            F.col(f"n_{f}").alias("n"),
        )
        for f in factors
    ]
    constant = F.coalesce((F.col("n") >= 2) & (F.coalesce("std", F.lit(0.0)) < constant_std), F.lit(False))
    low = F.coalesce(F.col("coverage"), F.lit(0.0)) < min_coverage
    reasons = F.concat_ws(
        "; ", F.when(constant, F.lit("hardly varies")), F.when(low, F.lit("too often missing"))
    )
    return (
        stats.select(F.inline(F.array(*entries)))
        .withColumn("reason", reasons)
        .withColumn("dropped", low)
        .select("factor", "coverage", "std", "reason", "dropped")
    )


def label_quality(panel: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Mean, standard deviation and missing share of every label, from one scan."""
    labels = list(labels)
    stats = panel.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(c).alias(f"m_{c}") for c in labels],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in labels],
        *[F.count(c).alias(f"n_{c}") for c in labels],
    )
    entries = [
        F.struct(
            F.lit(c).alias("label"),
            F.col(f"m_{c}").alias("mean"),
            F.col(f"s_{c}").alias("std"),
            (1 - div(F.col(f"n_{c}").cast("double"), F.col("_rows"))).alias("null_pct"),
        )
        for c in labels
    ]
    return stats.select(F.inline(F.array(*entries)))


# --- ring 2: profile ------------------------------------------------------------------


def group_returns(long: DataFrame, groups: int = 5, mode: str = "even") -> DataFrame:
    """Mean label of each factor bucket: ``(factor, bucket, mean_label, n)``, buckets from 1.

    ``mode='even'`` uses ceil(rank/n*k). ``mode='literal'`` uses floor(clip(rank/n*k - 1, 0, k-1)) + 1,
    whose lowest bucket spans two fifths of the names and whose highest holds only the top rank.
    """
    ranked = with_average_rank(long, CELL, VALUE, "_rank", "_total")
    bucket = _bucket(F.col("_rank"), F.col("_total"), groups, mode)
    return (
        ranked.where(F.col("_rank").isNotNull())
        .groupBy(FACTOR, bucket.alias("bucket"))
        .agg(F.avg(LABEL).alias("mean_label"), F.count(LABEL).alias("n"))
    )


def _bucket(rank: Column, total: Column, groups: int, mode: str) -> Column:
    position = rank / total * groups
    if mode == "even":
        return F.ceil(position).cast("bigint")
    return (F.floor(F.least(F.greatest(position - 1, F.lit(0.0)), F.lit(float(groups - 1)))) + 1).cast("bigint")


def spread_and_monotonicity(returns: DataFrame, groups: int = 5) -> DataFrame:
    """Top minus bottom bucket, and the rank correlation of bucket number with mean label (3 buckets at least)."""
    known = returns.where(F.col("mean_label").isNotNull())
    tops = known.groupBy(FACTOR).agg(
        F.coalesce(F.max(F.when(F.col("bucket") == groups, F.col("mean_label"))), F.lit(0.0)).alias("_top"),
        F.coalesce(F.max(F.when(F.col("bucket") == 1, F.col("mean_label"))), F.lit(0.0)).alias("_bottom"),
    )
    trend = rank_correlation(
        known.withColumn("bucket", F.col("bucket").cast("double")), [FACTOR], "bucket", "mean_label", 3, "_mono"
    )
    return tops.join(trend, FACTOR, "left").select(
        FACTOR,
        (F.col("_top") - F.col("_bottom")).alias("long_short"),
        F.coalesce("_mono", F.lit(0.0)).alias("monotonicity"),
    )


def profile(long: DataFrame, groups: int = 5, mode: str = "even", min_names: int = 2, factors: Sequence[str] | None = None) -> DataFrame:
    """IC summary, long-short return and monotonicity of every factor, of a long table or of the columns ``factors``.

    Each cell of date and factor is ranked once, and the correlation and the bucket sums leave it in one
    aggregation, so what goes on is one row per cell; these are stored, as they are read several times.
    """
    found = profile_cells(long, groups, mode, min_names) if factors is None else profile_columns(long, factors, groups, mode, min_names)
    found = stored(found, "profile")
    sums = found.groupBy(FACTOR).agg(
        *[F.sum(f"_sum_{b}").alias(f"_sum_{b}") for b in range(1, groups + 1)],
        *[F.sum(f"_n_{b}").alias(f"_n_{b}") for b in range(1, groups + 1)],
    )
    entries = [
        F.struct(F.lit(b).cast("bigint").alias("bucket"), div(F.col(f"_sum_{b}"), F.col(f"_n_{b}")).alias("mean_label"))
        for b in range(1, groups + 1)
    ]
    returns = sums.select(FACTOR, F.inline(F.array(*entries)))
    ics = ic_summary(found.where(F.col("ic").isNotNull()))
    return ics.join(spread_and_monotonicity(returns, groups), FACTOR, "left")


def profile_cells(long: DataFrame, groups: int = 5, mode: str = "even", min_names: int = 2) -> DataFrame:
    """Per date and factor: rank IC ``ic`` (null below ``min_names`` pairs), and label sums and counts of every bucket."""
    pair = F.col(LABEL).isNotNull()
    rows = long.select(*CELL, VALUE, LABEL).where(F.col(VALUE).isNotNull())
    ranked = with_average_ranks(rows, CELL, {VALUE: "_rank", LABEL: "_ry"}, "_total", {VALUE: ("_rx", pair)}, doubled=True)
    bucket = _bucket(F.col("_rank") / 2, F.col("_total"), groups, mode)
    rho = rank_product_moment(F.col("_rx"), F.col("_ry"), min_names)
    inside = {b: (bucket == b) & pair for b in range(1, groups + 1)}
    return ranked.groupBy(*CELL).agg(
        rho.alias("ic"),
        *[F.sum(F.when(c, F.col(LABEL))).alias(f"_sum_{b}") for b, c in inside.items()],
        *[F.sum(F.when(c, 1).otherwise(0)).alias(f"_n_{b}") for b, c in inside.items()],
    )


def profile_columns(table: DataFrame, factors: Sequence[str], groups: int = 5, mode: str = "even", min_names: int = 2) -> DataFrame:
    """``profile_cells`` of the columns of a wide table, in one shuffle; dates too large for a task become long."""
    table = table.where(F.col(DATE).isNotNull())
    each, rows = cells.sizes(table, [DATE])
    if not each:
        return profile_cells(to_long(table, factors, [LABEL]), groups, mode, min_names)
    sums, counts = [f"_sum_{b}" for b in range(1, groups + 1)], [f"_n_{b}" for b in range(1, groups + 1)]
    names = [DATE, FACTOR, "ic", *sums, *counts]
    schema = f"{DATE} {dict(table.dtypes)[DATE]}, {FACTOR} string, ic double, {', '.join(f'{c} double' for c in sums)}, {', '.join(f'{c} long' for c in counts)}"

    def measure(_: int, key: pa.Table, cell: pa.Table, columns: Iterator[tuple[str, np.ndarray]]) -> pa.Table:
        label, labelled = cell.column(LABEL).to_numpy(), cells.known(cell.column(LABEL))
        ranks, found = cells.LabelRanks(label), []
        for name, x in columns:
            here = x == x
            total = int(here.sum())
            if not total:
                continue
            twice = np.zeros(len(x), np.int64)
            twice[here] = cells.doubled_ranks(x[here])
            pair = here & labelled
            among = twice[pair] if total == pair.sum() else cells.doubled_ranks(x[pair])
            position = twice[pair] / 2 / total * groups
            if mode == "even":
                bucket = np.ceil(position).astype(int)
            else:
                bucket = np.floor(np.minimum(np.maximum(position - 1, 0.0), groups - 1.0)).astype(int) + 1
            n = np.bincount(bucket, minlength=groups + 1)[1:]
            added = np.bincount(bucket, label[pair], groups + 1)[1:]
            ic = cells.rank_product_moment(among, ranks(pair), min_names) if len(among) else None
            found.append((key.column(DATE)[0].as_py(), name, ic, *[float(s) if c else None for s, c in zip(added, n)], *map(int, n)))
        types = [key.column(DATE).type, pa.string(), pa.float64(), *[pa.float64()] * groups, *[pa.int64()] * groups]
        return pa.table({c: pa.array([row[i] for row in found], t) for i, (c, t) in enumerate(zip(names, types))})

    return cells.per_cell(table, [DATE], factors, [LABEL], each, measure, schema, rows)


# --- ring 3: filter -------------------------------------------------------------------


def cross_section_filter(
    summary: DataFrame, min_abs_ic: float = MIN_ABS_IC, min_coverage: float = MIN_DAY_COVERAGE
) -> DataFrame:
    """Keep factors with enough absolute IC and enough dates; the reasons name what failed."""
    most = F.max("n_days").over(Window.partitionBy())
    rows = summary.withColumn("coverage", F.col("n_days") / F.greatest(most, F.lit(1)))
    weak, short = F.abs("ic_mean") < min_abs_ic, F.col("coverage") < min_coverage
    reasons = F.concat_ws(
        "; ",
        F.when(weak, F.format_string(f"|IC| %.4f below {min_abs_ic}", F.abs("ic_mean"))),
        F.when(short, F.format_string(f"IC on %.2f%% of dates, below {min_coverage * 100:.0f}%%", F.col("coverage") * 100)),
    )
    return rows.select(FACTOR, "ic_mean", "coverage", (~(weak | short)).alias("retained"), reasons.alias("reason"))


# --- ring 4: stability ----------------------------------------------------------------


def with_size_stratum(long: DataFrame, size: str = INSTRUMENT) -> DataFrame:
    """Add ``stratum`` small/mid/large by dense rank per date, cut at 0.33 and 0.66 of the largest rank.

    The default orders by the instrument code; pass a numeric column such as market value.
    """
    sizes = long.select(DATE, F.col(size).alias("_size")).distinct()
    rank, most = F.col("below") + 1, F.col("total")
    stratum = F.when(rank <= most * 0.33, "small").when(rank <= most * 0.66, "mid").otherwise("large")
    strata = value_positions(sizes, [DATE], "_size").select(DATE, "_size", stratum.alias("stratum"))
    return long.withColumn("_size", F.col(size)).join(strata, [DATE, "_size"], "left").drop("_size")


def stratum_ic(long: DataFrame, size: str = INSTRUMENT, factors: Sequence[str] | None = None) -> DataFrame:
    """Rank correlation pooled over all dates, per factor and size stratum, of a long table or of the columns ``factors``.

    A table that has a ``stratum`` keeps it.
    """
    rows = long if "stratum" in long.columns else with_size_stratum(long, size)
    if factors is not None:
        return column_rank_correlation(rows, "stratum", factors, pooled=True)
    return rank_correlation(rows, [FACTOR, "stratum"], pooled=True)


def stability(
    long: DataFrame, size: str = INSTRUMENT, rolling_days: int = ROLLING_DAYS, min_names: int = 2, factors: Sequence[str] | None = None
) -> DataFrame:
    """Score from the spread of yearly ICs, of the rolling mean IC and of the stratum ICs, of a long table or of the columns ``factors``."""
    # One row per date and factor, read twice.
    if factors is None:
        daily, strata = stored(daily_rank_ic(long, min_names), "daily"), stratum_ic(long, size)
    else:
        # Both groupings are dealt together, so the columns are computed once and need not be stored.
        rows = long if "stratum" in long.columns else with_size_stratum(long, size)
        daily, strata = column_rank_correlations(rows, [[DATE], ["stratum"]], factors, min_counts=(min_names, 2), pooled=(1,))
        daily = daily.where(F.col("ic").isNotNull())
    by_year = yearly_ic(daily).groupBy(FACTOR).agg(F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("year_std"))
    spec = Window.partitionBy(FACTOR).orderBy(DATE)
    ic = F.col("ic")
    smooth = daily.withColumn("_roll", full(F.avg(ic), ic, trailing(spec, rolling_days), rolling_days))
    by_roll = smooth.groupBy(FACTOR).agg(
        F.count("ic").alias("_days"),
        F.coalesce(F.avg("_roll"), F.lit(0.0)).alias("rolling_ic_mean"),
        F.coalesce(F.stddev_samp("_roll"), F.lit(1.0)).alias("rolling_ic_std"),
    )
    by_size = strata.groupBy(FACTOR).agg(F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("size_std"))
    w_year, w_roll, w_size = STABILITY_WEIGHTS
    score = (
        w_year * (1 - F.col("year_std")) + w_roll / (1 + F.col("rolling_ic_std")) + w_size * (1 - F.col("size_std"))
    )
    return (
        by_roll.join(by_year, FACTOR)
        .join(by_size, FACTOR)
        .select(
            FACTOR,
            "year_std",
            "rolling_ic_mean",
            "rolling_ic_std",
            "size_std",
            F.when(F.col("_days") >= 2, score).otherwise(0.0).alias("stability_score"),
        )
    )


# --- ring 5: redundancy ---------------------------------------------------------------


def ic_distance(daily: DataFrame, n_factors: int) -> DataFrame:
    """Pearson correlation of the daily ICs of each pair of factors, and its distance sqrt((1 - r) / 2).

    Only dates on which all ``n_factors`` factors have an IC count. Factors are columns of the
    panel, so the pairs on one date are bounded by the square of the column count.
    """
    complete = daily.groupBy(DATE).agg(F.count("ic").alias("_known")).where(F.col("_known") == n_factors)
    series = daily.join(complete, DATE, "left_semi").select(DATE, FACTOR, "ic")
    left = series.select(DATE, F.col(FACTOR).alias("factor_a"), F.col("ic").alias("_a"))
    right = series.select(DATE, F.col(FACTOR).alias("factor_b"), F.col("ic").alias("_b"))
    rho = F.coalesce(correlation(F.col("_a"), F.col("_b")), F.lit(0.0))
    pairs = left.join(right, DATE).groupBy("factor_a", "factor_b").agg(rho.alias("corr"))
    return pairs.withColumn("distance", F.sqrt(F.greatest((1 - F.col("corr")) / 2, F.lit(0.0))))


# --- ring 6: representatives ----------------------------------------------------------


def representatives(metrics: DataFrame, per_cluster: int = 2) -> DataFrame:
    """Best factors of each cluster by a weighted sum of min-max normalised measures.

    ``metrics`` has factor, cluster, icir, monotonicity, long_short and stability_score.
    """
    cluster = Window.partitionBy("cluster")
    missing = {"stability_score": 0.5}
    score = F.lit(0.0)
    for name, weight in CHOICE_WEIGHTS.items():
        raw = F.coalesce(F.col(name), F.lit(missing.get(name, 0.0)))
        # Rounding keeps summation noise from being stretched to the whole range.
        x = F.round(raw if name in missing else F.abs(raw), 12)
        low, high = F.min(x).over(cluster), F.max(x).over(cluster)
        score = score + weight * F.when(high == low, 0.5).otherwise(div(x - low, high - low))
    best_first = Window.partitionBy("cluster").orderBy(F.desc("score"), FACTOR)
    return (
        metrics.withColumn("score", score)
        .withColumn("rank_in_cluster", F.row_number().over(best_first).cast("bigint"))
        .where(F.col("rank_in_cluster") <= per_cluster)
        .select(FACTOR, "cluster", "score", "rank_in_cluster")
    )


# --- ring 7: composite signals --------------------------------------------------------


def signal_weights(summary: DataFrame) -> DataFrame:
    """Weights of the three composites, a row per factor: equal, by absolute IC, by IC ratio."""
    whole = Window.partitionBy()
    abs_ic, icir = F.abs("ic_mean"), F.col("icir")
    return summary.select(
        FACTOR,
        (1 / F.count(F.lit(1)).over(whole).cast("double")).alias("equal_weight"),
        (abs_ic / F.greatest(F.sum(abs_ic).over(whole), F.lit(1e-8))).alias("ic_weight"),
        (icir / F.greatest(F.abs(F.sum(icir).over(whole)), F.lit(1e-8))).alias("icir_weight"),
    )


PORTFOLIOS = ("equal_weight", "ic_weight", "icir_weight")


def composite_signals(long: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sums of the factors per name, one row per composite; null where any factor is missing.

    The three sums leave one aggregation; rows are only tripled after it, per date and name.
    """
    # One row per factor column; joining by shuffle would put a whole factor into one task.
    joined = long.join(F.broadcast(weights), FACTOR)
    complete = F.count(F.lit(1)) == F.count(VALUE)
    sums = joined.groupBy(DATE, INSTRUMENT).agg(
        *[F.when(complete, F.sum(F.col(VALUE) * F.col(p))).alias(p) for p in PORTFOLIOS], F.first(LABEL).alias(LABEL)
    )
    return sums.unpivot([DATE, INSTRUMENT, LABEL], list(PORTFOLIOS), "portfolio", "signal")


def composite_columns(table: DataFrame, factors: Sequence[str], weights: DataFrame) -> DataFrame:
    """``composite_signals`` of a wide table with one row per date and name: sums along the rows, nothing is shuffled."""
    factors = list(factors)
    # One row with the weights in the order of the columns; a factor without weights has no part.
    by_factor = weights.where(F.col(FACTOR).isin(factors)).agg(F.map_from_entries(F.collect_list(F.struct(FACTOR, F.struct(*PORTFOLIOS)))).alias("_w"))
    ordered = F.transform(F.array(*[F.lit(f) for f in factors]), lambda f: F.try_element_at("_w", f))
    line = by_factor.where(F.size("_w") > 0).select(ordered.alias("_w"))
    rows = table.select(DATE, INSTRUMENT, LABEL, F.array(*[finite(F.col(f)) for f in factors]).alias("_x")).crossJoin(F.broadcast(line))
    # Null where a factor that counts is missing.
    sums = {
        p: F.aggregate(F.zip_with("_x", "_w", lambda x, w: F.when(w.isNull(), 0.0).otherwise(x * w[p])), F.lit(0.0), lambda a, b: a + b)
        for p in PORTFOLIOS
    }
    return rows.select(DATE, INSTRUMENT, LABEL, *[s.alias(p) for p, s in sums.items()]).unpivot([DATE, INSTRUMENT, LABEL], list(PORTFOLIOS), "portfolio", "signal")


def composite_report(signals: DataFrame) -> DataFrame:
    """IC statistics of each composite and ``turnover`` = 1 - |lag-one autocorrelation of the daily IC|."""
    daily = rank_correlation(signals, ["portfolio", DATE], "signal").where(F.col("ic").isNotNull())
    spec = Window.partitionBy("portfolio").orderBy(DATE)
    lagged = daily.withColumn("_prior", F.lag("ic").over(spec))
    auto = lagged.groupBy("portfolio").agg(
        F.coalesce(correlation(F.col("_prior"), F.col("ic")), F.lit(0.0)).alias("_auto")
    )
    return (
        ic_summary(daily, ["portfolio"])
        .join(auto, "portfolio")
        .withColumn("turnover", 1 - F.abs("_auto"))
        .drop("_auto")
    )


# --- report ---------------------------------------------------------------------------


def screening_log(quality: DataFrame, filtered: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per ring and factor: whether it passed, and why not."""
    return (
        quality.select(F.lit("quality").alias("ring"), "factor", (~F.col("dropped")).alias("passed"), "reason")
        .unionByName(filtered.select(F.lit("filter").alias("ring"), "factor", F.col("retained").alias("passed"), "reason"))
        .unionByName(
            filtered.where("retained")
            .join(chosen.select("factor", F.lit(True).alias("passed")), "factor", "left")
            .select(
                F.lit("choice").alias("ring"),
                "factor",
                F.coalesce("passed", F.lit(False)).alias("passed"),
                F.when(F.col("passed"), "").otherwise("others of its group are better").alias("reason"),
            )
        )
    )
