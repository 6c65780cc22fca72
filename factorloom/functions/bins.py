"""Per-group bins: equal-count with merged edges, equal-width, and the zero-aware variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.calendar import join_dates
from factorloom.functions.ranks import group_quantiles


def _join_groups(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    if len(by) == 1:
        return join_dates(df, per_group, by[0], "left")
    return df.join(per_group, list(by), "left")


def with_quantile_bin(df: DataFrame, by: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """Add the equal-count bin 0..bins-1 of ``value`` in its group; repeated edges merge bins.

    Edges are linear quantiles; a bin holds its upper edge, the first one also its lower edge.
    """
    names = [f"_q{i}" for i in range(bins + 1)]
    edges = group_quantiles(df, by, value, {n: i / bins for i, n in enumerate(names)})
    edges = edges.select(*by, F.array_distinct(F.array(*names)).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value))).cast("bigint")
    bin_ = F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0).cast("bigint")))
    return _join_groups(df, edges, by).withColumn(out, bin_).drop("_edges")


def with_width_bin(df: DataFrame, by: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """Add the equal-width bin 0..bins-1 of ``value`` between its group's minimum and maximum."""
    span = df.groupBy(*by).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    step = (F.col("_max") - F.col("_min")) / bins
    total = F.when(F.col(value).isNotNull(), F.lit(0).cast("bigint"))
    for i in range(1, bins):
        total = total + (F.col("_min") + step * i < F.col(value)).cast("bigint")
    return _join_groups(df, span, by).withColumn(out, total).drop("_min", "_max")


def with_zero_aware_bin(df: DataFrame, by: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """Bin negative values into the lower half of the bins and the others into the upper half."""
    half = bins // 2
    signed = df.withColumn("_positive", F.col(value) >= 0)
    binned = with_quantile_bin(signed, [*by, "_positive"], value, half, out)
    shifted = F.col(out) + F.when(F.col("_positive"), half).otherwise(0)
    return binned.withColumn(out, shifted.cast("bigint")).drop("_positive")
