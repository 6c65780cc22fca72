"""Per-date feature transforms, on long tables ``(datetime, instrument, factor, value)``.

A wide panel is unpivoted once; date and factor are then plain grouping keys, so one plan
serves any number of factors. Group statistics are aggregates joined back on the keys, and
ranks come from ``functions.ranks``: no date is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factorloom.functions import cells
from factorloom.functions.frames import DATE, INSTRUMENT
from factorloom.functions.numeric import clip, div, finite
from factorloom.functions.ranks import group_quantiles, with_average_rank
from factorloom.sources.shared import stored

FACTOR, VALUE = "factor", "value"
CELL = [DATE, FACTOR]


def to_long(panel: DataFrame, factors: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (date, instrument, factor); NaN and infinite values become null."""
    factors = list(factors)
    values = panel.select(DATE, INSTRUMENT, *keep, *[finite(F.col(f)).alias(f) for f in factors])
    return values.unpivot([DATE, INSTRUMENT, *keep], factors, FACTOR, VALUE)


def to_wide(long: DataFrame, factors: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """Back to one row per (date, instrument). The factor list is fixed, so no extra pass finds it.

    Rows are dealt before they are added up: a task of few large partitions would hold partial results as large as all its rows.
    """
    keys = [DATE, INSTRUMENT, *keep]
    wide = [F.first(F.when(F.col(FACTOR) == f, F.col(VALUE)), ignorenulls=True).alias(f) for f in factors]
    return long.repartition(*keys).groupBy(*keys).agg(*wide)


def winsorise(
    long: DataFrame, lower: float = 0.01, upper: float = 0.99, interpolation: str = "linear"
) -> DataFrame:
    """Clip values to the quantiles of their date and factor; fewer than two values pass unchanged."""
    edges = group_quantiles(long, CELL, VALUE, {"_lo": lower, "_hi": upper}, interpolation)
    return (
        long.join(edges, CELL, "left")
        .withColumn(VALUE, clip(F.col(VALUE), F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi", "total")
    )


def impute_median(long: DataFrame) -> DataFrame:
    """Replace missing values by the median of their date and factor."""
    medians = group_quantiles(long, CELL, VALUE, {"_median": 0.5})
    return (
        long.join(medians, CELL, "left")
        .withColumn(VALUE, F.coalesce(F.col(VALUE), F.col("_median")))
        .drop("_median", "total")
    )


def winsorise_and_impute(
    long: DataFrame, lower: float = 0.01, upper: float = 0.99, interpolation: str = "linear"
) -> DataFrame:
    """``impute_median(winsorise(long))`` from one set of quantiles.

    Clipping the outer thirds leaves the median where it was, so both edges and the median come
    from the same ordering. Only of two values both are clipped, and the median is their middle.
    """
    if lower > 1 / 3 or upper < 2 / 3:
        return impute_median(winsorise(long, lower, upper, interpolation))
    low, middle, high = F.col("_lo"), F.col("_mid"), F.col("_hi")
    edges = group_quantiles(long, CELL, VALUE, {"_lo": lower, "_hi": upper}, interpolation, median="_mid")
    median = F.when(F.col("total") == 2, low + (high - low) * 0.5).otherwise(middle)
    return (
        long.join(edges, CELL, "left")
        .withColumn(VALUE, F.coalesce(clip(F.col(VALUE), low, high), median))
        .drop("_lo", "_mid", "_hi", "total")
    )


def rank_transform(long: DataFrame) -> DataFrame:
    """Average rank over count, mapped to (-1, 1]."""
    ranked = with_average_rank(long, CELL, VALUE, "_rank", "_total")
    return ranked.withColumn(VALUE, F.col("_rank") / F.col("_total") * 2 - 1).drop("_rank", "_total")


def zscore(long: DataFrame) -> DataFrame:
    """Subtract the mean and divide by the standard deviation; a lone value passes unchanged."""
    stats = long.groupBy(*CELL).agg(
        F.avg(VALUE).alias("_mean"), F.stddev_samp(VALUE).alias("_std"), F.count(VALUE).alias("_n")
    )
    scaled = div(F.col(VALUE) - F.col("_mean"), F.col("_std"))
    return (
        long.join(stats, CELL, "left")
        .withColumn(VALUE, F.when(F.col("_n") < 2, F.col(VALUE)).otherwise(scaled))
        .drop("_mean", "_std", "_n")
    )


# Transforms selectable by name.
TRANSFORMS = {"rank_pct": rank_transform, "zscore": zscore}


def preprocess(
    long: DataFrame,
    transform: str = "rank_pct",
    winsorise_at: tuple[float, float] | None = (0.01, 0.99),
    impute: bool = True,
    interpolation: str = "linear",
) -> DataFrame:
    """Winsorise, impute the median, then transform. Screening leaves out the imputation."""
    if winsorise_at and impute:
        long = winsorise_and_impute(long, *winsorise_at, interpolation)
    elif winsorise_at:
        long = winsorise(long, *winsorise_at, interpolation)
    elif impute:
        long = impute_median(long)
    return TRANSFORMS[transform](long)


def preprocess_columns(table: DataFrame, factors: Iterable[str], keep: Sequence[str] = (), lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """``preprocess`` of a wide table with one row per date and instrument: clipped, imputed by the median and ranked per date.

    Rows are shuffled once to the cells of a date. A date too large for one cell is cut into a few columns each, which are shuffled once
    back, and dates too large for even that become long. What is stored are doubled ranks, as whole numbers; shares are made of them on reading.
    """
    factors, keys = list(factors), [DATE, INSTRUMENT, *keep]
    each, rows = cells.sizes(table, [DATE], len(factors))
    if not each or lower > 1 / 3 or upper < 2 / 3:
        long = preprocess(stored(to_long(table, factors, keep), "long"), winsorise_at=(lower, upper))
        return stored(to_wide(long, factors, keep), "prepared")
    whole = each == len(factors)
    each = each if whole else min(each, cells.COLUMNS)
    names, types = factors if whole else [f"_v{j}" for j in range(each)], dict(table.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], f"{cells.PART} int, _names int", *[f"{v} int" for v in names]])
    parts, date = {f: i // each for i, f in enumerate(factors)}, to_arrow_schema(table.select(DATE).schema)[0].type

    def measure(_: int, key: pa.Table, cell: pa.Table, columns: Iterator[tuple[str, np.ndarray]]) -> pa.Table:
        # Without a date there is no cross-section.
        n, day, part, ranked = cell.num_rows, key.column(DATE)[0], 0, []
        for name, x in columns:
            part = parts[name]
            twice = cells.winsorised_ranks(x, lower, upper) if day.is_valid else None
            ranked.append(pa.nulls(n, pa.int32()) if twice is None else pa.array(twice.astype(np.int32)))
        ranked += [pa.nulls(n, pa.int32())] * (len(names) - len(ranked))
        fixed = {DATE: pa.array([day.as_py()] * n, date), **{c: cell.column(c).combine_chunks() for c in keys[1:]}, cells.PART: pa.array([part] * n, pa.int32()), "_names": pa.array([n] * n, pa.int32())}
        found = pa.table({**fixed, **dict(zip(names, ranked))})
        # Small batches, for the other side holds a batch whole.
        return pa.Table.from_batches(found.to_batches(max_chunksize=10_000), found.schema)

    ranked = cells.per_cell(table, [DATE], factors, keys[1:], each, measure, schema, rows, once=True)
    if not whole:
        back = [F.max(F.when(F.col(cells.PART) == i // each, F.col(f"_v{i % each}"))).alias(f) for i, f in enumerate(factors)]
        # Dealt before they are added up: partial sums of a task would be as wide as the table.
        ranked = ranked.repartition(DATE, INSTRUMENT).groupBy(*keys).agg(F.max("_names").alias("_names"), *back)
    ranked = stored(ranked.select(*keys, "_names", *factors), "prepared", "zstd")
    return ranked.select(*keys, *[(F.col(f) / 2 / F.col("_names") * 2 - 1).alias(f) for f in factors])


def zero_missing(panel: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NaN, infinite and null features set to zero, as the tree models expect."""
    return panel.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in columns})
