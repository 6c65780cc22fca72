"""Exact ranks and quantiles of large groups, without a group in one task.

A date's cross-section grows with the number of instruments, so ``rank().over(date)``
would sort a whole date in a single task. The kernel here works on counts instead:

1. count rows per (group, value): ties collapse before the shuffle;
2. cut each group into slices of neighbouring values by a fixed, order-preserving
   function of the value, so a group is spread over many tasks;
3. accumulate counts inside a slice, and add the total of all lower slices, which
   comes from a table of at most a few thousand slices per group.

Groups that span the whole table are cut by their own values: a crowded slice is divided at its
quantiles, from a mergeable sketch, again and again until no slice is crowded, so a narrow band is
spread as evenly as a wide one. Cuts are stored, so that a recomputed task finds the same ones;
they decide the layout only, and ranks are exact with any cuts.

Ranks, quantiles and bins all follow from "rows below this value". Rows pick up their
position by an equi-join, where adaptive execution splits a heavily tied value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.sources.shared import stored

SLICES_PER_OCTAVE = 64
# Larger than SLICES_PER_OCTAVE * 1074, the largest |log2| of a double.
SLICE_ORIGIN = 100_000


# Text values are sliced by this many leading characters.
PREFIX = 8

# Distinct values that a slice of a pooled group may hold, and the number of pieces that a crowded one is cut into.
SLICE_VALUES = 65_536
PIECES = 64


def value_slice(value: Column, dtype: str = "double") -> Column:
    """Slice of a finite number or of a text: non-decreasing in the value, and free of any data pass."""
    if dtype == "string":
        return F.substring(value, 1, PREFIX)
    step = F.floor(F.log2(F.abs(value)) * SLICES_PER_OCTAVE) + SLICE_ORIGIN
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0).cast("bigint"))


def divided_slices(cells: DataFrame, by: Sequence[str], value: str, target: int | None = None) -> DataFrame:
    """``cells`` with slices of about ``target`` rows: crowded ones are cut at their own quantiles until none is left.

    ``_slice`` becomes an array, ordered as the values are. Quantiles come from Spark's mergeable sketch and may depend on the order in
    which it merges, so they are stored, and every use cuts at the same places. Only crowded slices are sketched: a sketch is far larger
    than the count of a slice. Equal values are never cut.
    """
    target = target or SLICE_VALUES
    cells, keys = cells.withColumn("_slice", F.array("_slice")), [*by, "_slice"]
    at = [i / PIECES for i in range(1, PIECES)]
    while True:
        held = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
        held = stored(held.where(F.col("_held") > target).drop("_held"), "crowded")
        if held.isEmpty():
            return cells
        crowded = cells.join(held, keys, "left_semi").groupBy(*keys)
        crowded = crowded.agg(F.array_distinct(F.percentile_approx(value, at, 50 * PIECES)).alias("_cuts"))
        # A single cut that is the greatest value would leave the slice as it is.
        crowded = stored(crowded.where(F.size("_cuts") > 1), "cuts")
        if crowded.isEmpty():
            return cells
        below = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
        piece = F.when(F.col("_cuts").isNotNull(), below).otherwise(0).cast("bigint")
        cells = cells.join(crowded, keys, "left").withColumn("_slice", F.concat("_slice", F.array(piece))).drop("_cuts")


def value_positions(
    df: DataFrame, by: Sequence[str], value: str, *then: str, pooled: bool = False, sums: Sequence[str] = ()
) -> DataFrame:
    """One row per group and distinct value: ``n`` rows, ``below`` rows before it, ``total`` in the group.

    ``then`` names further sort keys, counted as part of the value. ``pooled`` says that groups span the whole table, so slices
    follow the values of each group. ``sums`` names columns that are added up per value.
    """
    by, dtype = list(by), dict(df.dtypes)[value]
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value, *then)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
        .withColumn("_slice", value_slice(F.col(value), dtype))
    )
    if pooled and dtype != "string":
        # One row per distinct value, read for every division and for the result.
        cells = divided_slices(stored(cells, "values"), by, value)
    inside = Window.partitionBy(*by, "_slice").orderBy(value, *then)
    slices = cells.groupBy(*by, "_slice").agg(F.sum("n").alias("_in_slice"))
    in_order = Window.partitionBy(*by).orderBy("_slice")
    slices = slices.select(
        *by,
        "_slice",
        (F.sum("_in_slice").over(in_order) - F.col("_in_slice")).alias("_lower"),
        F.sum("_in_slice").over(Window.partitionBy(*by)).alias("total"),
    )
    cells = cells.withColumn("_before", F.sum("n").over(inside) - F.col("n"))
    return cells.join(slices, [*by, "_slice"]).select(
        *by, value, *then, "n", (F.col("_lower") + F.col("_before")).alias("below"), "total", *sums
    )


def with_average_ranks(
    df: DataFrame,
    by: Sequence[str],
    ranks: dict[str, str],
    total: str | None = None,
    among: dict[str, tuple[str, Column]] | None = None,
    pooled: bool = False,
    doubled: bool = False,
) -> DataFrame:
    """Add the 1-based rank in its group of every column in ``ranks`` (column: name of its rank).

    Ties share their average rank; null values get a null rank and do not count. ``doubled`` ranks are twice that, as
    whole numbers. ``total`` also
    adds the count of the first column. ``among`` maps a column to the name of a second rank that
    counts only the rows of a condition, from the same ordering.

    The rows themselves are shuffled once per column, by group and slice; only the slices' counts
    are joined to them. Equal values of one group stay together, so groups that span the whole
    table (``pooled``) go through ``value_positions``, where ties collapse before the shuffle.
    """
    ranked = df
    for value, rank in ranks.items():
        if pooled:
            twice = 2 * F.col("below") + F.col("n") + 1
            kept = [(twice if doubled else twice / 2).alias(rank)]
            kept += [F.col("total").alias(total)] if total else []
            positions = value_positions(df, by, value, pooled=True).select(*by, value, *kept)
            ranked = ranked.join(positions, [*by, value], "left")
        else:
            counted = {rank: F.col(value).isNotNull()}
            if among and value in among:
                name, condition = among[value]
                counted[name] = F.col(value).isNotNull() & condition
            ranked = _ranked_in_slices(df, ranked, by, value, counted, total, doubled)
        total = None
    return ranked


def _ranked_in_slices(
    source: DataFrame,
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    counted: dict[str, Column],
    total: str | None,
    doubled: bool,
) -> DataFrame:
    """``rows`` with a rank among the ``counted`` rows of ``source``, which hold the same values."""
    step = value_slice(F.col(value), dict(source.dtypes)[value]).alias("_slice")
    ones = {name: F.when(c, 1).otherwise(0).cast("bigint") for name, c in counted.items()}
    inside = Window.partitionBy(*by, "_slice").orderBy(value)
    tied = Window.partitionBy(*by, "_slice", value)
    placed = rows.withColumns({"_slice": step, **{f"_is_{n}": one for n, one in ones.items()}}).withColumns(
        {f"_at_{n}": 2 * F.sum(f"_is_{n}").over(inside) - F.sum(f"_is_{n}").over(tied) + 1 for n in ones}
    )
    slices = source.where(F.col(value).isNotNull()).groupBy(*by, step)
    slices = slices.agg(*[F.sum(one).alias(f"_in_{n}") for n, one in ones.items()])
    lower = Window.partitionBy(*by).orderBy("_slice")
    first = next(iter(ones))
    slices = slices.select(
        *by,
        "_slice",
        *[(F.sum(f"_in_{n}").over(lower) - F.col(f"_in_{n}")).alias(f"_lower_{n}") for n in ones],
        *([F.sum(f"_in_{first}").over(Window.partitionBy(*by)).alias(total)] if total else []),
    )
    found = placed.join(slices, [*by, "_slice"], "left")
    twice = {n: 2 * F.col(f"_lower_{n}") + F.col(f"_at_{n}") for n in ones}
    final = {n: F.when(F.col(f"_is_{n}") == 1, t if doubled else t / 2) for n, t in twice.items()}
    out = found.withColumns(final)
    return out.select(*rows.columns, *ones, *([total] if total else []))


def with_average_rank(
    df: DataFrame, by: Sequence[str], value: str, rank: str, total: str | None = None
) -> DataFrame:
    """``with_average_ranks`` for one column."""
    return with_average_ranks(df, by, {value: rank}, total)


def with_ordinal(
    df: DataFrame, by: Sequence[str], value: str, tiebreak: str, ordinal: str, total: str
) -> DataFrame:
    """Add the 1-based position of the row in its group, ordered by value and then ``tiebreak``.

    ``tiebreak`` must be unique in the group. Tied rows are ordered slice by slice of the tiebreak.
    """
    by = list(by)
    chunk = value_slice(F.col(tiebreak), dict(df.dtypes)[tiebreak])
    rows = df.where(F.col(value).isNotNull()).withColumn("_chunk", chunk)
    positions = value_positions(rows, by, value, "_chunk")
    inside = Window.partitionBy(*by, value, "_chunk").orderBy(tiebreak)
    rows = rows.withColumn("_inside", F.row_number().over(inside).cast("bigint"))
    placed = rows.join(positions, [*by, value, "_chunk"]).select(
        *df.columns,
        (F.col("below") + F.col("_inside")).alias(ordinal),
        F.col("total").alias(total),
    )
    missing = df.where(F.col(value).isNull()).select(
        *df.columns, F.lit(None).cast("bigint").alias(ordinal), F.lit(None).cast("bigint").alias(total)
    )
    return placed.unionByName(missing)


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    interpolation: str = "linear",
    median: str | None = None,
) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probabilities``, plus the count ``total``.

    ``interpolation`` is ``linear`` (between neighbouring order statistics) or ``nearest``.
    ``median`` names an additional median, which is always interpolated linearly.
    """
    wanted = {name: (p, interpolation == "nearest") for name, p in probabilities.items()}
    if median:
        wanted[median] = (0.5, False)
    picks, quantiles = [F.max("total").alias("total")], []
    for name, (p, nearest) in wanted.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        below, above = (F.floor(at + 0.5),) * 2 if nearest else (F.floor(at), F.ceil(at))
        for side, index in (("lo", below), ("hi", above)):
            holds = (F.col("below") <= index) & (index < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}_{name}"))
        weight = F.lit(0.0) if nearest else at - F.floor(at)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        quantiles.append((low + (high - low) * weight).alias(name))
    return value_positions(df, by, value).groupBy(*by).agg(*picks).select(*by, "total", *quantiles)
