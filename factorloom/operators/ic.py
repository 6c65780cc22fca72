"""Rank information coefficients: per-date Spearman correlation of a factor with a label."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factorloom.functions import cells
from factorloom.functions.frames import DATE, full, so_far, trailing
from factorloom.functions.numeric import div, rank_product_moment, rank_sums_correlation
from factorloom.functions.ranks import value_positions, with_average_ranks
from factorloom.operators.xsection import CELL, FACTOR, VALUE, to_long
from factorloom.sources.shared import stored

LABEL = "label"


def rank_correlation(
    df: DataFrame, by: Sequence[str], x: str = VALUE, y: str = LABEL, min_count: int = 2, out: str = "ic", pooled: bool = False
) -> DataFrame:
    """Spearman correlation per group over pairwise complete rows, with the number of pairs ``n``.

    Ranks are whole numbers until the last division, so an IC is zero, positive or negative as in exact arithmetic. ``pooled`` is
    for groups that span all dates.
    """
    pairs = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if pooled:
        # Groups of the whole table: the pairs are read to rank the label and again with its ranks.
        pairs = stored(pairs, "pairs")
        labels = label_ranks(pairs, by, y)
        return pooled_rank_correlation(pairs.join(labels.select(*by, y, "_ry"), [*by, y], "left"), by, x, labels, min_count, out)
    ranked = with_average_ranks(pairs, by, {x: "_rx", y: "_ry"}, doubled=True)
    rho = rank_product_moment(F.col("_rx"), F.col("_ry"), min_count)
    return ranked.groupBy(*by).agg(rho.alias(out), F.count(F.lit(1)).alias("n"))


def label_ranks(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """``(*by, label, _n, _ry)``: doubled average rank and count of every distinct label, in groups of the whole table. Stored."""
    positions = value_positions(rows, by, label, pooled=True)
    return stored(positions.select(*by, label, F.col("n").alias("_n"), _doubled_rank().alias("_ry")), "labels")


def _doubled_rank():
    return 2 * F.col("below") + F.col("n") + 1


def pooled_rank_correlation(
    rows: DataFrame, by: Sequence[str], x: str, labels: DataFrame, min_count: int = 2, out: str = "ic"
) -> DataFrame:
    """``rank_correlation`` of rows that have the rank of their label, ``_ry``; ``labels`` are the ``label_ranks`` of just these rows.

    The product of ranks needs only the sum of ``_ry`` over the rows of each value of ``x``, so rows are added up per value before they
    are shuffled, and no rank goes back to a row. ``labels`` may lack keys of ``by`` over which its ranks are the same.
    """
    keys = [c for c in by if c in labels.columns]
    whole = lambda c: c.cast("decimal(19,0)")
    rank = _doubled_rank().cast("decimal(18,0)")
    sums = value_positions(rows, by, x, pooled=True, sums=("_ry",)).groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(rank * whole(F.col("n") * _doubled_rank())).alias("_xx"),
        F.sum(rank * whole(F.col("_ry"))).alias("_xy"),
    )
    ry = F.col("_ry")
    squares = labels.groupBy(*keys).agg(F.sum(ry.cast("decimal(18,0)") * whole(F.col("_n") * ry)).alias("_yy"))
    both = sums.join(squares, keys, "left") if keys else sums.crossJoin(squares)
    rho = rank_sums_correlation(F.col("n"), F.col("_xx"), F.col("_xy"), F.col("_yy"), min_count)
    return both.select(*by, rho.alias(out), "n")


def column_rank_correlation(
    table: DataFrame, by: str | Sequence[str], factors: Sequence[str], label: str = LABEL, min_count: int = 2, pooled: bool = False
) -> DataFrame:
    """``rank_correlation`` of the label with each column in ``factors`` of a wide table: ``(*by, factor, ic, n)``.

    The wide rows are dealt by a few columns each, large tables in passes. Groups too large for a task become long and are ranked by slices.
    """
    by = [by] if isinstance(by, str) else list(by)
    for key in by:
        table = table.where(F.col(key).isNotNull())
    each, rows = cells.sizes(table, by)
    if not each:
        return _long_rank_correlation(table, by, factors, label, min_count, pooled)
    return _cell_rank_correlation(table, [(by, each)], factors, label, min_count, rows).drop(cells.CUT)


def column_rank_correlations(
    table: DataFrame, groupings: Sequence[Sequence[str]], factors: Sequence[str], label: str = LABEL, min_counts: Sequence[int] = (), pooled: Sequence[int] = ()
) -> list[DataFrame]:
    """``column_rank_correlation`` of several groupings, whose rows are computed once and dealt together; ``pooled`` has the numbers of those over all dates."""
    min_counts = list(min_counts) or [2] * len(groupings)
    held = [cells.sizes(table.where(F.concat(*[F.col(k).cast("string") for k in by]).isNotNull()), by) for by in groupings]
    cuts = [i for i, (each, _) in enumerate(held) if each]
    found = {i: _long_rank_correlation(table, by, factors, label, min_counts[i], i in pooled) for i, by in enumerate(groupings) if i not in cuts}
    if cuts:
        rows = max(held[i][1] for i in cuts)
        together = _cell_rank_correlation(table, [(groupings[i], held[i][0]) for i in cuts], factors, label, [min_counts[i] for i in cuts], rows)
        # One row per cell and factor, read once per grouping.
        together = stored(together, "correlations")
        for cut, i in enumerate(cuts):
            found[i] = together.where(F.col(cells.CUT) == cut).select(*groupings[i], FACTOR, "ic", "n")
    return [found[i] for i in range(len(groupings))]


def _long_rank_correlation(table: DataFrame, by: Sequence[str], factors: Sequence[str], label: str, min_count: int, pooled: bool) -> DataFrame:
    for key in by:
        table = table.where(F.col(key).isNotNull())
    keep = [c for c in (label, *by) if c != DATE]
    return rank_correlation(to_long(table, factors, keep), [*by, FACTOR], y=label, min_count=min_count, pooled=pooled)


def _cell_rank_correlation(
    table: DataFrame, cuts: Sequence[tuple[Sequence[str], int]], factors: Sequence[str], label: str, min_count: int | Sequence[int], rows: int
) -> DataFrame:
    """``(_cut, *keys, factor, ic, n)`` of all groupings, with the keys of each."""
    types, keys = dict(table.dtypes), list(dict.fromkeys(k for by, _ in cuts for k in by))
    arrow = {f.name: f.type for f in to_arrow_schema(table.select(*keys).schema)}
    least = [min_count] * len(cuts) if isinstance(min_count, int) else list(min_count)
    schema = ", ".join([f"{cells.CUT} int", *[f"{key} {types[key]}" for key in keys], f"{FACTOR} string, ic double, n long"])

    def measure(cut: int, key: pa.Table, cell: pa.Table, columns: Iterator[tuple[str, np.ndarray]]) -> pa.Table:
        labelled, ranks = cells.known(cell.column(label)), cells.LabelRanks(cell.column(label).to_numpy())
        found = []
        for name, x in columns:
            pair = labelled & (x == x)
            if pair.any():
                found.append((name, cells.rank_product_moment(cells.doubled_ranks(x[pair]), ranks(pair), least[cut]), int(pair.sum())))
        names, ics, counts = zip(*found) if found else ((), (), ())
        of = {k: pa.array([key.column(k)[0].as_py() if k in key.column_names else None] * len(found), arrow[k]) for k in keys}
        return pa.table(
            {cells.CUT: pa.array([cut] * len(found), pa.int32()), **of, FACTOR: pa.array(names, pa.string()), "ic": pa.array(ics, pa.float64()), "n": pa.array(counts, pa.int64())}
        )

    return cells.per_cells(table, cuts, factors, [label], measure, schema, rows)


def daily_rank_ic(long: DataFrame, min_names: int = 5, factors: Sequence[str] | None = None) -> DataFrame:
    """``(datetime, factor, ic, n)`` for dates with at least ``min_names`` pairs and a defined IC.

    With ``factors`` the table is wide: it has a column for each of them.
    """
    if factors is not None:
        return column_rank_correlation(long, DATE, factors, min_count=min_names).where(F.col("ic").isNotNull())
    return rank_correlation(long, CELL, min_count=min_names).where(F.col("ic").isNotNull())


def ic_summary(daily: DataFrame, by: Sequence[str] = (FACTOR,)) -> DataFrame:
    """Mean, standard deviation, ratio of the two, share of positive dates and number of dates.

    With fewer than two dates all statistics are zero.
    """
    ic = F.col("ic")
    stats = daily.where(ic.isNotNull()).groupBy(*by).agg(
        F.avg(ic).alias("_mean"),
        F.stddev_samp(ic).alias("_std"),
        F.avg((ic > 0).cast("double")).alias("_win"),
        F.count(ic).alias("n_days"),
    )

    def if_defined(c):
        return F.when(F.col("n_days") >= 2, c).otherwise(0.0)

    return stats.select(
        *by,
        if_defined(F.col("_mean")).alias("ic_mean"),
        if_defined(F.col("_std")).alias("ic_std"),
        if_defined(F.when(F.col("_std") > 0, div(F.col("_mean"), F.col("_std"))).otherwise(0.0)).alias("icir"),
        if_defined(F.col("_win")).alias("win_rate"),
        "n_days",
    )


def monthly_ic(daily: DataFrame, by: Sequence[str] = (FACTOR,), period: str = "month") -> DataFrame:
    """Mean IC per calendar period."""
    return daily.groupBy(*by, F.to_date(F.trunc(DATE, period)).alias("period")).agg(F.avg("ic").alias("ic"))


def yearly_ic(daily: DataFrame, by: Sequence[str] = (FACTOR,)) -> DataFrame:
    return daily.groupBy(*by, F.year(DATE).cast("bigint").alias("year")).agg(F.avg("ic").alias("ic"))


def rolling_ic(daily: DataFrame, rows: int, by: Sequence[str] = (FACTOR,)) -> DataFrame:
    """Rolling mean over the last ``rows`` dates and the running sum, per factor.

    A factor has one row per date here, so the window is bounded by the calendar.
    """
    spec = Window.partitionBy(*by).orderBy(DATE)
    ic = F.col("ic")
    return daily.select(
        *by,
        DATE,
        ic,
        full(F.avg(ic), ic, trailing(spec, rows), rows).alias("rolling_ic"),
        F.sum(ic).over(so_far(spec)).alias("cumulative_ic"),
    )


def direction(daily: DataFrame, by: Sequence[str] = (FACTOR,)) -> DataFrame:
    """-1 where the mean IC is negative, else 1."""
    return daily.groupBy(*by).agg(
        F.when(F.avg("ic") < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint").alias("direction")
    )


def oriented(signals: DataFrame, validation_ic: DataFrame, value: str = VALUE) -> DataFrame:
    """Flip the signals whose validation IC is negative."""
    # One row per factor column of the panel: a few hundred at most.
    flips = F.broadcast(direction(validation_ic))
    return signals.join(flips, FACTOR).withColumn(value, F.col(value) * F.col("direction"))
