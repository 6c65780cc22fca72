"""Null-safe arithmetic and statistics as column expressions.

Spark runs with ANSI semantics, under which ``x / 0`` and ``corr`` on a constant
input raise. The helpers here return null instead, and treat NaN and infinity as
missing, so that null is the only missing value downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# A standard deviation below this share of the mean is rounding residue of a constant input.
CONSTANT_TOLERANCE = 1e-12


def div(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; null where the denominator is zero."""
    return F.try_divide(numerator, denominator)


def finite(c: Column) -> Column:
    """The value as a double, with NaN and infinity replaced by null."""
    d = c.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Limit to ``[low, high]``; a null value stays null, a null bound does not bind."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def correlation(a: Column, b: Column, over: Window | None = None, min_count: int = 2) -> Column:
    """Pearson correlation on pairwise complete rows; null for constant inputs.

    Works as a group aggregate, or over a window frame when ``over`` is given.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)

    def agg(c: Column) -> Column:
        return c if over is None else c.over(over)

    sx, sy = agg(F.stddev_samp(x)), agg(F.stddev_samp(y))
    varies = (sx > F.abs(agg(F.avg(x))) * CONSTANT_TOLERANCE) & (
        sy > F.abs(agg(F.avg(y))) * CONSTANT_TOLERANCE
    )
    enough = agg(F.count(x)) >= min_count
    return F.when(varies & enough, div(agg(F.covar_samp(x, y)), sx * sy))


def exact_sum_of_products(a: Column, b: Column, wide: bool = False) -> Column:
    """Sum of the products of two whole-number columns, as a ``decimal``, without rounding.

    Each product is summed in two halves of 32 bits, which merge as plain numbers; ``wide`` is for products beyond 63 bits.
    """
    if wide:
        return F.sum(a.cast("decimal(19,0)") * b.cast("decimal(18,0)"))
    product = a * b
    high, low = F.sum(F.shiftright(product, 32)), F.sum(product.bitwiseAND(F.lit(0xFFFFFFFF)))
    return high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + low.cast("decimal(20,0)")


def rank_product_moment(a: Column, b: Column, min_count: int = 2, wide: bool = False) -> Column:
    """Correlation of two doubled average ranks of the same rows, as a group aggregate; null for constant inputs.

    Such ranks are whole numbers that sum to ``n * (n + 1)``, so the moments about their means are whole numbers too: the sign of
    the result is that of the exact one, and it is zero only if that is. Rows that lack either rank do not count.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    n = F.count(x)
    m = n.cast("decimal(13,0)")
    squares = (m * (m + 1)).cast("decimal(25,0)") * (m + 1).cast("decimal(13,0)")

    def moment(c: Column, d: Column) -> Column:
        return (exact_sum_of_products(c, d, wide) - squares).cast("double")

    spread = F.sqrt(moment(x, x)) * F.sqrt(moment(y, y))
    return F.when((n >= min_count) & (spread > 0), F.greatest(F.least(moment(x, y) / spread, F.lit(1.0)), F.lit(-1.0)))


def rank_sums_correlation(n: Column, xx: Column, xy: Column, yy: Column, min_count: int = 2) -> Column:
    """``rank_product_moment`` of ``n`` rows from the sums of products of their doubled ranks, ``decimal(38,0)``."""
    m = n.cast("decimal(13,0)")
    squares = (m * (m + 1)).cast("decimal(25,0)") * (m + 1).cast("decimal(13,0)")
    xx, xy, yy = ((total - squares).cast("double") for total in (xx, xy, yy))
    spread = F.sqrt(xx) * F.sqrt(yy)
    return F.when((n >= min_count) & (spread > 0), F.greatest(F.least(xy / spread, F.lit(1.0)), F.lit(-1.0)))


def round_double(c: Column, digits: int) -> Column:
    """``F.round`` of a double column, the same value for every input, without its decimal text where that cannot matter.

    ``F.round`` writes each number as text to find ties. Below 2**40 the scaled value is off by less than a thousandth, so
    its nearest whole number is the right one unless it is that close to a tie; whole number and power of ten are exact, so the
    quotient is the double nearest to the rounded decimal. Ties, large numbers and NaN go the long way.
    """
    if not 0 <= digits <= 22:
        return F.round(c, digits)
    scaled = c * F.lit(10.0**digits)
    whole = F.rint(scaled)
    sure = (F.abs(scaled) < 2.0**40) & (F.abs(scaled - whole) < 0.499)
    # Adding zero turns a negative zero into zero, as F.round does.
    return F.when(sure, (whole + F.lit(0.0)) / F.lit(10.0**digits)).otherwise(F.round(c, digits))


def rounded(df, digits: int = 6, **per_column: int | None):
    """Round every double column of a result table; ``per_column`` overrides ``digits``, None leaves as is."""
    chosen = {name: per_column.get(name, digits) for name, dtype in df.dtypes if dtype == "double"}
    return df.withColumns({name: round_double(F.col(name), d) for name, d in chosen.items() if d is not None})
