"""The factor library: 9 bar shapes, 4 price levels and 29 rolling factors for each of 5 windows.

Factors are formulas over the statistics of ``functions.rolling``, so all factors of a table
share a single shuffle and sort by instrument. Dates are filtered before the windows run:
the first rows of the requested range are warm-up and stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from factorloom.functions.frames import DATE, INSTRUMENT, history
from factorloom.functions.numeric import div
from factorloom.functions.rolling import Rolling
from factorloom.operators.history import block_window, number_rows, overlapping_blocks, own_rows

# Window lengths and the small terms that keep denominators away from zero.
WINDOWS = (5, 10, 20, 30, 60)
PRICE_EPS = 1e-8
SUM_EPS = 1e-12

OPEN, HIGH, LOW, CLOSE, VOLUME, AMOUNT = "open", "high", "low", "close", "volume", "amount"


def bar_shape() -> dict[str, Column]:
    """Body, range and shadows of a single bar, relative to the open or to the range."""
    o, h, low, c = (F.col(x) for x in (OPEN, HIGH, LOW, CLOSE))
    by_open = o + PRICE_EPS
    by_range = h - low + PRICE_EPS
    upper = h - F.greatest(o, c)
    lower = F.least(o, c) - low
    return {
        "KMID": div(c - o, by_open),
        "KLEN": div(h - low, by_open),
        "KMID2": div(c - o, by_range),
        "KUP": div(upper, by_open),
        "KUP2": div(upper, by_range),
        "KLOW": div(lower, by_open),
        "KLOW2": div(lower, by_range),
        "KSFT": div(c - low, by_range),
        "KSFT2": div(2 * c - h - low, by_range),
    }


def price_level() -> dict[str, Column]:
    """Open, high, low and average traded price relative to the close."""
    c = F.col(CLOSE)
    traded = div(F.col(AMOUNT), F.col(VOLUME) * 100 + PRICE_EPS)
    return {
        "OPEN0": div(F.col(OPEN), c) - 1,
        "HIGH0": div(F.col(HIGH), c) - 1,
        "LOW0": div(F.col(LOW), c) - 1,
        "VWAP0": div(traded, c) - 1,
    }


def with_changes(bars: DataFrame, spec: WindowSpec) -> DataFrame:
    """Row number ``t`` and one-step changes of price and volume, the inputs of the rolling factors."""
    if "t" not in bars.columns:
        bars = bars.withColumn("t", (F.row_number().over(spec) - 1).cast("bigint"))
    staged = bars.withColumns({"_c1": F.lag(CLOSE, 1).over(spec), "_v1": F.lag(VOLUME, 1).over(spec)})
    c, v = F.col(CLOSE), F.col(VOLUME)
    ret = div(c, F.col("_c1"))
    price_change, volume_change = c - F.col("_c1"), v - F.col("_v1")
    zero = F.lit(0.0)
    return staged.withColumns(
        {
            "t": F.col("t").cast("double"),
            "tc": F.col("t") * c,
            "ret": ret,
            "log_volume": F.log(v + 1),
            "log_volume_ratio": F.log(div(v, F.col("_v1")) + 1),
            "up": (c > F.col("_c1")).cast("double"),
            "down": (c < F.col("_c1")).cast("double"),
            "weighted_move": F.abs(ret - 1) * v,
            # greatest() ignores null, so the missing first change counts as zero gain and zero loss.
            "price_gain": F.greatest(zero, price_change),
            "price_loss": F.greatest(zero, -price_change),
            "price_move": F.abs(price_change),
            "volume_gain": F.greatest(zero, volume_change),
            "volume_loss": F.greatest(zero, -volume_change),
            "volume_move": F.abs(volume_change),
            # Window lists keep missing prices in place, ordered after (or before) every price.
            "close_or_nan": F.coalesce(c, F.lit(float("nan"))),
            "high_or_least": F.coalesce(F.col(HIGH), F.lit(float("-inf"))),
            "low_or_most": F.coalesce(F.col(LOW), F.lit(float("inf"))),
        }
    ).drop("_c1", "_v1")


def trend(w: int, roll: Rolling) -> dict[str, Column]:
    c = F.col(CLOSE)
    return {
        f"ROC{w}": div(c, roll.lag(CLOSE, w)) - 1,
        f"MA{w}": div(roll.mean(CLOSE, w), c) - 1,
        f"STD{w}": div(roll.std(CLOSE, w), c),
    }


def extremes(w: int, roll: Rolling) -> dict[str, Column]:
    c = F.col(CLOSE)
    return {f"MAX{w}": div(roll.max(CLOSE, w), c) - 1, f"MIN{w}": div(roll.min(CLOSE, w), c) - 1}


def quantile_levels(w: int, roll: Rolling, interpolation: str = "linear") -> dict[str, Column]:
    """Upper and lower rolling quantile of the close; any number of observations is enough."""
    c = F.col(CLOSE)
    ordered, n = roll.descending("close_or_nan", w), roll.observed(CLOSE, w)

    def smallest(index: Column) -> Column:
        return F.try_element_at(ordered, -(index.cast("int") + 1))

    def level(p: float) -> Column:
        at = (n - 1) * F.lit(p)
        if interpolation == "nearest":
            return smallest(F.floor(at + 0.5))
        low, high = smallest(F.floor(at)), smallest(F.ceil(at))
        return low + (high - low) * (at - F.floor(at))

    return {name: F.when(n > 0, div(level(p), c)) for name, p in ((f"QTLU{w}", 0.8), (f"QTLD{w}", 0.2))}


def percentile_rank(w: int, roll: Rolling) -> dict[str, Column]:
    """Share of the window's closes that do not exceed the current one."""
    c = F.col(CLOSE)
    ordered = roll.descending("close_or_nan", w)
    not_above = F.size(ordered) - F.array_position(ordered, c) + 1
    return {f"RANK{w}": F.when(c.isNotNull(), div(not_above.cast("double"), roll.observed(CLOSE, w)))}


def regression(w: int, roll: Rolling) -> dict[str, Column]:
    """Slope, fit and residual of the close on time.

    BETA measures time from the start of the history, so it drifts with the row number;
    that is its definition here.
    """
    centre = (w - 1) / 2
    spread = sum((i - centre) ** 2 for i in range(w))
    beta = (roll.mean("tc", w) - centre * roll.mean(CLOSE, w)) * w / (spread + PRICE_EPS)
    corr = roll.correlation("t", CLOSE, w)
    unexplained = F.when(corr.isNotNull(), F.sqrt(F.greatest(1 - corr * corr, F.lit(0.0))))
    return {f"BETA{w}": beta, f"RSQR{w}": corr * corr, f"RESI{w}": roll.std(CLOSE, w) * unexplained}


def slope(w: int, roll: Rolling) -> dict[str, Column]:
    """Least-squares slope of the close on time, free of the drift in BETA. Not among the 158."""
    return {f"SLOPE{w}": roll.slope(CLOSE, "t", w)}


def range_position(w: int, roll: Rolling) -> dict[str, Column]:
    low, high = roll.min(CLOSE, w), roll.max(CLOSE, w)
    return {f"RSV{w}": div(F.col(CLOSE) - low, high - low + PRICE_EPS)}


def extreme_age(w: int, roll: Rolling) -> dict[str, Column]:
    """Position of the first highest high and first lowest low in the window, and their distance."""

    def position(seen: Column, best: Column) -> Column:
        return div(F.array_position(seen, best).cast("double"), F.size(seen))

    highs, lows = roll.recent("high_or_least", w), roll.recent("low_or_most", w)
    top, bottom = position(highs, F.array_max(highs)), position(lows, F.array_min(lows))
    return {f"IMAX{w}": top, f"IMIN{w}": bottom, f"IMXD{w}": top - bottom}


def comovement(w: int, roll: Rolling) -> dict[str, Column]:
    return {
        f"CORR{w}": roll.correlation(CLOSE, "log_volume", w),
        f"CORD{w}": roll.correlation("ret", "log_volume_ratio", w),
    }


def direction_counts(w: int, roll: Rolling) -> dict[str, Column]:
    rose, fell = roll.mean("up", w), roll.mean("down", w)
    return {f"CNTP{w}": rose, f"CNTN{w}": fell, f"CNTD{w}": rose - fell}


def _change_shares(names: tuple[str, str, str], what: str, w: int, roll: Rolling) -> dict[str, Column]:
    gained, lost = roll.sum(f"{what}_gain", w), roll.sum(f"{what}_loss", w)
    moved = roll.sum(f"{what}_move", w) + SUM_EPS
    return dict(zip(names, (div(gained, moved), div(lost, moved), div(gained - lost, moved))))


def price_change_shares(w: int, roll: Rolling) -> dict[str, Column]:
    return _change_shares((f"SUMP{w}", f"SUMN{w}", f"SUMD{w}"), "price", w, roll)


def volume_change_shares(w: int, roll: Rolling) -> dict[str, Column]:
    return _change_shares((f"VSUMP{w}", f"VSUMN{w}", f"VSUMD{w}"), "volume", w, roll)


def volume_level(w: int, roll: Rolling) -> dict[str, Column]:
    v = F.col(VOLUME)
    return {
        f"VMA{w}": div(roll.mean(VOLUME, w), v + PRICE_EPS),
        f"VSTD{w}": div(roll.std(VOLUME, w), v + PRICE_EPS),
    }


def weighted_volatility(w: int, roll: Rolling) -> dict[str, Column]:
    return {f"WVMA{w}": div(roll.std("weighted_move", w), roll.mean("weighted_move", w) + SUM_EPS)}


Family = Callable[[int, Rolling], dict[str, Column]]

# In column order of the factor table.
FAMILIES: dict[str, Family] = {
    "trend": trend,
    "extremes": extremes,
    "quantile_levels": quantile_levels,
    "percentile_rank": percentile_rank,
    "regression": regression,
    "range_position": range_position,
    "extreme_age": extreme_age,
    "comovement": comovement,
    "direction_counts": direction_counts,
    "price_change_shares": price_change_shares,
    "volume_level": volume_level,
    "volume_change_shares": volume_change_shares,
    "weighted_volatility": weighted_volatility,
}


def _columns(families: Iterable[Family], windows: Iterable[int], roll: Rolling) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    for w in windows:
        for family in families:
            columns.update(family(w, roll))
    return columns


def rolling_factors(
    bars: DataFrame,
    families: Iterable[Family] = tuple(FAMILIES.values()),
    windows: Iterable[int] = WINDOWS,
    spec: WindowSpec | None = None,
    keep: tuple[str, ...] = (INSTRUMENT, DATE),
    row_factors: dict[str, Column] | None = None,
) -> DataFrame:
    """``keep``, the ``row_factors`` and the rolling factors of the chosen families and windows."""
    windows = tuple(windows)
    roll = Rolling(spec or history(), max(windows))
    columns = {**(row_factors or {}), **_columns(families, windows, roll)}
    table = roll.add_to(with_changes(bars, roll.spec))
    return table.select(*keep, *[c.alias(name) for name, c in columns.items()])


def factor_table(
    bars: DataFrame,
    start: str | None = None,
    end: str | None = None,
    spec: WindowSpec | None = None,
    keep: tuple[str, ...] = (INSTRUMENT, DATE),
) -> DataFrame:
    """All 158 factors for bars dated within ``[start, end]``."""
    if start is not None:
        bars = bars.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col(DATE) <= F.lit(end).cast("date"))
    return rolling_factors(bars, spec=spec, keep=keep, row_factors={**bar_shape(), **price_level()})


def factor_names() -> list[str]:
    """Names of the 158 factors in column order (needs an active Spark session)."""
    return [*bar_shape(), *price_level(), *_columns(FAMILIES.values(), WINDOWS, Rolling(history()))]


def factor_table_in_blocks(
    bars: DataFrame, period: Column, block_rows: int, families: Iterable[Family] | None = None
) -> DataFrame:
    """Rolling factors for histories too long for one task: same values as ``rolling_factors``.

    The longest frame reaches 60 rows back (a 60-row window over one-row changes, or a lag of 60).
    """
    numbered = number_rows(bars, period)
    blocks = overlapping_blocks(numbered, block_rows, before=max(WINDOWS))
    families = tuple(families or FAMILIES.values())
    factors = rolling_factors(blocks, families, spec=block_window(), keep=(INSTRUMENT, DATE, "_block", "_own"))
    return own_rows(factors)


def small_cap(market_value: Column) -> Column:
    """Size factor: minus the log of market value, null for non-positive values."""
    return F.when(market_value > 0, -F.log(market_value))
