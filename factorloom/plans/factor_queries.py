"""Factor queries: bar shapes, price levels and every rolling family, alone and together."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.numeric import rounded
from factorloom.operators import factors
from factorloom.operators.history import number_rows
from factorloom.plans.oracle import BARS, HISTORY, corr, frame, full, r
from factorloom.plans.registry import query
from factorloom.sources.tables import bars

WINDOWS = factors.WINDOWS

STAGED = f"""{BARS},
s AS (SELECT *, row_number() OVER h - 1 AS t, lag(close) OVER h AS c1, lag(volume) OVER h AS v1 FROM bars WINDOW {HISTORY}),
x AS (SELECT *, close / c1 AS ret, ln(volume + 1) AS lnv, ln(volume / v1 + 1) AS lnvr, close - c1 AS dc, volume - v1 AS dv,
             CASE WHEN close > c1 THEN 1.0::DOUBLE WHEN c1 IS NOT NULL THEN 0.0::DOUBLE END AS up,
             CASE WHEN close < c1 THEN 1.0::DOUBLE WHEN c1 IS NOT NULL THEN 0.0::DOUBLE END AS down,
             abs(close / c1 - 1) * volume AS rv FROM s)"""

# BETA grows with the row number and the price; fewer digits leave room for summation order.
DIGITS = {f"BETA{w}": 2 for w in WINDOWS}


def _shares(names: tuple[str, str, str], d: str, w: int) -> dict[str, str]:
    gained = full(f"sum(greatest(0, coalesce({d}, 0)))", "1", f"w{w}", w)
    lost = full(f"sum(greatest(0, coalesce(-({d}), 0)))", "1", f"w{w}", w)
    moved = f"({full(f'sum(abs({d}))', d, f'w{w}', w)} + 1e-12)"
    return {
        names[0]: f"({gained}) / {moved}",
        names[1]: f"({lost}) / {moved}",
        names[2]: f"(({gained}) - ({lost})) / {moved}",
    }


def _spread(w: int) -> float:
    return sum((i - (w - 1) / 2) ** 2 for i in range(w))


# Column name to SQL expression over table x with windows h and w{rows}.
SQL = {
    "trend": lambda w: {
        f"ROC{w}": f"close / (lag(close, {w}) OVER h) - 1",
        f"MA{w}": f"({full('avg(close)', 'close', f'w{w}', w)}) / close - 1",
        f"STD{w}": f"({full('stddev_samp(close)', 'close', f'w{w}', w)}) / close",
    },
    "extremes": lambda w: {
        f"MAX{w}": f"({full('max(close)', 'close', f'w{w}', w)}) / close - 1",
        f"MIN{w}": f"({full('min(close)', 'close', f'w{w}', w)}) / close - 1",
    },
    "quantile_levels": lambda w: {
        f"QTLU{w}": f"quantile_cont(close, 0.8) OVER w{w} / close",
        f"QTLD{w}": f"quantile_cont(close, 0.2) OVER w{w} / close",
    },
    "percentile_rank": lambda w: {
        f"RANK{w}": f"len(list_filter(list(close) OVER w{w}, lambda v: v <= close)) / (count(close) OVER w{w})::DOUBLE",
    },
    "regression": lambda w: {
        f"BETA{w}": f"(({full('avg(t * close)', 'close', f'w{w}', w)}) - {(w - 1) / 2}::DOUBLE * ({full('avg(close)', 'close', f'w{w}', w)}))"
        f" * {w} / ({_spread(w)}::DOUBLE + 1e-8::DOUBLE)",
        f"RSQR{w}": f"pow({corr('t::DOUBLE', 'close', f'w{w}', w)}, 2)",
        f"RESI{w}": f"({full('stddev_samp(close)', 'close', f'w{w}', w)})"
        f" * sqrt(CASE WHEN ({corr('t::DOUBLE', 'close', f'w{w}', w)}) IS NOT NULL THEN greatest(1 - pow({corr('t::DOUBLE', 'close', f'w{w}', w)}, 2), 0) END)",
    },
    "range_position": lambda w: {
        f"RSV{w}": f"(close - ({full('min(close)', 'close', f'w{w}', w)}))"
        f" / (({full('max(close)', 'close', f'w{w}', w)}) - ({full('min(close)', 'close', f'w{w}', w)}) + 1e-8)",
    },
    "extreme_age": lambda w: {
        f"IMAX{w}": f"list_position(list(high) OVER w{w}, max(high) OVER w{w}) / (count(*) OVER w{w})::DOUBLE",
        f"IMIN{w}": f"list_position(list(low) OVER w{w}, min(low) OVER w{w}) / (count(*) OVER w{w})::DOUBLE",
        f"IMXD{w}": f"list_position(list(high) OVER w{w}, max(high) OVER w{w}) / (count(*) OVER w{w})::DOUBLE"
        f" - list_position(list(low) OVER w{w}, min(low) OVER w{w}) / (count(*) OVER w{w})::DOUBLE",
    },
    "comovement": lambda w: {
        f"CORR{w}": corr("close", "lnv", f"w{w}", w),
        f"CORD{w}": corr("ret", "lnvr", f"w{w}", w),
    },
    "direction_counts": lambda w: {
        f"CNTP{w}": full("avg(up)", "up", f"w{w}", w),
        f"CNTN{w}": full("avg(down)", "down", f"w{w}", w),
        f"CNTD{w}": f"({full('avg(up)', 'up', f'w{w}', w)}) - ({full('avg(down)', 'down', f'w{w}', w)})",
    },
    "price_change_shares": lambda w: _shares((f"SUMP{w}", f"SUMN{w}", f"SUMD{w}"), "dc", w),
    "volume_level": lambda w: {
        f"VMA{w}": f"({full('avg(volume)', 'volume', f'w{w}', w)}) / (volume + 1e-8)",
        f"VSTD{w}": f"({full('stddev_samp(volume)', 'volume', f'w{w}', w)}) / (volume + 1e-8)",
    },
    "volume_change_shares": lambda w: _shares((f"VSUMP{w}", f"VSUMN{w}", f"VSUMD{w}"), "dv", w),
    "weighted_volatility": lambda w: {
        f"WVMA{w}": f"({full('stddev_samp(rv)', 'rv', f'w{w}', w)}) / (({full('avg(rv)', 'rv', f'w{w}', w)}) + 1e-12)",
    },
}

BAR_SHAPE = {
    "KMID": "(close - open) / (open + 1e-8)",
    "KLEN": "(high - low) / (open + 1e-8)",
    "KMID2": "(close - open) / (high - low + 1e-8)",
    "KUP": "(high - greatest(open, close)) / (open + 1e-8)",
    "KUP2": "(high - greatest(open, close)) / (high - low + 1e-8)",
    "KLOW": "(least(open, close) - low) / (open + 1e-8)",
    "KLOW2": "(least(open, close) - low) / (high - low + 1e-8)",
    "KSFT": "(close - low) / (high - low + 1e-8)",
    "KSFT2": "(2 * close - high - low) / (high - low + 1e-8)",
}
PRICE_LEVEL = {
    "OPEN0": "open / close - 1",
    "HIGH0": "high / close - 1",
    "LOW0": "low / close - 1",
    "VWAP0": "amount / (volume * 100 + 1e-8) / close - 1",
}


def window_frames() -> str:
    return ", ".join([HISTORY, *[frame(f"w{w}", w) for w in WINDOWS]])


def _select(columns: dict[str, str], source: str = "x", digits: dict[str, int] | None = None) -> str:
    digits = DIGITS if digits is None else digits
    # Window results are computed in an inner select so that expressions over them may be nested.
    inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    outer = ", ".join(r(n, n, digits.get(n, 6)) for n in columns)
    return f"SELECT instrument, datetime, {outer} FROM (SELECT instrument, datetime, {inner} FROM {source} WINDOW {window_frames()})"


def family_sql(*names: str) -> dict[str, str]:
    return {c: e for w in WINDOWS for name in names for c, e in SQL[name](w).items()}


def _simple(name: str, columns: dict[str, str], builder) -> None:
    @query(name, f"WITH {BARS} {_select(columns, 'bars')}")
    def run(spark, sf_dir):
        made = builder()
        return rounded(bars(spark, sf_dir).select("instrument", "datetime", *[c.alias(n) for n, c in made.items()]))


_simple("factor_bar_shape", BAR_SHAPE, factors.bar_shape)
_simple("factor_price_level", PRICE_LEVEL, factors.price_level)


def _family(name: str) -> None:
    @query(f"factor_{name}", f"WITH {STAGED} {_select(family_sql(name))}")
    def run(spark, sf_dir):
        return rounded(factors.rolling_factors(bars(spark, sf_dir), [factors.FAMILIES[name]]), **DIGITS)


for _name in factors.FAMILIES:
    _family(_name)


@query(
    "factor_slope",
    f"WITH {STAGED} "
    + _select({f"SLOPE{w}": f"({full('regr_slope(close, t)', 'close', f'w{w}', w)}) / close" for w in WINDOWS}),
)
def factor_slope(spark, sf_dir):
    """Slope per row relative to the close."""
    slopes = factors.rolling_factors(bars(spark, sf_dir), [factors.slope], keep=("instrument", "datetime", "close"))
    relative = {f"SLOPE{w}": F.col(f"SLOPE{w}") / F.col("close") for w in WINDOWS}
    return rounded(slopes.withColumns(relative).drop("close"))


def _nearest(p: float, w: int) -> str:
    return f"list_sort(list(close) OVER w{w})[floor((count(close) OVER w{w} - 1) * {p}::DOUBLE + 0.5::DOUBLE)::BIGINT + 1] / close"


@query(
    "factor_quantile_levels_nearest",
    f"WITH {STAGED} "
    + _select({n: e for w in WINDOWS for n, e in {f"QTLU{w}": _nearest(0.8, w), f"QTLD{w}": _nearest(0.2, w)}.items()}),
)
def quantile_levels_nearest(spark, sf_dir):
    nearest = lambda w, roll: factors.quantile_levels(w, roll, "nearest")
    return rounded(factors.rolling_factors(bars(spark, sf_dir), [nearest]))


@query("factor_table_158", f"WITH {STAGED} {_select({**BAR_SHAPE, **PRICE_LEVEL, **family_sql(*SQL)})}")
def factor_table(spark, sf_dir):
    return rounded(factors.factor_table(bars(spark, sf_dir)), **DIGITS)


RANGE = ("1997-01-01", "2000-12-31")


@query(
    "factor_date_range",
    f"WITH {STAGED.replace(' FROM bars WINDOW', f' FROM bars WHERE datetime BETWEEN DATE {RANGE[0]!r} AND DATE {RANGE[1]!r} WINDOW')} "
    + _select({**BAR_SHAPE, **PRICE_LEVEL, **{c: e for n in ("trend", "regression") for c, e in SQL[n](20).items()}}),
)
def factor_date_range(spark, sf_dir):
    """Dates are cut before the windows run, so the first rows of the range are warm-up."""
    keep = [*BAR_SHAPE, *PRICE_LEVEL, "ROC20", "MA20", "STD20", "BETA20", "RSQR20", "RESI20"]
    table = factors.factor_table(bars(spark, sf_dir), *RANGE)
    return rounded(table.select("instrument", "datetime", *keep), **DIGITS)


_SCALED = {f"BETA{w}": f"({SQL['regression'](w)[f'BETA{w}']}) / close / (t + 1)" for w in WINDOWS}


@query("factor_beta_scaled", f"WITH {STAGED} {_select(_SCALED, digits={})}")
def factor_beta_scaled(spark, sf_dir):
    """BETA over the close and the row number: free of their scale, so it compares at full digits."""
    numbered = number_rows(bars(spark, sf_dir), F.trunc("datetime", "year")).select("instrument", "datetime", "t")
    betas = factors.rolling_factors(bars(spark, sf_dir), [factors.regression], keep=("instrument", "datetime", "close"))
    scaled = betas.join(numbered, ["instrument", "datetime"])
    columns = [(F.col(n) / F.col("close") / (F.col("t") + 1)).alias(n) for n in _SCALED]
    return rounded(scaled.select("instrument", "datetime", *columns))


@query("factor_table_in_blocks", f"WITH {STAGED} {_select(family_sql(*SQL))}")
def factor_in_blocks(spark, sf_dir):
    """Histories cut into overlapping blocks of 24 bars: the same values as unsplit windows."""
    blocks = factors.factor_table_in_blocks(bars(spark, sf_dir), F.trunc("datetime", "year"), 24)
    return rounded(blocks, **DIGITS)


@query("factor_row_index", f"WITH {STAGED} SELECT instrument, datetime, t FROM x")
def factor_row_index(spark, sf_dir):
    return number_rows(bars(spark, sf_dir), F.trunc("datetime", "year")).select("instrument", "datetime", "t")


@query("factor_small_cap", f"WITH {BARS} SELECT instrument, datetime, {r('-ln(amount)', 'small_cap')} FROM bars")
def factor_small_cap(spark, sf_dir):
    size = factors.small_cap(F.col("amount")).alias("small_cap")
    return rounded(bars(spark, sf_dir).select("instrument", "datetime", size))
