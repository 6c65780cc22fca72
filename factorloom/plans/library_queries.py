"""Screening of the whole factor library: the rings on all 158 factors that the engine computes."""

from __future__ import annotations

from factorloom.functions.numeric import rounded
from factorloom.operators import factors, ic, labels, screening
from factorloom.plans.factor_queries import BAR_SHAPE, PRICE_LEVEL, SQL, STAGED, family_sql, window_frames
from factorloom.plans.oracle import r, rank_ic
from factorloom.plans.registry import query
from factorloom.plans.screening_queries import (
    FILTER_SQL,
    SIGNAL_SQL,
    SPREAD_SQL,
    STABILITY_COLUMNS,
    STABILITY_SQL,
    SUMMARY_COLUMNS,
    WEIGHT_SQL,
    groups_sql,
    summary_sql,
)
from factorloom.sources.shared import stored
from factorloom.sources.tables import bars

# Both sides round the factors before ranking, so that summation order makes no order of its own.
DIGITS = 8
_ALL = {**BAR_SHAPE, **PRICE_LEVEL, **family_sql(*SQL)}
_STAGED = STAGED.replace("\ns AS (", "\nstaged AS (").replace("AS rv FROM s)", "AS rv FROM staged)")
LONG = f"""{_STAGED},
fw AS (SELECT instrument, datetime, lead(close, 1) OVER h / close - 1 AS label, {', '.join(f'{e} AS {n}' for n, e in _ALL.items())}
  FROM x WINDOW {window_frames()}),
fr AS (SELECT instrument, datetime, label, {', '.join(f'{n}' for n in _ALL)} FROM fw),
long AS (SELECT * FROM fr UNPIVOT INCLUDE NULLS (value FOR factor IN ({', '.join(_ALL)})))"""
DAILY = f"{LONG}, {rank_ic('ic0', 'long', 'datetime, factor', min_count=2)}, daily AS (SELECT * FROM ic0 WHERE ic IS NOT NULL)"


def library(spark, sf_dir, strata=False):
    """``(instrument, datetime, label)`` and a column for each factor; with ``strata`` also the size stratum, found on the bars."""
    labelled = labels.with_forward_returns(bars(spark, sf_dir), (1,)).withColumnRenamed("label_1d", "label")
    keep = ("instrument", "datetime", "label")
    if strata:
        labelled, keep = screening.with_size_stratum(labelled), (*keep, "stratum")
    # The bars are read again for every pass over the factors.
    return factors.factor_table(stored(labelled, "bars"), keep=keep)


@query("library_ic_daily", f"WITH {DAILY} SELECT datetime, factor, {r('ic', 'ic')}, n FROM daily")
def library_ic_daily(spark, sf_dir):
    return rounded(ic.daily_rank_ic(library(spark, sf_dir), 2, factors.factor_names()))


@query(
    "library_profile",
    f"""WITH {DAILY}, {summary_sql('daily', 's')}, {groups_sql()}, {SPREAD_SQL}
    SELECT s.factor, {SUMMARY_COLUMNS}, n_days, {r('long_short', 'long_short')}, {r('coalesce(mono.monotonicity, 0)', 'monotonicity')}
    FROM s LEFT JOIN sp ON s.factor = sp.factor LEFT JOIN mono ON s.factor = mono.factor""",
)
def library_profile(spark, sf_dir):
    return rounded(screening.profile(library(spark, sf_dir), factors=factors.factor_names()))


@query(
    "library_filter",
    f"WITH {DAILY}, {summary_sql('daily', 's')}, {FILTER_SQL} SELECT factor, {r('ic_mean', 'ic_mean')}, {r('coverage', 'coverage')}, retained FROM flt",
)
def library_filter(spark, sf_dir):
    summary = ic.ic_summary(ic.daily_rank_ic(library(spark, sf_dir), 2, factors.factor_names()))
    return rounded(screening.cross_section_filter(summary, min_coverage=0.9).drop("reason"))


@query("library_stability", f"WITH {DAILY}, {STABILITY_SQL} SELECT factor, {STABILITY_COLUMNS} FROM stab")
def library_stability(spark, sf_dir):
    table = library(spark, sf_dir, strata=True)
    return rounded(screening.stability(table, rolling_days=24, factors=factors.factor_names()))


@query(
    "library_composite_signals",
    f"WITH {DAILY}, {summary_sql('daily', 's')}, {WEIGHT_SQL}, {SIGNAL_SQL} SELECT portfolio, datetime, instrument, {r('signal', 'signal', 2)} FROM sig",
)
def library_composite_signals(spark, sf_dir):
    """Composites of all factors; their values sum over factors as large as prices times rows, hence few digits."""
    table, names = stored(library(spark, sf_dir), "library", "zstd"), factors.factor_names()
    weights = screening.signal_weights(ic.ic_summary(ic.daily_rank_ic(table, 2, names)))
    return rounded(screening.composite_columns(table, names, weights).drop("label"), 2)
