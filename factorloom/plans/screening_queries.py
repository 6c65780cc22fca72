"""Rank IC and factor-screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.numeric import rounded
from factorloom.operators import ic, screening
from factorloom.plans.oracle import average_rank, corr, r, rank_ic
from factorloom.plans.panel import FACTORS, PANEL, long_panel, long_sql, panel
from factorloom.plans.registry import query
from factorloom.sources.shared import stored

LONG = long_sql()
DAILY = f"{LONG}, {rank_ic('ic0', 'long', 'datetime, factor', min_count=2)}, daily AS (SELECT * FROM ic0 WHERE ic IS NOT NULL)"
DAILY5 = f"{LONG}, {rank_ic('ic0', 'long', 'datetime, factor', min_count=5)}, daily AS (SELECT * FROM ic0 WHERE ic IS NOT NULL)"


def summary_sql(source: str, name: str, by: str = "factor") -> str:
    return f"""{name} AS (SELECT {by}, CASE WHEN count(ic) >= 2 THEN avg(ic) ELSE 0 END AS ic_mean,
      CASE WHEN count(ic) >= 2 THEN stddev_samp(ic) ELSE 0 END AS ic_std,
      CASE WHEN count(ic) >= 2 AND stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS icir,
      CASE WHEN count(ic) >= 2 THEN avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0 END AS win_rate,
      count(ic) AS n_days FROM {source} GROUP BY {by})"""


SUMMARY_COLUMNS = ", ".join(r(c, c) for c in ("ic_mean", "ic_std", "icir", "win_rate"))

# --- information coefficient ----------------------------------------------------------


@query("ic_daily", f"WITH {DAILY5} SELECT datetime, factor, {r('ic', 'ic')}, n FROM daily")
def ic_daily(spark, sf_dir):
    return rounded(ic.daily_rank_ic(long_panel(spark, sf_dir)))


_MOMENTUM = f"{long_sql(['ROC20'])}, {rank_ic('ic0', 'long', 'datetime, factor', min_count=5)}, daily AS (SELECT * FROM ic0 WHERE ic IS NOT NULL)"


@query(
    "ic_momentum_summary",
    f"WITH {_MOMENTUM}, {summary_sql('daily', 's')} SELECT factor, {SUMMARY_COLUMNS}, n_days FROM s",
)
def ic_momentum_summary(spark, sf_dir):
    """Bars, 20-bar momentum, next-bar return, rank IC per date, summary."""
    return rounded(ic.ic_summary(ic.daily_rank_ic(long_panel(spark, sf_dir, ["ROC20"]))))


@query("ic_summary", f"WITH {DAILY5}, {summary_sql('daily', 's')} SELECT factor, {SUMMARY_COLUMNS}, n_days FROM s")
def ic_summary(spark, sf_dir):
    return rounded(ic.ic_summary(ic.daily_rank_ic(long_panel(spark, sf_dir))))


@query(
    "ic_monthly",
    f"WITH {DAILY5} SELECT factor, CAST(date_trunc('quarter', datetime) AS DATE) AS period, {r('avg(ic)', 'ic')} FROM daily GROUP BY 1, 2",
)
def ic_monthly(spark, sf_dir):
    """Mean IC per calendar period; bars are monthly here, so the period is a quarter."""
    return rounded(ic.monthly_ic(ic.daily_rank_ic(long_panel(spark, sf_dir)), period="quarter"))


@query("ic_yearly", f"WITH {DAILY5} SELECT factor, year(datetime)::BIGINT AS year, {r('avg(ic)', 'ic')} FROM daily GROUP BY 1, 2")
def ic_yearly(spark, sf_dir):
    return rounded(ic.yearly_ic(ic.daily_rank_ic(long_panel(spark, sf_dir))))


@query(
    "ic_rolling",
    f"""WITH {DAILY5} SELECT factor, datetime, {r('ic', 'ic')},
      {r('CASE WHEN count(ic) OVER w >= 12 THEN avg(ic) OVER w END', 'rolling_ic')}, {r('sum(ic) OVER u', 'cumulative_ic')}
    FROM daily WINDOW w AS (PARTITION BY factor ORDER BY datetime ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
      u AS (PARTITION BY factor ORDER BY datetime ROWS UNBOUNDED PRECEDING)""",
)
def ic_rolling(spark, sf_dir):
    return rounded(ic.rolling_ic(ic.daily_rank_ic(long_panel(spark, sf_dir)), 12))


@query(
    "ic_oriented_signal",
    f"""WITH {DAILY5}, d AS (SELECT factor, sum(ic) FILTER (WHERE datetime < DATE '1999-01-01') AS validation FROM daily GROUP BY factor)
    SELECT datetime, instrument, factor, {r('CASE WHEN validation < 0 THEN -value ELSE value END', 'value')},
           CASE WHEN validation < 0 THEN -1 ELSE 1 END::BIGINT AS direction
    FROM long LEFT JOIN d USING (factor) WHERE datetime >= DATE '1999-01-01' AND validation IS NOT NULL""",
)
def ic_oriented_signal(spark, sf_dir):
    """Signals flipped by the sign of their IC in the earlier period."""
    long = long_panel(spark, sf_dir)
    split = F.lit("1999-01-01").cast("date")
    validation = ic.daily_rank_ic(long.where(F.col("datetime") < split))
    oriented = ic.oriented(long.where(F.col("datetime") >= split), validation)
    return rounded(oriented.select("datetime", "instrument", "factor", "value", "direction"))


# --- ring 0 ---------------------------------------------------------------------------

QUALITY_FACTORS = FACTORS + ["one"]


def _with_constant(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("one", F.lit(1.0))


_COVERAGE = " UNION ALL ".join(
    f"SELECT '{f}' AS factor, count({f}) / count(*)::DOUBLE AS coverage, stddev_samp({f}) AS std, count({f}) AS n FROM p"
    for f in QUALITY_FACTORS
)
QUALITY_SQL = f"""{PANEL}, p AS (SELECT *, 1.0::DOUBLE AS one FROM panel), c AS ({_COVERAGE}),
q AS (SELECT factor, coverage, std, coverage < 0.8 AS dropped,
  concat_ws('; ', CASE WHEN n >= 2 AND coalesce(std, 0) < 1e-8 THEN 'hardly varies' END,
                  CASE WHEN coverage < 0.8 THEN 'too often missing' END) AS reason FROM c)"""


@query("screen_factor_quality", f"WITH {QUALITY_SQL} SELECT factor, {r('coverage', 'coverage')}, {r('std', 'std')}, reason, dropped FROM q")
def factor_quality(spark, sf_dir):
    return rounded(screening.factor_quality(_with_constant(spark, sf_dir), QUALITY_FACTORS, 0.8))


@query(
    "screen_infinite_to_null",
    f"WITH {PANEL} SELECT datetime, instrument, {r('CASE WHEN amount > 500000 THEN NULL ELSE KMID END', 'KMID')}, {r('ROC5', 'ROC5')} FROM panel",
)
def infinite_to_null(spark, sf_dir):
    """Infinite and NaN values planted in a factor are removed."""
    planted = F.when(F.col("amount") > 1000000, float("nan")).when(F.col("amount") > 500000, float("inf")).otherwise(F.col("KMID"))
    rows = panel(spark, sf_dir).withColumn("KMID", planted).select("datetime", "instrument", "KMID", "ROC5")
    return rounded(screening.without_infinite(rows, ["KMID", "ROC5"]))


@query(
    "screen_label_quality",
    f"WITH {PANEL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS label, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, {r(f'1 - count({c}) / count(*)::DOUBLE', 'null_pct')} FROM panel"
        for c in ("label_1d", "label_5d")
    ),
)
def label_quality(spark, sf_dir):
    return rounded(screening.label_quality(panel(spark, sf_dir), ["label_1d", "label_5d"]))


# --- ring 2 ---------------------------------------------------------------------------

_RANKED = f"""rk AS (SELECT datetime, factor, label, {average_rank('value', 'datetime, factor')} AS rnk,
  count(*) OVER (PARTITION BY datetime, factor) AS total FROM long WHERE value IS NOT NULL)"""
_BUCKET = {
    "even": "ceil(rnk / total * 5)",
    "literal": "floor(least(greatest(rnk / total * 5 - 1, 0), 4)) + 1",
}


def groups_sql(mode: str = "even") -> str:
    return f"{_RANKED}, g AS (SELECT factor, ({_BUCKET[mode]})::BIGINT AS bucket, avg(label) AS mean_label, count(label) AS n FROM rk GROUP BY 1, 2)"


def _group_query(name: str, mode: str) -> None:
    @query(name, f"WITH {LONG}, {groups_sql(mode)} SELECT factor, bucket, {r('mean_label', 'mean_label')}, n FROM g")
    def run(spark, sf_dir):
        return rounded(screening.group_returns(long_panel(spark, sf_dir), mode=mode))


_group_query("screen_group_returns", "even")
_group_query("screen_group_returns_literal", "literal")

SPREAD_SQL = f"""known AS (SELECT * FROM g WHERE mean_label IS NOT NULL),
{rank_ic('mono', '(SELECT factor, bucket::DOUBLE AS bucket, mean_label FROM known)', 'factor', 'bucket', 'mean_label', 3, 'monotonicity')},
sp AS (SELECT factor, coalesce(max(CASE WHEN bucket = 5 THEN mean_label END), 0) - coalesce(max(CASE WHEN bucket = 1 THEN mean_label END), 0) AS long_short
       FROM known GROUP BY factor)"""
PROFILE_SQL = f"""{DAILY}, {summary_sql('daily', 's')}, {groups_sql()}, {SPREAD_SQL},
prof AS (SELECT s.*, sp.long_short, coalesce(mono.monotonicity, 0) AS monotonicity
         FROM s LEFT JOIN sp ON s.factor = sp.factor LEFT JOIN mono ON s.factor = mono.factor)"""


@query(
    "screen_profile",
    f"WITH {PROFILE_SQL} SELECT factor, {SUMMARY_COLUMNS}, n_days, {r('long_short', 'long_short')}, {r('monotonicity', 'monotonicity')} FROM prof",
)
def profile(spark, sf_dir):
    return rounded(screening.profile(long_panel(spark, sf_dir)))


# --- ring 3 ---------------------------------------------------------------------------

FILTER_SQL = """f AS (SELECT factor, ic_mean, n_days / greatest(max(n_days) OVER (), 1)::DOUBLE AS coverage FROM s),
flt AS (SELECT factor, ic_mean, coverage, NOT (abs(ic_mean) < 0.01 OR coverage < 0.9) AS retained,
  concat_ws('; ', CASE WHEN abs(ic_mean) < 0.01 THEN format('|IC| {:.4f} below 0.01', abs(ic_mean)) END,
                  CASE WHEN coverage < 0.9 THEN format('IC on {:.2f}% of dates, below 90%', coverage * 100) END) AS reason FROM f)"""


@query(
    "screen_filter",
    f"WITH {DAILY}, {summary_sql('daily', 's')}, {FILTER_SQL} SELECT factor, {r('ic_mean', 'ic_mean')}, {r('coverage', 'coverage')}, retained, reason FROM flt",
)
def cross_section_filter(spark, sf_dir):
    summary = ic.ic_summary(ic.daily_rank_ic(long_panel(spark, sf_dir), 2))
    return rounded(screening.cross_section_filter(summary, min_coverage=0.9))


# --- ring 4 ---------------------------------------------------------------------------

STRATA_SQL = """d0 AS (SELECT DISTINCT datetime, instrument FROM long),
d1 AS (SELECT *, dense_rank() OVER (PARTITION BY datetime ORDER BY instrument) AS dr FROM d0),
d2 AS (SELECT *, max(dr) OVER (PARTITION BY datetime) AS most FROM d1),
strat AS (SELECT l.*, CASE WHEN dr <= most * 0.33::DOUBLE THEN 'small' WHEN dr <= most * 0.66::DOUBLE THEN 'mid' ELSE 'large' END AS stratum
          FROM long l JOIN d2 USING (datetime, instrument))"""
STRATUM_IC = rank_ic("sic", "strat", "factor, stratum")


@query("screen_stratum_ic", f"WITH {LONG}, {STRATA_SQL}, {STRATUM_IC} SELECT factor, stratum, {r('ic', 'ic')}, n FROM sic")
def stratum_ic(spark, sf_dir):
    return rounded(screening.stratum_ic(long_panel(spark, sf_dir)))


STABILITY_SQL = f"""{STRATA_SQL}, {STRATUM_IC},
y AS (SELECT factor, coalesce(stddev_samp(ic), 0) AS year_std FROM (SELECT factor, year(datetime) AS y, avg(ic) AS ic FROM daily GROUP BY 1, 2) GROUP BY 1),
ro AS (SELECT *, CASE WHEN count(ic) OVER w >= 24 THEN avg(ic) OVER w END AS roll FROM daily
       WINDOW w AS (PARTITION BY factor ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
rs AS (SELECT factor, count(ic) AS days, coalesce(avg(roll), 0) AS rolling_ic_mean, coalesce(stddev_samp(roll), 1) AS rolling_ic_std FROM ro GROUP BY 1),
z AS (SELECT factor, coalesce(stddev_samp(ic), 0) AS size_std FROM sic GROUP BY 1),
stab AS (SELECT factor, year_std, rolling_ic_mean, rolling_ic_std, size_std,
  CASE WHEN days >= 2 THEN 0.4::DOUBLE * (1 - year_std) + 0.3::DOUBLE / (1 + rolling_ic_std) + 0.3::DOUBLE * (1 - size_std) ELSE 0 END AS stability_score
  FROM rs JOIN y USING (factor) JOIN z USING (factor))"""
STABILITY_COLUMNS = ", ".join(r(c, c) for c in ("year_std", "rolling_ic_mean", "rolling_ic_std", "size_std", "stability_score"))


def _screened(spark, sf_dir):
    """Names, label and factors of the panel, a column each, stored: the rings read them several times."""
    return stored(panel(spark, sf_dir).select("datetime", "instrument", F.col("label_1d").alias("label"), *FACTORS), "screened")


@query("screen_stability", f"WITH {DAILY}, {STABILITY_SQL} SELECT factor, {STABILITY_COLUMNS} FROM stab")
def stability(spark, sf_dir):
    return rounded(screening.stability(_screened(spark, sf_dir), rolling_days=24, factors=FACTORS))


# --- ring 5 ---------------------------------------------------------------------------

DISTANCE_SQL = f"""ok AS (SELECT datetime FROM daily GROUP BY 1 HAVING count(*) = {len(FACTORS)}),
ser AS (SELECT d.datetime, d.factor, d.ic FROM daily d SEMI JOIN ok ON d.datetime = ok.datetime),
pr AS (SELECT a.factor AS factor_a, b.factor AS factor_b, coalesce({corr('a.ic', 'b.ic')}, 0) AS corr
       FROM ser a JOIN ser b ON a.datetime = b.datetime GROUP BY 1, 2)"""


@query(
    "screen_ic_distance",
    f"WITH {DAILY}, {DISTANCE_SQL} SELECT factor_a, factor_b, {r('corr', 'corr')}, {r('sqrt(greatest((1 - corr) / 2, 0))', 'distance', 4)} FROM pr",
)
def ic_distance(spark, sf_dir):
    daily = ic.daily_rank_ic(long_panel(spark, sf_dir), 2)
    # The root magnifies summation noise near zero, on the diagonal.
    return rounded(screening.ic_distance(daily, len(FACTORS)), distance=4)


# --- ring 6 ---------------------------------------------------------------------------

# Factors of one family, the letters of their names, compete with each other.
_MEASURES = {"icir": (0.30, 0), "monotonicity": (0.20, 0), "long_short": (0.20, 0), "stability_score": (0.30, 0.5)}


def _norm(c: str, weight: float) -> str:
    w = "OVER (PARTITION BY cluster)"
    return f"{weight}::DOUBLE * CASE WHEN max({c}) {w} = min({c}) {w} THEN 0.5 ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"


CHOICE_SQL = f"""m0 AS (SELECT factor, regexp_extract(factor, '^[A-Z]+') AS cluster, round(abs(icir), 12) AS icir,
  round(abs(monotonicity), 12) AS monotonicity, round(abs(long_short), 12) AS long_short, round(stability_score, 12) AS stability_score FROM prof JOIN stab USING (factor)),
m1 AS (SELECT factor, cluster, {' + '.join(_norm(c, w) for c, (w, _) in _MEASURES.items())} AS score FROM m0),
m2 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, factor) AS rank_in_cluster FROM m1),
chosen AS (SELECT * FROM m2 WHERE rank_in_cluster <= 2)"""


def _chosen(profiled, stable):
    family = F.regexp_extract("factor", "^[A-Z]+", 0)
    metrics = profiled.join(stable, "factor").select("factor", family.alias("cluster"), "icir", "monotonicity", "long_short", "stability_score")
    return screening.representatives(metrics)


def _choice(table):
    return _chosen(screening.profile(table, factors=FACTORS), screening.stability(table, rolling_days=24, factors=FACTORS))


@query("screen_representatives", f"WITH {PROFILE_SQL}, {STABILITY_SQL}, {CHOICE_SQL} SELECT factor, cluster, {r('score', 'score')}, rank_in_cluster FROM chosen")
def representatives(spark, sf_dir):
    """Best two factors of each family."""
    return rounded(_choice(_screened(spark, sf_dir)))


# --- ring 7 ---------------------------------------------------------------------------

WEIGHT_SQL = """wt AS (SELECT factor, 'equal_weight' AS portfolio, 1 / count(*) OVER ()::DOUBLE AS weight FROM s
  UNION ALL SELECT factor, 'ic_weight', abs(ic_mean) / greatest(sum(abs(ic_mean)) OVER (), 1e-8) FROM s
  UNION ALL SELECT factor, 'icir_weight', icir / greatest(abs(sum(icir) OVER ()), 1e-8) FROM s)"""
SIGNAL_SQL = """sig AS (SELECT portfolio, datetime, instrument, CASE WHEN count(*) = count(value) THEN sum(value * weight) END AS signal,
  first(label) AS label FROM long JOIN wt USING (factor) GROUP BY 1, 2, 3)"""


def _weights(long):
    return screening.signal_weights(ic.ic_summary(ic.daily_rank_ic(long, 2)))


@query("screen_signal_weights", f"WITH {DAILY}, {summary_sql('daily', 's')}, {WEIGHT_SQL} SELECT factor, portfolio, {r('weight', 'weight')} FROM wt")
def signal_weights(spark, sf_dir):
    return rounded(_weights(long_panel(spark, sf_dir)).unpivot(["factor"], list(screening.PORTFOLIOS), "portfolio", "weight"))


@query(
    "screen_composite_signals",
    f"WITH {DAILY}, {summary_sql('daily', 's')}, {WEIGHT_SQL}, {SIGNAL_SQL} SELECT portfolio, datetime, instrument, {r('signal', 'signal')}, {r('label', 'label')} FROM sig",
)
def composite_signals(spark, sf_dir):
    long = long_panel(spark, sf_dir)
    return rounded(screening.composite_signals(long, _weights(long)))


@query(
    "screen_composite_report",
    f"""WITH {DAILY}, {summary_sql('daily', 's')}, {WEIGHT_SQL}, {SIGNAL_SQL},
    {rank_ic('c0', 'sig', 'portfolio, datetime', 'signal')}, cd AS (SELECT * FROM c0 WHERE ic IS NOT NULL),
    {summary_sql('cd', 'cs', 'portfolio')},
    lagged AS (SELECT portfolio, ic, lag(ic) OVER (PARTITION BY portfolio ORDER BY datetime) AS prior FROM cd),
    au AS (SELECT portfolio, coalesce({corr('prior', 'ic')}, 0) AS auto FROM lagged GROUP BY 1)
    SELECT portfolio, {SUMMARY_COLUMNS}, n_days, {r('1 - abs(auto)', 'turnover')} FROM cs JOIN au USING (portfolio)""",
)
def composite_report(spark, sf_dir):
    long = long_panel(spark, sf_dir)
    return rounded(screening.composite_report(screening.composite_signals(long, _weights(long))))


@query(
    "screen_log",
    f"""WITH {PROFILE_SQL}, p AS (SELECT *, 1.0::DOUBLE AS one FROM panel), c AS ({_COVERAGE}),
    q AS (SELECT factor, coverage < 0.8 AS dropped,
      concat_ws('; ', CASE WHEN n >= 2 AND coalesce(std, 0) < 1e-8 THEN 'hardly varies' END, CASE WHEN coverage < 0.8 THEN 'too often missing' END) AS reason FROM c),
    {FILTER_SQL}, {STABILITY_SQL}, {CHOICE_SQL}
    SELECT 'quality' AS ring, factor, NOT dropped AS passed, reason FROM q
    UNION ALL SELECT 'filter', factor, retained, reason FROM flt
    UNION ALL SELECT 'choice', flt.factor, chosen.factor IS NOT NULL, CASE WHEN chosen.factor IS NOT NULL THEN '' ELSE 'others of its group are better' END
    FROM flt LEFT JOIN chosen ON flt.factor = chosen.factor WHERE retained""",
)
def screen_log(spark, sf_dir):
    table = _screened(spark, sf_dir)
    profiled = screening.profile(table, factors=FACTORS)
    quality = screening.factor_quality(_with_constant(spark, sf_dir), QUALITY_FACTORS, 0.8)
    return screening.screening_log(
        quality, screening.cross_section_filter(profiled, min_coverage=0.9), _chosen(profiled, screening.stability(table, rolling_days=24, factors=FACTORS))
    )
