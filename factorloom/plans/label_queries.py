"""Label and cross-section transform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.numeric import rounded
from factorloom.operators import labels, xsection
from factorloom.plans.oracle import BARS, CALENDAR, HISTORY, average_rank, r
from factorloom.plans.panel import FACTORS, PANEL, long_panel, long_sql, panel
from factorloom.plans.registry import query
from factorloom.sources.tables import bars, closes

# --- labels ---------------------------------------------------------------------------

_FORWARD = ", ".join(r(f"lead(close, {p}) OVER h / close - 1", f"label_{p}d") for p in labels.PERIODS)


@query(
    "label_forward_returns",
    f"WITH {BARS} SELECT instrument, datetime, close, {_FORWARD} FROM bars WINDOW {HISTORY}",
)
def forward_returns(spark, sf_dir):
    return rounded(labels.forward_returns(closes(spark, sf_dir)), close=None)


@query(
    "label_forward_buffer",
    f"""WITH {BARS}, b AS (SELECT * FROM bars WHERE datetime BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' + 25),
    l AS (SELECT instrument, datetime, close, {_FORWARD} FROM b WINDOW {HISTORY})
    SELECT instrument, datetime, close, label_1d, label_5d, label_10d, label_20d
    FROM l WHERE datetime <= DATE '1999-06-30'""",
)
def forward_buffer(spark, sf_dir):
    return rounded(labels.labels_in_range(closes(spark, sf_dir), "1996-01-01", "1999-06-30"), close=None)


@query(
    "label_attached_to_factors",
    f"WITH {PANEL} SELECT instrument, datetime, {r('KMID', 'KMID')}, close, {r('label_1d', 'label_1d')}, {r('label_5d', 'label_5d')} FROM panel",
)
def attached(spark, sf_dir):
    """Labels computed on their own table and joined to the factors by key."""
    source = bars(spark, sf_dir)
    from factorloom.operators import factors

    shapes = source.select("instrument", "datetime", factors.bar_shape()["KMID"].alias("KMID"))
    made = labels.forward_returns(source.select("instrument", "datetime", "close"), (1, 5))
    return rounded(labels.attach_labels(shapes, made), close=None)


@query(
    "label_risk_adjusted",
    f"""WITH {BARS}, s AS (SELECT *, close / lag(close) OVER h - 1 AS ret FROM bars WINDOW {HISTORY}),
    l AS (SELECT instrument, datetime, lead(close, 20) OVER h / close - 1 AS fwd,
                 CASE WHEN count(ret) OVER f >= 20 THEN stddev_samp(ret) OVER f END AS vol
          FROM s WINDOW {HISTORY}, f AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
    SELECT instrument, datetime, {r('fwd / (vol * sqrt(20.0::DOUBLE) + 1e-9)', 'risk_adjusted')} FROM l""",
)
def risk_adjusted(spark, sf_dir):
    return rounded(labels.risk_adjusted_return(closes(spark, sf_dir)))


@query(
    "label_winsorised",
    f"""WITH {PANEL}, e AS (SELECT datetime, quantile_cont(label_1d, 0.01) AS lo, quantile_cont(label_1d, 0.99) AS hi, count(label_1d) AS n
    FROM panel GROUP BY datetime)
    SELECT instrument, datetime, {r('CASE WHEN n >= 2 AND label_1d IS NOT NULL THEN greatest(least(label_1d, hi), lo) END', 'label_1d')}
    FROM panel JOIN e USING (datetime)""",
)
def winsorised(spark, sf_dir):
    rows = panel(spark, sf_dir).select("instrument", "datetime", "label_1d")
    return rounded(labels.winsorised_label(rows, "label_1d"))


def _rank_label_sql(bins: int, thin: int) -> str:
    return f"""WITH {PANEL}, p AS (SELECT instrument, datetime, label_1d,
      CASE WHEN label_1d IS NOT NULL THEN row_number() OVER (PARTITION BY datetime, label_1d IS NULL ORDER BY label_1d, instrument) END AS rk,
      count(label_1d) OVER (PARTITION BY datetime) AS n FROM panel)
    SELECT instrument, datetime, CASE WHEN rk IS NOT NULL AND n >= {thin}
      THEN greatest(CAST(ceil((rk - 1) * {bins} / greatest(n - 1, 1)::DOUBLE) AS BIGINT) - 1, 0) END AS rank_label FROM p"""


@query("label_rank_bins", _rank_label_sql(5, 30))
def rank_bins(spark, sf_dir):
    rows = panel(spark, sf_dir).select("instrument", "datetime", "label_1d")
    return labels.rank_label(rows, "label_1d").select("instrument", "datetime", "rank_label")


@query("label_rank_bins_ranker", _rank_label_sql(4, 10))
def rank_bins_ranker(spark, sf_dir):
    rows = panel(spark, sf_dir).select("instrument", "datetime", "label_1d")
    return labels.rank_label(rows, "label_1d", 4, 10).select("instrument", "datetime", "rank_label")


@query(
    "label_binary_extremes",
    f"""WITH {PANEL}, e AS (SELECT datetime, quantile_cont(label_1d, 0.2) AS lo, quantile_cont(label_1d, 0.8) AS hi, count(label_1d) AS n
    FROM panel GROUP BY datetime)
    SELECT instrument, datetime,
      CASE WHEN n >= 30 THEN CASE WHEN label_1d >= hi AND NOT label_1d <= lo THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS binary_label,
      n >= 30 AND coalesce(label_1d <= lo OR label_1d >= hi, false) AS is_extreme
    FROM panel JOIN e USING (datetime)""",
)
def binary(spark, sf_dir):
    rows = panel(spark, sf_dir).select("instrument", "datetime", "label_1d")
    return labels.binary_label(rows, "label_1d").select("instrument", "datetime", "binary_label", "is_extreme")


def quantile_bin_sql(value: str, edges: str, bins: int) -> str:
    """Bin 0.. of ``value`` given a list of edges; repeated edges merge."""
    return f"greatest(len(list_filter(list_distinct({edges}), lambda v: v < {value})) - 1, 0)"


QUINTILES = "quantile_cont({0}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])"


@query(
    "label_quintile_target",
    f"""WITH {PANEL}, e AS (SELECT datetime, {QUINTILES.format('label_5d')} AS edges FROM panel GROUP BY datetime)
    SELECT instrument, datetime, CAST(CASE WHEN label_5d IS NULL THEN 0 ELSE {quantile_bin_sql('label_5d', 'edges', 5)} END AS BIGINT) AS target
    FROM panel JOIN e USING (datetime)""",
)
def quintile_target(spark, sf_dir):
    rows = panel(spark, sf_dir).select("instrument", "datetime", "label_5d")
    return labels.quintile_target(rows, "label_5d").select("instrument", "datetime", "target")


# --- cross-section transforms ------------------------------------------------------------

LONG = long_sql()
_OUT = ["datetime", "instrument", "factor", "value"]


def winsor_sql(source: str, name: str, interpolation: str = "linear") -> str:
    def at(p: float) -> str:
        if interpolation == "linear":
            return f"quantile_cont(value, {p})"
        return f"list_sort(list(value) FILTER (value IS NOT NULL))[floor((count(value) - 1) * {p}::DOUBLE + 0.5::DOUBLE)::BIGINT + 1]"

    return f"""{name} AS (SELECT s.datetime, instrument, s.factor, label,
      CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END AS value
      FROM {source} s JOIN (SELECT datetime, factor, {at(0.01)} AS lo, {at(0.99)} AS hi FROM {source} GROUP BY datetime, factor) q
      ON s.datetime = q.datetime AND s.factor = q.factor)"""


def median_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT datetime, instrument, factor, label,
      coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY datetime, factor)) AS value FROM {source})"""


def rank_sql(source: str, name: str) -> str:
    """Ranks from running counts of the distinct values."""
    return f"""{name} AS (SELECT s.datetime, instrument, s.factor, label, (2 * upto - c + 1) / 2.0::DOUBLE / total * 2 - 1 AS value
      FROM {source} s LEFT JOIN (
        SELECT *, sum(c) OVER (PARTITION BY datetime, factor ORDER BY value ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
               sum(c) OVER (PARTITION BY datetime, factor)::BIGINT AS total
        FROM (SELECT datetime, factor, value, count(*) AS c FROM {source} WHERE value IS NOT NULL GROUP BY 1, 2, 3)) p
      ON s.datetime = p.datetime AND s.factor = p.factor AND s.value = p.value)"""


def zscore_sql(source: str, name: str) -> str:
    w = "OVER (PARTITION BY datetime, factor)"
    return f"""{name} AS (SELECT datetime, instrument, factor, label,
      CASE WHEN count(value) {w} < 2 THEN value ELSE (value - avg(value) {w}) / nullif(stddev_samp(value) {w}, 0) END AS value
      FROM {source})"""


def _final(*ctes: str) -> str:
    last = ctes[-1].split(" AS ")[0]
    return f"WITH {LONG}, {', '.join(ctes)} SELECT datetime, instrument, factor, {r('value', 'value')} FROM {last}"


def _xsection(name: str, sql: str, transform) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return rounded(transform(long_panel(spark, sf_dir)).select(*_OUT))


_xsection("xsection_winsorise", _final(winsor_sql("long", "w")), xsection.winsorise)
_xsection(
    "xsection_winsorise_nearest",
    _final(winsor_sql("long", "w", "nearest")),
    lambda long: xsection.winsorise(long, interpolation="nearest"),
)
_xsection("xsection_impute_median", _final(median_sql("long", "m")), xsection.impute_median)
_xsection("xsection_rank_transform", _final(rank_sql("long", "k")), xsection.rank_transform)
_xsection("xsection_zscore", _final(zscore_sql("long", "z")), xsection.zscore)
_xsection(
    "xsection_preprocess_rank",
    _final(winsor_sql("long", "w"), median_sql("w", "m"), rank_sql("m", "k")),
    xsection.preprocess,
)
_xsection(
    "xsection_preprocess_zscore",
    _final(winsor_sql("long", "w"), median_sql("w", "m"), zscore_sql("m", "z")),
    lambda long: xsection.preprocess(long, "zscore"),
)
_xsection(
    "xsection_screening_preprocess",
    _final(winsor_sql("long", "w", "nearest"), rank_sql("w", "k")),
    lambda long: xsection.preprocess(long, impute=False, interpolation="nearest"),
)


@query(
    "xsection_features_wide",
    f"WITH {PANEL} SELECT datetime, instrument, "
    + ", ".join(r(f"coalesce({f}, 0.0::DOUBLE)", f) for f in FACTORS)
    + " FROM panel",
)
def features_wide(spark, sf_dir):
    """Long to wide and back, missing values set to zero for the tree models."""
    wide = xsection.to_wide(long_panel(spark, sf_dir), FACTORS)
    return rounded(xsection.zero_missing(wide, FACTORS))


@query(
    "xsection_date_grid",
    f"WITH {BARS}, {CALENDAR} SELECT datetime, date_idx FROM cal",
)
def date_grid(spark, sf_dir):
    from factorloom.functions.calendar import date_index

    return date_index(bars(spark, sf_dir)).select(F.col("datetime"), "date_idx")
