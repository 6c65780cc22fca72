"""Rotation-study queries; assets are nations, a fixed list of 25 baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.calendar import date_index, join_dates
from factorloom.functions.numeric import rounded
from factorloom.operators import ingest, labels, rotation
from factorloom.plans.label_queries import QUINTILES, quantile_bin_sql
from factorloom.plans.oracle import BARS, HISTORY, frame, full, r
from factorloom.plans.registry import query
from factorloom.sources import tables
from factorloom.sources.shared import stored

BASKETS = BARS.replace("l_suppkey AS instrument", "s_nationkey::BIGINT AS instrument").replace(
    "FROM lineitem)", "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
)
OHLCV = ("open", "high", "low", "close", "volume", "amount")
_FILLED = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS {c}" for c in OHLCV)
GRID = f"""{BASKETS}, cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS date_idx FROM (SELECT DISTINCT datetime FROM bars)),
grid AS (SELECT datetime, date_idx, instrument, {_FILLED} FROM cal CROSS JOIN (SELECT DISTINCT instrument FROM bars) LEFT JOIN bars USING (datetime, instrument)),
tr0 AS (SELECT *, {full('avg(close)', 'close', 'w20', 20)} AS sma FROM grid WINDOW {frame('w20', 20)}),
tr AS (SELECT *, coalesce(close > sma, false) AS is_trending FROM tr0)"""
FALLBACK, WINDOW = 3, 24


def _grid(spark, sf_dir):
    return rotation.with_trend(ingest.on_calendar_grid(tables.basket_bars(spark, sf_dir)))


@query(
    "rotation_features",
    f"""WITH {BASKETS}, s AS (SELECT *, lag(close) OVER h AS c1, lag(close, 20) OVER h AS c20, row_number() OVER h - 1 AS t, list(close) OVER u AS seen FROM bars
      WINDOW {HISTORY}, u AS (PARTITION BY instrument ORDER BY datetime ROWS UNBOUNDED PRECEDING)),
    x AS (SELECT *, CASE WHEN close > c1 THEN close - c1 ELSE 0 END AS gain, CASE WHEN close < c1 THEN c1 - close ELSE 0 END AS loss,
      greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS tr,
      list_sum(list_transform(seen, lambda v, i: v * pow(19 / 21.0::DOUBLE, t + 1 - i))) / list_sum(list_transform(seen, lambda v, i: pow(19 / 21.0::DOUBLE, t + 1 - i))) AS ema20,
      list_sum(list_transform(seen, lambda v, i: v * pow(59 / 61.0::DOUBLE, t + 1 - i))) / list_sum(list_transform(seen, lambda v, i: pow(59 / 61.0::DOUBLE, t + 1 - i))) AS ema60 FROM s),
    f AS (SELECT instrument, datetime, ema20 / close - 1 AS ema_diff_20, ema60 / close - 1 AS ema_diff_60, close / c20 - 1 AS roc_20,
      100 - 100 / (1 + ({full('avg(gain)', 'gain', 'w14', 14)}) / (({full('avg(loss)', 'loss', 'w14', 14)}) + 1e-9)) AS rsi_14,
      ({full('avg(tr)', 'tr', 'w20', 20)}) / (close + 1e-9) AS atr_norm_20,
      (volume - ({full('avg(volume)', 'volume', 'w20', 20)})) / (({full('stddev_samp(volume)', 'volume', 'w20', 20)}) + 1e-9) AS vol_z_20
      FROM x WINDOW {frame('w14', 14)}, {frame('w20', 20)})
    SELECT instrument, datetime, {', '.join(r(c, c) for c in ('ema_diff_20', 'ema_diff_60', 'roc_20', 'rsi_14', 'atr_norm_20', 'vol_z_20'))} FROM f""",
)
def rotation_features(spark, sf_dir):
    return rounded(rotation.rotation_features(tables.basket_bars(spark, sf_dir)))


@query(
    "rotation_close_ratio",
    f"WITH {BASKETS} SELECT datetime, {r('max(close) FILTER (instrument = 1) / (max(close) FILTER (instrument = 2) + 1e-9)', 'ratio')} FROM bars WHERE instrument IN (1, 2) GROUP BY 1",
)
def close_ratio(spark, sf_dir):
    return rounded(rotation.close_ratio(tables.basket_bars(spark, sf_dir), 1, 2))


@query("rotation_trend", f"WITH {GRID} SELECT datetime, instrument, {r('sma / close', 'relative')}, is_trending FROM tr")
def trend(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return rounded(grid.select("datetime", "instrument", (F.col("sma") / F.col("close")).alias("relative"), "is_trending"))


REBALANCE = f"""reb AS (SELECT cal.datetime, date_idx FROM cal JOIN (SELECT max(datetime) AS datetime FROM cal GROUP BY date_trunc('quarter', datetime)) USING (datetime)
  WHERE date_idx >= {WINDOW})"""


@query("rotation_rebalance_dates", f"WITH {GRID}, {REBALANCE} SELECT * FROM reb")
def rebalance_dates(spark, sf_dir):
    return rotation.rebalance_dates(_grid(spark, sf_dir), "quarter", WINDOW)


HELD = f"""rr AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY date_idx) - 1 AS ret FROM tr),
rc AS (SELECT *, count(ret) OVER (PARTITION BY instrument ORDER BY date_idx RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) = {WINDOW} AS complete FROM rr),
rs AS (SELECT rc.*, max(is_trending::INT) OVER (PARTITION BY date_idx) = 1 AS any_trend, max((instrument = {FALLBACK})::INT) OVER (PARTITION BY date_idx) = 1 AS has_fallback
       FROM rc SEMI JOIN reb USING (date_idx)),
held AS (SELECT date_idx, instrument FROM rs WHERE complete AND CASE WHEN any_trend THEN is_trending WHEN has_fallback THEN instrument = {FALLBACK} ELSE true END),
wts AS (SELECT date_idx, instrument, 1 / (count(*) OVER (PARTITION BY date_idx))::DOUBLE AS weight FROM held)"""


def _weights(grid):
    rebalances = rotation.rebalance_dates(grid, "quarter", WINDOW)
    return rotation.equal_weights(rotation.eligible_assets(grid, rebalances, WINDOW, FALLBACK))


@query("rotation_weights", f"WITH {GRID}, {REBALANCE}, {HELD} SELECT date_idx, instrument, {r('weight', 'weight')} FROM wts")
def weights(spark, sf_dir):
    return rounded(_weights(_grid(spark, sf_dir)))


def _in_force(lag: int) -> str:
    return f"""fr AS (SELECT cal.datetime, cal.date_idx, (SELECT max(w.date_idx) FROM wts w WHERE w.date_idx <= cal.date_idx - {lag}) AS src FROM cal),
inf AS (SELECT fr.datetime, fr.date_idx, instrument, weight FROM fr JOIN wts ON wts.date_idx = src)"""


@query(
    "rotation_stop_exit_returns",
    f"""WITH {GRID}, {REBALANCE}, {HELD}, {_in_force(1)},
    st AS (SELECT datetime, date_idx, instrument, open, low, close, lag(close) OVER h AS pc, lag(sma) OVER h AS line FROM tr WINDOW {HISTORY}),
    sr AS (SELECT *, CASE WHEN NOT coalesce(pc > line, false) THEN 0 WHEN low < line THEN greatest(open, line) / pc - 1 ELSE close / pc - 1 END AS ret FROM st)
    SELECT inf.datetime, {r('sum(weight * coalesce(ret, 0))', 'ret')} FROM inf JOIN sr ON inf.date_idx = sr.date_idx AND inf.instrument = sr.instrument GROUP BY 1""",
)
def stop_exit_returns(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    in_force = rotation.weights_in_force(_weights(grid), date_index(grid).select("date_idx"))
    return rounded(rotation.portfolio_returns(in_force, rotation.stop_exit_returns(grid)))


@query(
    "rotation_next_returns",
    f"""WITH {GRID}, {REBALANCE}, {HELD}, {_in_force(0)},
    nr AS (SELECT date_idx, instrument, lead(close) OVER h / close - 1 AS ret FROM tr WINDOW {HISTORY})
    SELECT inf.datetime, {r('sum(weight * coalesce(ret, 0))', 'ret')} FROM inf JOIN nr ON inf.date_idx = nr.date_idx AND inf.instrument = nr.instrument GROUP BY 1""",
)
def next_returns(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    in_force = rotation.weights_in_force(_weights(grid), date_index(grid).select("date_idx"), lag=0)
    return rounded(rotation.portfolio_returns(in_force, rotation.next_returns(grid)))


@query(
    "rotation_covariance",
    f"""WITH {GRID}, {REBALANCE}, {HELD}, sm AS (SELECT held.date_idx, held.instrument, rr.date_idx AS at, ret FROM held JOIN rr
      ON rr.instrument = held.instrument AND rr.date_idx BETWEEN held.date_idx - {WINDOW - 1} AND held.date_idx)
    SELECT a.date_idx, a.instrument AS asset_a, b.instrument AS asset_b, {r('covar_samp(a.ret, b.ret)', 'covariance')}
    FROM sm a JOIN sm b ON a.date_idx = b.date_idx AND a.at = b.at GROUP BY 1, 2, 3""",
)
def covariance(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    held = rotation.eligible_assets(grid, rotation.rebalance_dates(grid, "quarter", WINDOW), WINDOW, FALLBACK)
    return rounded(rotation.covariance_matrices(grid, held, WINDOW))


def _filled_sql(source: str, name: str, by: str, budget: str, out: str) -> str:
    """Names at the cap are found by trying every count of them: the count fits if all others stay below the cap."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY share DESC, instrument) AS k, {budget} AS budget FROM {source}),
    {name}_l AS (SELECT {by}, held, max(budget) - held * 0.35::DOUBLE AS rest, sum(share) FILTER (k > held) AS behind, max(share) FILTER (k > held) AS next
      FROM {name}_o, (SELECT unnest(range(0, 4)) AS held) GROUP BY {by}, held),
    {name}_c AS (SELECT {by}, arg_min(rest / behind, held) AS factor FROM {name}_l WHERE behind IS NOT NULL AND rest / behind * next <= 0.35::DOUBLE GROUP BY {by}),
    {name} AS (SELECT o.* EXCLUDE (k, budget), CASE WHEN factor IS NULL THEN 0.35::DOUBLE ELSE least(0.35::DOUBLE, factor * share) END AS {out}
      FROM {name}_o o LEFT JOIN {name}_c USING ({by}))"""


#: From scores, ``sco``, to weights, ``alo``.
ALLOCATED = f"""tp AS (SELECT datetime, instrument, greatest(score, 0) AS score FROM sco QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) <= 4),
    sh AS (SELECT *, score / total + 1e-9::DOUBLE AS share, instrument IN (1, 2) AS grp FROM (SELECT *, sum(score) OVER (PARTITION BY datetime) AS total FROM tp) WHERE total > 1e-9),
    {_filled_sql('sh', 'al', 'datetime', '1.0::DOUBLE', 'w_alone')},
    ov AS (SELECT *, sum(CASE WHEN grp THEN w_alone ELSE 0 END) OVER (PARTITION BY datetime) > 0.2::DOUBLE AS crowded FROM al),
    {_filled_sql('ov', 'spl', 'datetime, grp', 'CASE WHEN grp THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END', 'w_split')},
    w AS (SELECT datetime, instrument, CASE WHEN crowded THEN w_split ELSE w_alone END AS w FROM spl),
    alo AS (SELECT datetime, instrument, w / sum(w) OVER (PARTITION BY datetime) AS weight FROM w
      UNION ALL SELECT datetime, instrument, 1.0::DOUBLE FROM sco WHERE instrument = {FALLBACK} AND datetime NOT IN (SELECT datetime FROM sh))"""

CAPPED_SQL = f"""{BASKETS}, sco AS (SELECT * FROM (SELECT datetime, instrument, close / lag(close, 20) OVER h - 1 AS score FROM bars WINDOW {HISTORY}) WHERE score IS NOT NULL),
    {ALLOCATED} SELECT datetime, instrument, {r('weight', 'weight')} FROM alo"""


@query("rotation_capped_allocation", f"WITH {CAPPED_SQL}")
def capped_allocation(spark, sf_dir):
    """Momentum scores, the best four assets per date, two assets under a joint cap."""
    features = rotation.rotation_features(tables.basket_bars(spark, sf_dir))
    scores = features.where(F.col("roc_20").isNotNull()).select("datetime", "instrument", F.col("roc_20").alias("score"))
    return rounded(rotation.capped_allocation(scores, [1, 2], [FALLBACK]))


# --- a model per rebalance date ---------------------------------------------------------
#
# Bars are months here, so windows, purge and horizon are shorter than for daily bars. Two features without a penalty have a closed form.

_TRAIN_ROWS, _PURGE, _HORIZON = 36, 3, 3
_TWO = ("roc_20", "rsi_14")
SCORED = f"""px AS (SELECT *, close / lag(close) OVER h - 1 AS ret, greatest(close - lag(close) OVER h, 0) AS up, greatest(lag(close) OVER h - close, 0) AS down FROM bars WINDOW {HISTORY}),
pf AS (SELECT instrument, datetime, close / lag(close, 20) OVER h - 1 AS a,
    100 - 100 / (1 + ({full('avg(coalesce(up, 0))', 'close', 'w14', 14)}) / (({full('avg(coalesce(down, 0))', 'close', 'w14', 14)}) + 1e-9)) AS b,
    (lead(close, {_HORIZON}) OVER h / close - 1) / (CASE WHEN count(ret) OVER n >= {_HORIZON} THEN stddev_samp(ret) OVER n END * sqrt({_HORIZON}.0::DOUBLE) + 1e-9) AS y
  FROM px WINDOW {HISTORY}, {frame('w14', 14)}, n AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND {_HORIZON} FOLLOWING)),
pk AS (SELECT * FROM pf WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL),
pe AS (SELECT datetime, {QUINTILES.format('y')} AS edges FROM pk GROUP BY 1),
pt AS (SELECT pk.*, {quantile_bin_sql('y', 'edges', 5)}::DOUBLE AS t, date_idx FROM pk JOIN pe USING (datetime) JOIN cal USING (datetime)),
rd AS (SELECT cal.* FROM cal JOIN (SELECT max(datetime) AS datetime FROM cal GROUP BY date_trunc('quarter', datetime)) USING (datetime) WHERE date_idx > {_TRAIN_ROWS + _PURGE}),
pm AS (SELECT rd.datetime, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, t) AS at_, covar_pop(b, t) AS bt, avg(a) AS ma, avg(b) AS mb, avg(t) AS mt
  FROM rd JOIN pt ON pt.date_idx BETWEEN rd.date_idx - {_TRAIN_ROWS} AND rd.date_idx - {_PURGE} GROUP BY 1),
pw AS (SELECT *, (at_ * bb - bt * ab) / (aa * bb - ab * ab) AS wa, (bt * aa - at_ * ab) / (aa * bb - ab * ab) AS wb FROM pm),
sco AS (SELECT datetime, instrument, CASE WHEN a IS NULL OR b IS NULL THEN -999 ELSE mt + wa * (a - ma) + wb * (b - mb) END AS score FROM pf JOIN pw USING (datetime))"""


def _trained_scores(spark, sf_dir):
    bars = stored(tables.basket_bars(spark, sf_dir), "baskets")
    label = labels.risk_adjusted_return(bars, _HORIZON)
    rows = rotation.rotation_features(bars).join(label, ["instrument", "datetime"])
    windows = rotation.training_windows(bars, _TRAIN_ROWS, _PURGE, "quarter")
    return rotation.trained_scores(rows, windows, _TWO, "risk_adjusted", alpha=0.0)


@query("rotation_trained_scores", f"WITH {GRID}, {SCORED} SELECT datetime, instrument, {r('score', 'score', 5)} FROM sco")
def trained_scores(spark, sf_dir):
    """Each rebalance date's assets, scored by a model of the window before it."""
    return rounded(_trained_scores(spark, sf_dir), 5)


@query(
    "rotation_trained_returns",
    f"""WITH {GRID}, {SCORED}, {ALLOCATED}, wts AS (SELECT date_idx, instrument, weight FROM alo JOIN cal USING (datetime)), {_in_force(0)},
    nr AS (SELECT date_idx, instrument, lead(close) OVER h / close - 1 AS ret FROM tr WINDOW {HISTORY})
    SELECT inf.datetime, {r('sum(weight * coalesce(ret, 0))', 'ret', 5)} FROM inf JOIN nr ON inf.date_idx = nr.date_idx AND inf.instrument = nr.instrument GROUP BY 1""",
)
def trained_returns(spark, sf_dir):
    """From a model per rebalance date over capped weights to the portfolio's next returns."""
    grid = _grid(spark, sf_dir)
    calendar = date_index(grid)
    weights = rotation.capped_allocation(stored(_trained_scores(spark, sf_dir), "scores"), [1, 2], [FALLBACK])
    weights = join_dates(weights, calendar).select("date_idx", "instrument", "weight")
    in_force = rotation.weights_in_force(weights, calendar.select("date_idx"), lag=0)
    return rounded(rotation.portfolio_returns(in_force, rotation.next_returns(grid)), 5)
