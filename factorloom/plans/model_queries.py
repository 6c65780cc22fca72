"""Time-split, model and selection queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.functions.numeric import correlation, rounded
from factorloom.operators import book, factors, gram, ic, labels, models, ranking, splits, xsection
from factorloom.plans.oracle import CALENDAR, average_rank, r, rank_ic
from factorloom.plans.panel import FACTORS, PANEL, long_panel, panel
from factorloom.plans.registry import query
from factorloom.plans.screening_queries import DAILY5, SUMMARY_COLUMNS, summary_sql
from factorloom.sources.shared import stored
from factorloom.sources.tables import bars

BASE = f"{PANEL}, {CALENDAR}"

# --- splits ---------------------------------------------------------------------------

_TRAIN, _VAL, _TEST = ("1995-01-01", "1998-12-31"), ("1999-01-01", "1999-12-31"), ("2000-01-01", None)


def _purged(end: str, horizon: int) -> str:
    last = f"(SELECT max(date_idx) FROM cal WHERE datetime <= DATE '{end}')"
    return f"(SELECT datetime FROM cal WHERE date_idx = greatest({last} - {horizon}, 0))"


@query(
    "split_static",
    f"""WITH {BASE} SELECT 'train' AS split, DATE '{_TRAIN[0]}' AS start, {_purged(_TRAIN[1], 5)} AS "end"
    UNION ALL SELECT 'val', DATE '{_VAL[0]}', {_purged(_VAL[1], 5)} UNION ALL SELECT 'test', DATE '{_TEST[0]}', NULL""",
)
def split_static(spark, sf_dir):
    return splits.static_splits(panel(spark, sf_dir), 5, _TRAIN, _VAL, _TEST)


def windows_sql(mode: str) -> str:
    """Walk-forward windows of 6-month steps and validation, 12 months of training, embargo of 2 dates."""
    days = lambda m: f"greatest(1, floor({m} * dens)::BIGINT)"
    first = 12 if mode == "rolling" else 3
    start = f"greatest(s, te - {days(12)})" if mode == "rolling" else "s"
    d = lambda e: f"(SELECT datetime FROM cal WHERE date_idx = {e})"
    return f"""st AS (SELECT count(*) AS n, count(*) / (max(datetime) - min(datetime))::DOUBLE * 30 AS dens,
      (SELECT max(date_idx) FROM cal WHERE datetime <= DATE '1996-01-15') AS s FROM cal),
    w0 AS (SELECT *, unnest(generate_series(0, n)) AS k FROM st),
    w1 AS (SELECT *, least(s + {days(first)}, n - 1) + k * {days(6)} AS te FROM w0),
    w2 AS (SELECT *, {start} AS ts, te + 2 AS vs, least(te + 2 + {days(6)}, n - 1) AS ve FROM w1),
    w3 AS (SELECT *, ve + 1 AS os, least(ve + {days(6)}, n - 1) AS oe FROM w2 WHERE (k = 0 OR te < n - {days(6)} - 2) AND vs < n AND ve + 1 < n),
    win AS (SELECT k::BIGINT AS window_id, {d('ts')} AS train_start, {d('te')} AS train_end, {d('vs')} AS val_start, {d('ve')} AS val_end, {d('os')} AS oos_start, {d('oe')} AS oos_end FROM w3)"""


def _windows(rows, mode: str = "expanding"):
    return splits.walk_forward_windows(rows, "1996-01-15", 6, 6, 12, 2, mode)


def _window_query(mode: str) -> None:
    @query(f"split_walk_forward_{mode}", f"WITH {BASE}, {windows_sql(mode)} SELECT * FROM win")
    def run(spark, sf_dir):
        return _windows(panel(spark, sf_dir), mode)


for _mode in ("expanding", "rolling"):
    _window_query(_mode)

ROWS = f"""{windows_sql('expanding')}, roles AS (SELECT window_id, 'train' AS role, train_start AS a, train_end AS b FROM win
  UNION ALL SELECT window_id, 'val', val_start, val_end FROM win UNION ALL SELECT window_id, 'oos', oos_start, oos_end FROM win),
wr AS (SELECT panel.*, window_id, role FROM panel JOIN roles ON datetime BETWEEN a AND b WHERE label_1d IS NOT NULL)"""


def _window_rows(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return splits.window_rows(rows, _windows(rows), "label_1d")


@query("split_window_rows", f"WITH {BASE}, {ROWS} SELECT window_id, role, count(*) AS n, min(datetime) AS first_date, max(datetime) AS last_date FROM wr GROUP BY 1, 2")
def window_rows(spark, sf_dir):
    return _window_rows(spark, sf_dir).groupBy("window_id", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_date"), F.max("datetime").alias("last_date")
    )


# --- one line per window and factor: the whole way from training to a choice, in closed form ---

_LINES = f"""{ROWS}, wl AS ({' UNION ALL '.join(f"SELECT window_id, role, datetime, instrument, label_1d AS label, '{f}' AS model, {f} AS x FROM wr" for f in FACTORS)}),
ln AS (SELECT window_id, model, regr_slope(label, x) AS b, regr_intercept(label, x) AS a FROM wl WHERE role = 'train' GROUP BY 1, 2),
pr AS (SELECT wl.*, a + b * x AS value FROM wl JOIN ln USING (window_id, model) WHERE role <> 'train'),
sig AS (SELECT model, datetime, instrument, max_by(value, window_id) AS signal FROM pr WHERE role = 'oos' GROUP BY 1, 2, 3)"""
_WINDOW_IC = f"{rank_ic('wic0', 'pr', 'model, role, window_id, datetime', min_count=5)}, wic AS (SELECT * FROM wic0 WHERE ic IS NOT NULL)"


def _predictions(rows):
    """Of the lines of every window of the stored panel, in a column for each factor; stored."""
    windows = splits.window_rows(rows, _windows(rows), "label_1d")
    return stored(models.single_factor_columns(windows, FACTORS, "label_1d"), "predictions")


def _panel(spark, sf_dir):
    return stored(panel(spark, sf_dir), "panel")


def _concatenated(predictions):
    signals = splits.concatenated_signals(predictions.where("role = 'oos'"), FACTORS)
    return signals.unpivot(["datetime", "instrument"], FACTORS, "model", "prediction")


def _window_ics(predictions):
    """Ranked date by date on the wide rows, whose predictions of all models share one copy of the label."""
    daily = ic.column_rank_correlation(predictions, ["role", "window_id", "datetime"], FACTORS, "label_1d", 5)
    return daily.withColumnRenamed("factor", "model").where("ic IS NOT NULL")


@query("model_concatenated_signals", f"WITH {BASE}, {_LINES} SELECT model, datetime, instrument, {r('signal', 'prediction')} FROM sig")
def concatenated_signals(spark, sf_dir):
    """Out-of-sample predictions of every window and factor; where windows overlap the latest one stands."""
    return rounded(_concatenated(_predictions(_panel(spark, sf_dir))))


@query(
    "model_window_metrics",
    f"WITH {BASE}, {_LINES}, {_WINDOW_IC}, {summary_sql('wic', 's', 'model, role')} SELECT model, role, {SUMMARY_COLUMNS}, n_days FROM s",
)
def window_metrics(spark, sf_dir):
    """Daily ICs of the predictions of all windows pooled, for validation and out-of-sample dates."""
    return rounded(ic.ic_summary(_window_ics(_predictions(_panel(spark, sf_dir))), ["model", "role"]))


_ORIENTED = f"""{_LINES}, {_WINDOW_IC},
dir AS (SELECT model, CASE WHEN avg(ic) < 0 THEN -1 ELSE 1 END AS direction FROM wic WHERE role = 'val' GROUP BY 1),
ori AS (SELECT model, datetime, instrument, signal * direction AS signal FROM sig JOIN dir USING (model))"""


def _oriented(predictions):
    """Out-of-sample predictions, turned where the validation IC is negative."""
    daily = _window_ics(predictions.where("role = 'val'")).withColumnRenamed("model", "factor")
    signals = _concatenated(predictions).withColumnRenamed("model", "factor")
    oriented = ic.oriented(signals, daily, "prediction")
    return oriented.select(F.col("factor").alias("model"), "datetime", "instrument", F.col("prediction").alias("signal"))


@query("model_oriented_predictions", f"WITH {BASE}, {_ORIENTED} SELECT model, datetime, instrument, {r('signal', 'signal')} FROM ori")
def oriented_predictions(spark, sf_dir):
    return rounded(_oriented(_predictions(_panel(spark, sf_dir))))


_TOPK = 20
_BOOK = f"""{_ORIENTED}, rt AS (SELECT instrument, c.datetime, label_1d AS ret FROM panel JOIN cal p USING (datetime) JOIN cal c ON c.date_idx = p.date_idx + 1),
dy AS (SELECT model, datetime, row_number() OVER (PARTITION BY model ORDER BY datetime) - 1 AS day FROM (SELECT DISTINCT model, datetime FROM ori) SEMI JOIN rt USING (datetime)),
hd AS (SELECT model, day + 1 AS day, instrument FROM ori JOIN dy USING (model, datetime) WHERE signal IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY model, day ORDER BY signal DESC, instrument) <= {_TOPK}),
wt AS (SELECT model, day, instrument, 1.0::DOUBLE / {_TOPK} AS weight FROM hd JOIN (SELECT model, day FROM hd GROUP BY 1, 2 HAVING count(*) = {_TOPK}) USING (model, day)
  SEMI JOIN dy USING (model, day)),
ch AS (SELECT model, day, instrument, sum(weight) AS c FROM (SELECT * FROM wt UNION ALL SELECT model, day + 1, instrument, -weight FROM wt) GROUP BY 1, 2, 3),
tv AS (SELECT model, day, sum(abs(c)) / 2 AS t FROM ch GROUP BY 1, 2),
gr AS (SELECT wt.model, wt.day, sum(weight * coalesce(ret, 0)) AS gross FROM wt JOIN dy USING (model, day) LEFT JOIN rt ON rt.datetime = dy.datetime AND rt.instrument = wt.instrument GROUP BY 1, 2),
bm AS (SELECT datetime, avg(ret) AS benchmark FROM rt GROUP BY 1),
bt AS (SELECT model, datetime, gross - coalesce(t, 0) * 0.001::DOUBLE AS portfolio_return, gross - coalesce(t, 0) * 0.001::DOUBLE - benchmark AS excess_return, coalesce(t, 0) AS turnover
  FROM dy LEFT JOIN tv USING (model, day) LEFT JOIN gr USING (model, day) LEFT JOIN bm USING (datetime))"""


def _book(rows, predictions):
    # The signals give the dates and the best names.
    signals = stored(_oriented(predictions), "signals")
    return book.topk_backtest(book.returns_from_label(rows), signals, _TOPK, 10, by=("model",))


@query("model_book", f"WITH {BASE}, {_BOOK} SELECT model, datetime, {r('portfolio_return', 'portfolio_return')}, {r('excess_return', 'excess_return')}, {r('turnover', 'turnover')} FROM bt")
def model_book(spark, sf_dir):
    """The top-k book of every model's oriented predictions."""
    rows = _panel(spark, sf_dir)
    return rounded(_book(rows, _predictions(rows)).drop("benchmark"))


_METRICS = f"""{_BOOK}, cm AS (SELECT model, datetime, product(1 + portfolio_return) OVER (PARTITION BY model ORDER BY datetime) AS c FROM bt WHERE portfolio_return IS NOT NULL),
dn AS (SELECT model, min(d) AS max_drawdown FROM (SELECT model, c / max(c) OVER (PARTITION BY model ORDER BY datetime) - 1 AS d FROM cm) GROUP BY 1),
mt AS (SELECT model, avg(excess_return) * 252 AS ann_excess_return, coalesce(avg(excess_return) / nullif(stddev_samp(excess_return), 0) * sqrt(252), 0) AS excess_sharpe,
  avg(turnover) AS avg_turnover, count(portfolio_return) AS n_periods FROM bt GROUP BY 1),
bk AS (SELECT mt.*, max_drawdown FROM mt LEFT JOIN dn USING (model))"""


def _metrics(rows, predictions):
    return book.backtest_metrics(stored(_book(rows, predictions), "daily"), ("model",))


_BOOK_MEASURES = ("ann_excess_return", "excess_sharpe", "avg_turnover", "max_drawdown")


@query("model_book_metrics", f"WITH {BASE}, {_METRICS} SELECT model, {', '.join(r(c, c, 4) for c in _BOOK_MEASURES)}, n_periods FROM bk")
def model_book_metrics(spark, sf_dir):
    rows = _panel(spark, sf_dir)
    return rounded(_metrics(rows, _predictions(rows)).select("model", *_BOOK_MEASURES, "n_periods"), 4)


# --- models on MLlib ------------------------------------------------------------------
#
# Their numbers have no SQL form, so they learn a planted label, a step of one factor that depends on the date's place in nothing else. SQL
# states all labelled rows, and that predictions follow the label on dates that the model never saw; a broken model does not.

_DRIVER = "KSFT"
_KNOWN = "label_1d IS NOT NULL AND KSFT IS NOT NULL"
_LATER = "datetime >= DATE '1999-01-01'"
_STEP = "CASE WHEN KSFT > 0.6 THEN 1.0 WHEN KSFT > 0.3 THEN 0.5 ELSE 0.0 END"


def _train(spark, sf_dir, known=_KNOWN):
    """Rows of earlier dates that have the planted label, and all ``known`` rows."""
    rows = panel(spark, sf_dir).where(known).withColumn("planted", F.expr(f"CASE WHEN KSFT IS NOT NULL THEN {_STEP} END").cast("double"))
    rows = stored(rows, "planted")
    return rows.where(f"NOT {_LATER} AND planted IS NOT NULL"), rows


def _model_query(name: str) -> None:
    @query(f"model_{name}", f"WITH {PANEL} SELECT datetime, instrument, true AS scored, true AS follows FROM panel WHERE label_1d IS NOT NULL")
    def run(spark, sf_dir):
        """Every labelled row has a score, and those of later dates, which the model never saw, follow the planted label."""
        train, rows = _train(spark, sf_dir, "label_1d IS NOT NULL")
        predictions = models.predict(models.MODELS[name](train, FACTORS, "planted"), rows, FACTORS, ("planted",))
        pooled = correlation(F.col("prediction"), F.col("planted"))
        # One row: the correlation over all later dates.
        follows = bool(predictions.where(_LATER).agg(F.coalesce(pooled > 0.7, F.lit(False))).first()[0])
        return _scored(predictions).withColumn("follows", F.lit(follows))


for _name in models.MODELS:
    _model_query(_name)


@query(
    "model_pairwise_ranker",
    f"""WITH {PANEL}, v AS (SELECT datetime, {_STEP} AS planted FROM panel WHERE {_KNOWN} AND {_LATER}),
    s AS (SELECT datetime, planted, count(*) AS n FROM v GROUP BY 1, 2)
    SELECT a.datetime, sum(a.n * b.n)::BIGINT AS n_pairs, true AS concordant FROM s a JOIN s b ON a.datetime = b.datetime AND a.planted > b.planted GROUP BY 1""",
)
def pairwise_ranker(spark, sf_dir):
    """A linear scorer trained on pairs of names: on later dates nine in ten pairs of different labels are in the right order."""
    train, rows = _train(spark, sf_dir)
    model = ranking.pairwise_scorer(train, FACTORS, "planted", min_names=5)
    later = ranking.predict(model, rows.where(_LATER), ("planted",))
    found = ranking.concordance(later, "planted")
    return found.select("datetime", "n_pairs", (F.col("concordance") > 0.9).alias("concordant"))


_NAMES = ", ".join(f"('{f}')" for f in FACTORS)


def _scored(predictions, *keys: str):
    finite_score = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
    return predictions.select(*keys, "datetime", "instrument", F.coalesce(finite_score, F.lit(False)).alias("scored"))


_IMPORTANT = f"""SELECT feature, feature = '{_DRIVER}' AS largest, true AS not_negative, (SELECT count(*) FROM panel WHERE {_KNOWN}) AS n
    FROM (VALUES {_NAMES}) t(feature)"""


def _ranked_importance(table, rows):
    """``feature``, whether it is the most important one, and how many rows were there."""
    most = F.max("importance").over(Window.partitionBy(F.lit(0)))
    return table.select(
        "feature", (F.col("importance") == most).alias("largest"), (F.col("importance") >= -0.05).alias("not_negative"), F.lit(rows.count()).cast("bigint").alias("n")
    )


@query("model_feature_importance", f"WITH {PANEL} {_IMPORTANT}")
def feature_importance(spark, sf_dir):
    """Importances of the features for a planted label: none negative, the driver's the largest."""
    train, rows = _train(spark, sf_dir)
    table = models.feature_importance(models.boosted_regressor(train, FACTORS, "planted"), FACTORS)
    return _ranked_importance(table, rows)


@query("model_permutation_importance", f"WITH {PANEL} {_IMPORTANT}")
def permutation_importance(spark, sf_dir):
    """Drop of the pooled IC for every feature: the driver's is the largest, and no shuffle helps by more than chance."""
    train, rows = _train(spark, sf_dir)
    fitted = models.elastic_net(train, FACTORS, "planted", alpha=0.0001)
    return _ranked_importance(models.permutation_importance(fitted, rows, FACTORS, "planted"), rows)


# --- all windows from moment matrices ---------------------------------------------------

_TWO = ("KMID", "ROC5")
_TWO_SQL = f"""{ROWS}, tf AS (SELECT window_id, role, datetime, instrument, label_1d AS y, coalesce(KMID, 0) AS a, coalesce(ROC5, 0) AS b FROM wr),
ce AS (SELECT window_id, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
       avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM tf WHERE role = 'train' GROUP BY 1),
be AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM ce)"""


@query(
    "model_two_factor_windows",
    f"""WITH {BASE}, {_TWO_SQL} SELECT window_id, role, datetime, instrument, n, {r('my + wa * (a - ma) + wb * (b - mb)', 'prediction')}
    FROM tf JOIN be USING (window_id) WHERE role <> 'train'""",
)
def two_factor_windows(spark, sf_dir):
    """Least squares on two factors in every window, from the windows' moment matrices."""
    rows = stored(panel(spark, sf_dir), "panel")
    days = gram.window_days(_windows(rows))
    rows = rows.where(F.col("label_1d").isNotNull())
    fitted = stored(gram.window_models(rows, days, _TWO, "label_1d", {"line": (0.0, 0.0)}), "lines")
    found = gram.window_predictions(rows, days, _TWO, "label_1d", fitted).join(fitted.select("window_id", "n"), "window_id")
    return rounded(found.select("window_id", "role", "datetime", "instrument", "n", "prediction"))


def prepared_library(spark, sf_dir):
    """All 158 factors and the label, one row per bar: per date winsorised, imputed by the median and ranked."""
    labelled = labels.with_forward_returns(bars(spark, sf_dir), (1,))
    table = factors.factor_table(stored(labelled, "bars"), keep=("instrument", "datetime", "label_1d"))
    return xsection.preprocess_columns(table, factors.factor_names(), ["label_1d"])


#: Model: penalty, and the share of it that is absolute.
LINEAR = {"ridge": (0.01, 0.0), "elastic_net": (0.01, 0.2), "lasso": (0.001, 1.0)}


@query(
    "model_walk_forward",
    f"""WITH {BASE}, {ROWS}, o AS (SELECT DISTINCT datetime, instrument FROM wr WHERE role = 'oos')
    SELECT model, datetime, instrument, true AS scored FROM o, (VALUES {', '.join(f"('{m}')" for m in LINEAR)}) t(model)""",
)
def walk_forward(spark, sf_dir):
    """Three linear models of all 158 factors in each of the windows; every row of every out-of-sample range has a score."""
    prepared = prepared_library(spark, sf_dir)
    rows = prepared.where(F.col("label_1d").isNotNull())
    predictions = gram.walk_forward(rows, _windows(prepared), factors.factor_names(), "label_1d", LINEAR)
    return _scored(splits.concatenated_signals(predictions.where("role = 'oos'"), by=("model",)), "model")


#: A label made of two factors, which linear models of all factors must find again.
_PLANTED = "2 * coalesce(RANK20, 0) - coalesce(KSFT, 0)"


@query(
    "model_walk_forward_planted",
    f"""WITH {BASE}, {ROWS} SELECT model, window_id, role, count(*) AS n, true AS follows
    FROM wr, (VALUES {', '.join(f"('{m}')" for m in LINEAR)}) t(model) WHERE role <> 'train' GROUP BY ALL""",
)
def walk_forward_planted(spark, sf_dir):
    """The same models on a label made of two of the 158 factors: predictions of all windows follow it closely."""
    prepared = prepared_library(spark, sf_dir)
    rows = prepared.where(F.col("label_1d").isNotNull()).withColumn("planted", F.expr(_PLANTED))
    predictions = gram.walk_forward(rows, _windows(prepared), factors.factor_names(), "planted", LINEAR)
    close = F.abs(correlation(F.col("prediction"), F.col("planted")) - 1) < 0.02
    return predictions.groupBy("model", "window_id", "role").agg(F.count(F.lit(1)).alias("n"), F.coalesce(close, F.lit(False)).alias("follows"))


# --- choice ---------------------------------------------------------------------------


def _summary(spark, sf_dir):
    return ic.ic_summary(ic.daily_rank_ic(long_panel(spark, sf_dir)))


@query("model_best_by_icir", f"WITH {DAILY5}, {summary_sql('daily', 's')} SELECT factor AS model FROM s ORDER BY abs(icir) DESC, factor LIMIT 1")
def best_by_icir(spark, sf_dir):
    return models.best_by_icir(_summary(spark, sf_dir).withColumnRenamed("factor", "model"))


def _pct(c: str) -> str:
    return f"{average_rank(c, 'passed')} / count(*) OVER (PARTITION BY passed)"


_CANDIDATES_SQL = f"""{_METRICS}, {summary_sql('oos', 'so', 'model')}, nw AS (SELECT model, count(DISTINCT window_id) AS n_windows FROM pr GROUP BY 1),
cand AS (SELECT model, ic_mean AS oos_ic, icir AS oos_icir, ann_excess_return, excess_sharpe, max_drawdown, avg_turnover, win_rate AS positive_ratio, n_windows
  FROM so JOIN bk USING (model) JOIN nw USING (model))""".replace(", so AS", ", oos AS (SELECT * FROM wic WHERE role = 'oos'), so AS", 1)


@query(
    "model_live_selection",
    f"""WITH {BASE}, {_CANDIDATES_SQL},
    rej AS (SELECT *, concat_ws(', ', CASE WHEN NOT coalesce(oos_ic > 0, false) THEN 'oos_ic' END, CASE WHEN NOT coalesce(oos_icir > 0, false) THEN 'oos_icir' END,
      CASE WHEN NOT coalesce(ann_excess_return > -10, false) THEN 'ann_excess_return' END, CASE WHEN NOT coalesce(excess_sharpe > -10, false) THEN 'excess_sharpe' END,
      CASE WHEN NOT coalesce(max_drawdown >= -0.99, false) THEN 'max_drawdown' END, CASE WHEN NOT coalesce(avg_turnover <= 0.9, false) THEN 'avg_turnover' END,
      CASE WHEN NOT coalesce(positive_ratio >= 0.4, false) THEN 'positive_ratio' END, CASE WHEN n_windows < 3 THEN 'n_windows' END) AS rejection_reasons FROM cand),
    jd AS (SELECT *, rejection_reasons = '' AS passed FROM rej),
    sc AS (SELECT *, CASE WHEN passed THEN 0.3::DOUBLE * {_pct('oos_icir')} + 0.3::DOUBLE * {_pct('excess_sharpe')} + 0.2::DOUBLE * {_pct('ann_excess_return')}
      + 0.1::DOUBLE * {_pct('positive_ratio')} + 0.05::DOUBLE * (1 + max_drawdown) + 0.05::DOUBLE * (1 - least(avg_turnover / 0.9::DOUBLE, 1)) END AS score FROM jd)
    SELECT model, passed, rejection_reasons, {r('score', 'score', 4)}, CASE WHEN passed THEN row_number() OVER (PARTITION BY passed ORDER BY score DESC, model) END AS place FROM sc""",
)
def live_selection(spark, sf_dir):
    """Models judged by what was measured on their out-of-sample predictions; limits that this data can meet."""
    rows = _panel(spark, sf_dir)
    predictions = _predictions(rows)
    ics = ic.ic_summary(_window_ics(predictions.where("role = 'oos'")), ["model"])
    # Every model has predictions of the same windows.
    counts = predictions.agg(F.count_distinct("window_id").alias("n_windows"))
    candidates = ics.join(_metrics(rows, predictions).drop("win_rate"), "model").crossJoin(counts).select(
        "model", F.col("ic_mean").alias("oos_ic"), F.col("icir").alias("oos_icir"), *_BOOK_MEASURES, F.col("win_rate").alias("positive_ratio"), "n_windows"
    )
    limits = {"min_ann_excess_return": -10, "min_excess_sharpe": -10, "max_drawdown": -0.99, "max_avg_turnover": 0.9, "min_positive_ratio": 0.4}
    judged = models.select_live(candidates, limits)
    return rounded(judged.select("model", "passed", "rejection_reasons", "score", "place"), 4)
