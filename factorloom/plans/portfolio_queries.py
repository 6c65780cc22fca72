"""Top-k book and tear-sheet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.calendar import date_index
from factorloom.functions.numeric import rounded
from factorloom.operators import book, ic, tearsheet
from factorloom.plans.label_queries import quantile_bin_sql
from factorloom.plans.oracle import CALENDAR, average_rank, corr, r, rank_ic
from factorloom.plans.panel import PANEL, panel
from factorloom.plans.registry import query
from factorloom.plans.screening_queries import SUMMARY_COLUMNS, summary_sql
from factorloom.sources import tables

BASE = f"{PANEL}, {CALENDAR}, px AS (SELECT instrument, datetime, date_idx, 10 + ln(close) AS price FROM bars JOIN cal USING (datetime))"
OWN = "(PARTITION BY instrument ORDER BY date_idx)"
RETURNS = f"{BASE}, ret AS (SELECT instrument, datetime, date_idx, CASE WHEN date_idx - lag(date_idx) OVER {OWN} = 1 THEN price / lag(price) OVER {OWN} - 1 END AS ret FROM px)"
TOPK, COST = 20, 10


def _returns(spark, sf_dir):
    return book.grid_returns(tables.prices(spark, sf_dir), "price")


def _signals(spark, sf_dir):
    return panel(spark, sf_dir).select("instrument", "datetime", F.col("ROC5").alias("signal"))


# --- book -----------------------------------------------------------------------------


@query("book_grid_returns", f"WITH {RETURNS} SELECT instrument, datetime, date_idx, {r('ret', 'ret')} FROM ret")
def grid_returns(spark, sf_dir):
    return rounded(_returns(spark, sf_dir))


@query(
    "book_returns_from_label",
    f"WITH {BASE} SELECT instrument, c.datetime, {r('label_1d', 'ret')} FROM panel JOIN cal p USING (datetime) JOIN cal c ON c.date_idx = p.date_idx + 1",
)
def returns_from_label(spark, sf_dir):
    return rounded(book.returns_from_label(panel(spark, sf_dir)))


HELD = f"""held AS (SELECT date_idx + 1 AS day, instrument, row_number() OVER (PARTITION BY date_idx ORDER BY ROC5 DESC, instrument) AS place
  FROM panel JOIN cal USING (datetime) WHERE ROC5 IS NOT NULL),
top AS (SELECT day, instrument FROM held WHERE place <= {TOPK}),
wts AS (SELECT day, instrument, 1.0::DOUBLE / {TOPK} AS weight FROM top JOIN (SELECT day FROM top GROUP BY 1 HAVING count(*) = {TOPK}) USING (day)
        SEMI JOIN cal ON cal.date_idx = day)"""


@query("book_topk_weights", f"WITH {BASE}, {HELD} SELECT * FROM wts")
def topk_weights(spark, sf_dir):
    signals = _signals(spark, sf_dir)
    days = date_index(signals, index="day")
    return book.topk_weights(signals, days, TOPK)


BACKTEST = f"""{RETURNS}, {HELD},
chg AS (SELECT day, instrument, sum(weight) AS c FROM (SELECT * FROM wts UNION ALL SELECT day + 1, instrument, -weight FROM wts) GROUP BY 1, 2),
turn AS (SELECT date_idx, datetime, coalesce(t, 0) AS turnover FROM cal LEFT JOIN (SELECT day, sum(abs(c)) / 2 AS t FROM chg GROUP BY 1) ON day = date_idx),
gross AS (SELECT day, sum(weight * coalesce(ret, 0)) AS gross FROM wts LEFT JOIN ret ON day = date_idx AND wts.instrument = ret.instrument GROUP BY 1),
bench AS (SELECT date_idx, avg(ret) AS benchmark FROM ret GROUP BY 1),
bt AS (SELECT datetime, gross - turnover * ({COST} / 10000::DOUBLE) AS portfolio_return, gross - turnover * ({COST} / 10000::DOUBLE) - benchmark AS excess_return,
         turnover, benchmark FROM turn LEFT JOIN gross ON day = turn.date_idx LEFT JOIN bench ON bench.date_idx = turn.date_idx)"""
BT_COLUMNS = ("portfolio_return", "excess_return", "turnover", "benchmark")


def _backtest(spark, sf_dir):
    return book.topk_backtest(_returns(spark, sf_dir), _signals(spark, sf_dir), TOPK, COST)


@query("book_topk_backtest", f"WITH {BACKTEST} SELECT datetime, {', '.join(r(c, c) for c in BT_COLUMNS)} FROM bt")
def topk_backtest(spark, sf_dir):
    return rounded(_backtest(spark, sf_dir))


@query(
    "book_metrics",
    f"""WITH {BACKTEST},
    cum AS (SELECT datetime, product(1 + portfolio_return) OVER (ORDER BY datetime) AS c FROM bt WHERE portfolio_return IS NOT NULL),
    dd AS (SELECT min(d) AS max_drawdown FROM (SELECT c / max(c) OVER (ORDER BY datetime) - 1 AS d FROM cum))
    SELECT {r('pow(product(1 + portfolio_return), 252 / count(portfolio_return)::DOUBLE) - 1', 'ann_return', 4)}, {r('avg(excess_return) * 252', 'ann_excess_return')},
      {r('coalesce(avg(portfolio_return) / nullif(stddev_samp(portfolio_return), 0) * sqrt(252), 0)', 'sharpe')},
      {r('coalesce(avg(excess_return) / nullif(stddev_samp(excess_return), 0) * sqrt(252), 0)', 'excess_sharpe')},
      {r('avg(CASE WHEN portfolio_return > 0 THEN 1.0::DOUBLE WHEN portfolio_return IS NOT NULL THEN 0.0::DOUBLE END)', 'win_rate')},
      {r('avg(turnover)', 'avg_turnover')}, count(portfolio_return) AS n_periods, {r('(SELECT max_drawdown FROM dd)', 'max_drawdown')} FROM bt""",
)
def metrics(spark, sf_dir):
    return rounded(book.backtest_metrics(_backtest(spark, sf_dir)), ann_return=4)


# --- tear sheet: inputs ---------------------------------------------------------------


@query(
    "tearsheet_clean_factor",
    f"WITH {PANEL} SELECT datetime, instrument, {r('CASE WHEN instrument % 5 = 0 THEN KSFT ELSE KMID END', 'factor')} FROM panel WHERE instrument % 7 <> 0 AND amount <= 1000000",
)
def clean_factor(spark, sf_dir):
    """Repeated rows (the later revision wins), rows marked invalid, infinite values."""
    rows = panel(spark, sf_dir)
    infinite = F.when(F.col("amount") > 1000000, float("inf"))
    status = F.when(F.col("instrument") % 7 == 0, "invalid")
    first = rows.select("datetime", "instrument", F.coalesce(infinite, "KMID").alias("factor"), status.alias("quality_status"), F.lit(1).alias("revision"))
    second = rows.where(F.col("instrument") % 5 == 0).select(
        "datetime", "instrument", F.coalesce(infinite, "KSFT").alias("factor"), status.alias("quality_status"), F.lit(2).alias("revision")
    )
    return rounded(tearsheet.clean_factor(first.unionByName(second), order="revision"))


@query(
    "tearsheet_price_paths",
    f"""WITH {RETURNS}, g AS (SELECT instrument, datetime, ret, ret IS NULL OR (instrument + date_idx) % 11 = 0 AS gap FROM ret),
    u AS (SELECT *, sum(gap::INT) OVER (PARTITION BY instrument ORDER BY datetime) AS run FROM g),
    p AS (SELECT *, row_number() OVER (PARTITION BY instrument, run, gap ORDER BY datetime) AS k FROM u),
    q AS (SELECT *, CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 1 + ret END AS growth FROM p)
    SELECT instrument, datetime, {r('CASE WHEN NOT gap THEN product(growth) OVER (PARTITION BY instrument, run, gap ORDER BY datetime) END', 'price')} FROM q""",
)
def price_paths(spark, sf_dir):
    held = F.when((F.col("instrument") + F.col("date_idx")) % 11 != 0, "held")
    return rounded(tearsheet.price_paths(_returns(spark, sf_dir).withColumn("hold_contract", held), held="hold_contract"))


@query(
    "tearsheet_trimmed_factor",
    f"WITH {BASE} SELECT instrument, datetime, {r('KMID', 'factor')} FROM panel JOIN cal USING (datetime) WHERE date_idx <= (SELECT max(date_idx) FROM cal) - 10 AND instrument % 3 <> 0",
)
def trimmed_factor(spark, sf_dir):
    factor = panel(spark, sf_dir).select("instrument", "datetime", F.col("KMID").alias("factor"))
    priced = tables.prices(spark, sf_dir).where(F.col("instrument") % 3 != 0)
    return rounded(tearsheet.trim_to_horizon(factor, priced, 10))


PERIODS = (1, 5, 10)


def clean_sql(zscore: float = 3.0, binning: str = "quantile", group: bool = False, cumulative: bool = True) -> str:
    """CTEs up to ``clean`` with factor, quantile, group and forward returns."""

    def price_at(k: int) -> str:
        return f"max(price) OVER (PARTITION BY instrument ORDER BY date_idx RANGE BETWEEN {k} FOLLOWING AND {k} FOLLOWING)"

    forward = ", ".join(f"{price_at(p)} / {'price' if cumulative or p == 1 else price_at(p - 1)} - 1 AS ret_{p}" for p in PERIODS)
    kept = ", ".join(
        f"CASE WHEN NOT coalesce(abs(ret_{p} - avg(ret_{p}) OVER o) > {zscore}::DOUBLE * stddev_samp(ret_{p}) OVER o, false) THEN ret_{p} END AS ret_{p}"
        for p in PERIODS
    )
    known = " AND ".join(f"ret_{p} IS NOT NULL" for p in PERIODS)
    by = 'datetime, "group"' if group else "datetime"
    if binning == "quantile":
        bins = f"{quantile_bin_sql('factor', 'edges', 5)} + 1"
        edges = f"SELECT {by}, quantile_cont(factor, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS edges FROM rws GROUP BY {by}"
        binned = f"SELECT rws.*, ({bins})::BIGINT AS quantile FROM rws JOIN ({edges}) USING ({by})"
    elif binning == "width":
        binned = (
            "SELECT rws.*, (1 + (lo + (hi - lo) / 4 < factor)::INT + (lo + (hi - lo) / 4 * 2 < factor)::INT + (lo + (hi - lo) / 4 * 3 < factor)::INT)::BIGINT AS quantile "
            "FROM rws JOIN (SELECT datetime, min(factor) AS lo, max(factor) AS hi FROM rws GROUP BY 1) USING (datetime)"
        )
    else:
        binned = (
            f"SELECT r.*, ({quantile_bin_sql('factor', 'edges', 2)} + 1 + CASE WHEN r.factor >= 0 THEN 2 ELSE 0 END)::BIGINT AS quantile FROM rws r "
            "JOIN (SELECT datetime, factor >= 0 AS pos, quantile_cont(factor, [0.0, 0.5, 1.0]) AS edges FROM rws GROUP BY 1, 2) e ON r.datetime = e.datetime AND (r.factor >= 0) = e.pos"
        )
    return f"""{BASE},
fwd AS (SELECT instrument, datetime, {forward} FROM px),
fac AS (SELECT datetime, instrument, ROC5 AS factor FROM panel WHERE ROC5 IS NOT NULL),
dated AS (SELECT * FROM fwd SEMI JOIN fac USING (datetime)),
z AS (SELECT instrument, datetime, {kept} FROM dated WINDOW o AS (PARTITION BY instrument)),
rws AS (SELECT fac.datetime, fac.instrument, factor, ret_1, ret_5, ret_10, n_regionkey AS "group" FROM fac JOIN z USING (datetime, instrument)
  JOIN supplier ON s_suppkey = instrument JOIN nation ON s_nationkey = n_nationkey WHERE {known}),
clean AS ({binned})"""


def _factor(spark, sf_dir):
    rows = panel(spark, sf_dir).select("datetime", "instrument", F.col("ROC5").alias("factor"))
    return rows.where(F.col("factor").isNotNull())


def _clean(spark, sf_dir, **options):
    options = {"zscore": 3.0, "price": "price", "periods": PERIODS, **options}
    return tearsheet.clean_factor_data(_factor(spark, sf_dir), tables.prices(spark, sf_dir), **options)


_CLEAN_COLUMNS = f"datetime, instrument, {r('factor', 'factor')}, {r('ret_1', 'ret_1')}, {r('ret_5', 'ret_5')}, {r('ret_10', 'ret_10')}, quantile"


@query("tearsheet_clean_data", f"WITH {clean_sql()} SELECT {_CLEAN_COLUMNS} FROM clean")
def clean_data(spark, sf_dir):
    """Fails if more than four fifths of the factor rows are left out."""
    return rounded(_clean(spark, sf_dir, max_loss=0.8))


@query("tearsheet_clean_data_in_groups", f'WITH {clean_sql(group=True)} SELECT {_CLEAN_COLUMNS}, "group" FROM clean')
def clean_data_in_groups(spark, sf_dir):
    return rounded(_clean(spark, sf_dir, groups=tables.groups(spark, sf_dir), binning_by_group=True))


@query("tearsheet_clean_data_width_bins", f"WITH {clean_sql(binning='width', cumulative=False)} SELECT {_CLEAN_COLUMNS} FROM clean")
def clean_data_width(spark, sf_dir):
    return rounded(_clean(spark, sf_dir, quantiles=None, bins=4, cumulative_returns=False))


@query("tearsheet_clean_data_zero_aware", f"WITH {clean_sql(binning='zero')} SELECT {_CLEAN_COLUMNS} FROM clean")
def clean_data_zero_aware(spark, sf_dir):
    return rounded(_clean(spark, sf_dir, quantiles=4, zero_aware=True))


@query(
    "tearsheet_loss_ratio",
    f"WITH {clean_sql()} SELECT (SELECT count(*) FROM fac) AS n_factor, count(*) AS n_clean, {r('1 - count(*) / (SELECT count(*) FROM fac)::DOUBLE', 'loss')} FROM clean",
)
def loss_ratio(spark, sf_dir):
    return rounded(tearsheet.loss_ratio(_factor(spark, sf_dir), _clean(spark, sf_dir)))


# --- tear sheet: statistics -------------------------------------------------------------

_UNION = " UNION ALL ".join(
    f'SELECT datetime, instrument, factor, quantile, "group", {p}::BIGINT AS period, ret_{p} AS ret FROM clean' for p in PERIODS
)
LONG = f"{clean_sql()}, lp AS ({_UNION})"
IC = f"{LONG}, {rank_ic('ic0', 'lp', 'datetime, period', 'factor', 'ret')}, daily AS (SELECT * FROM ic0 WHERE ic IS NOT NULL)"


def _long(spark, sf_dir):
    return tearsheet.by_period(_clean(spark, sf_dir), PERIODS)


def _ics(spark, sf_dir):
    return tearsheet.information_coefficient(_long(spark, sf_dir))


@query("tearsheet_ic", f"WITH {IC} SELECT datetime, period, {r('ic', 'ic')} FROM daily")
def tearsheet_ic(spark, sf_dir):
    return rounded(_ics(spark, sf_dir))


@query(
    "tearsheet_ic_by_group",
    f"""WITH {LONG}, {rank_ic('ic0', 'lp', 'datetime, period, "group"', 'factor', 'ret')} SELECT datetime, period, "group", {r('ic', 'ic')} FROM ic0 WHERE ic IS NOT NULL""",
)
def tearsheet_ic_by_group(spark, sf_dir):
    grouped = tearsheet.by_period(_clean(spark, sf_dir, groups=tables.groups(spark, sf_dir)), PERIODS)
    return rounded(tearsheet.information_coefficient(grouped, ["group"]))


@query("tearsheet_ic_statistics", f"WITH {IC}, {summary_sql('daily', 's', 'period')} SELECT period, {SUMMARY_COLUMNS}, n_days FROM s")
def ic_statistics(spark, sf_dir):
    return rounded(tearsheet.ic_statistics(_ics(spark, sf_dir)))


@query(
    "tearsheet_ic_monthly",
    f"WITH {IC} SELECT period, CAST(date_trunc('quarter', datetime) AS DATE) AS starts, {r('avg(ic)', 'ic')} FROM daily GROUP BY 1, 2",
)
def tearsheet_ic_monthly(spark, sf_dir):
    renamed = _ics(spark, sf_dir).withColumnRenamed("period", "horizon")
    monthly = ic.monthly_ic(renamed, ["horizon"], "quarter")
    return rounded(monthly.withColumnRenamed("period", "starts").withColumnRenamed("horizon", "period"))


@query(
    "tearsheet_ic_rolling",
    f"""WITH {IC} SELECT period, datetime, {r('ic', 'ic')}, {r('CASE WHEN count(ic) OVER w >= 12 THEN avg(ic) OVER w END', 'rolling_ic')}, {r('sum(ic) OVER u', 'cumulative_ic')} FROM daily
    WINDOW w AS (PARTITION BY period ORDER BY datetime ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), u AS (PARTITION BY period ORDER BY datetime ROWS UNBOUNDED PRECEDING)""",
)
def tearsheet_ic_rolling(spark, sf_dir):
    return rounded(ic.rolling_ic(_ics(spark, sf_dir), 12, ["period"]))


DEMEANED = "dm AS (SELECT * REPLACE (ret - avg(ret) OVER (PARTITION BY datetime, period) AS ret) FROM lp)"
_MEANS = "avg(ret) AS mean_ret, CASE WHEN count(ret) > 1 THEN stddev_samp(ret) / sqrt(count(ret)) END AS std_error"
_MEAN_COLUMNS = f"{r('mean_ret', 'mean_ret')}, {r('std_error', 'std_error')}"


@query("tearsheet_mean_return", f"WITH {LONG}, m AS (SELECT quantile, period, {_MEANS} FROM lp GROUP BY 1, 2) SELECT quantile, period, {_MEAN_COLUMNS} FROM m")
def mean_return(spark, sf_dir):
    return rounded(tearsheet.mean_return_by_quantile(_long(spark, sf_dir), demeaned=False))


@query("tearsheet_mean_return_demeaned", f"WITH {LONG}, {DEMEANED}, m AS (SELECT quantile, period, {_MEANS} FROM dm GROUP BY 1, 2) SELECT quantile, period, {_MEAN_COLUMNS} FROM m")
def mean_return_demeaned(spark, sf_dir):
    return rounded(tearsheet.mean_return_by_quantile(_long(spark, sf_dir)))


BY_DATE = f"{LONG}, {DEMEANED}, m AS (SELECT quantile, period, datetime, {_MEANS} FROM dm GROUP BY 1, 2, 3)"


@query("tearsheet_mean_return_by_date", f"WITH {BY_DATE} SELECT quantile, period, datetime, {_MEAN_COLUMNS} FROM m")
def mean_return_by_date(spark, sf_dir):
    return rounded(tearsheet.mean_return_by_quantile(_long(spark, sf_dir), by_date=True))


@query(
    "tearsheet_quantile_spread",
    f"""WITH {BY_DATE}, sp AS (SELECT period, datetime, max(mean_ret) FILTER (quantile = 5) - max(mean_ret) FILTER (quantile = 1) AS spread,
      sqrt(pow(max(std_error) FILTER (quantile = 5), 2) + pow(max(std_error) FILTER (quantile = 1), 2)) AS std_error FROM m GROUP BY 1, 2)
    SELECT period, datetime, {r('spread', 'spread')}, {r('std_error', 'std_error')} FROM sp""",
)
def quantile_spread(spark, sf_dir):
    return rounded(tearsheet.quantile_spread(tearsheet.mean_return_by_quantile(_long(spark, sf_dir), by_date=True), 5))


FACTOR_RETURNS = """fr AS (SELECT datetime, period, sum(w * ret) / nullif(sum(abs(w)), 0) AS factor_return
  FROM (SELECT *, factor - avg(factor) OVER (PARTITION BY datetime, period) AS w FROM lp) GROUP BY 1, 2)"""


@query("tearsheet_factor_returns", f"WITH {LONG}, {FACTOR_RETURNS} SELECT datetime, period, {r('factor_return', 'factor_return')} FROM fr")
def factor_returns(spark, sf_dir):
    return rounded(tearsheet.factor_weighted_returns(_long(spark, sf_dir)))


def _turnover(period: int) -> None:
    @query(
        f"tearsheet_quantile_turnover_{period}",
        f"""WITH {clean_sql()}, ci AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS di FROM (SELECT DISTINCT datetime FROM clean)),
        x AS (SELECT datetime, di, quantile, max(quantile) OVER (PARTITION BY instrument ORDER BY di RANGE BETWEEN {period} PRECEDING AND {period} PRECEDING) AS was FROM clean JOIN ci USING (datetime))
        SELECT datetime, quantile, {r('avg(CASE WHEN was = quantile THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)', 'turnover')} FROM x WHERE di >= {period} GROUP BY 1, 2""",
    )
    def run(spark, sf_dir):
        return rounded(tearsheet.quantile_turnover(_clean(spark, sf_dir), period))


for _p in (1, 5):
    _turnover(_p)


@query(
    "tearsheet_rank_autocorrelation",
    f"""WITH {clean_sql()}, ci AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS di FROM (SELECT DISTINCT datetime FROM clean)),
    x AS (SELECT datetime, di, instrument, {average_rank('factor', 'datetime')} AS rk FROM clean JOIN ci USING (datetime)),
    y AS (SELECT datetime, di, rk, max(rk) OVER (PARTITION BY instrument ORDER BY di RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS was FROM x)
    SELECT datetime, {r(corr('rk', 'was'), 'autocorrelation')} FROM y WHERE di >= 1 GROUP BY 1""",
)
def rank_autocorrelation(spark, sf_dir):
    return rounded(tearsheet.rank_autocorrelation(_clean(spark, sf_dir)))


SERIES = f"""{LONG}, ser AS (SELECT datetime, period, 'Q' || quantile AS series, avg(ret) AS ret FROM lp GROUP BY 1, 2, 3
  UNION ALL SELECT datetime, period, 'EW', avg(ret) FROM lp GROUP BY 1, 2),
cum AS (SELECT *, product(1 + ret) OVER (PARTITION BY series, period ORDER BY datetime) AS cumulative FROM ser)"""


def _series(spark, sf_dir):
    return tearsheet.quantile_series(_long(spark, sf_dir))


@query(
    "tearsheet_cumulative_series",
    f"""WITH {SERIES} SELECT datetime, period, series, {r('ret', 'ret')}, {r('cumulative', 'cumulative')},
      {r('cumulative / max(cumulative) OVER (PARTITION BY series, period ORDER BY datetime) - 1', 'drawdown')} FROM cum""",
)
def cumulative_series(spark, sf_dir):
    return rounded(tearsheet.cumulative_series(_series(spark, sf_dir)))


@query(
    "tearsheet_long_short",
    f"""WITH {SERIES}, w AS (SELECT datetime, period, max(ret) FILTER (series = 'Q5') - max(ret) FILTER (series = 'Q1') AS spread,
      max(cumulative) FILTER (series = 'Q5') / max(cumulative) FILTER (series = 'Q1') AS curve_ratio FROM cum GROUP BY 1, 2)
    SELECT datetime, period, {r('spread', 'spread')}, {r('curve_ratio', 'curve_ratio')}, {r('product(1 + spread) OVER (PARTITION BY period ORDER BY datetime)', 'spread_cumulative')}
    FROM w WHERE spread IS NOT NULL""",
)
def long_short(spark, sf_dir):
    return rounded(tearsheet.long_short_series(_series(spark, sf_dir), 5))


def _compounded(unit: str) -> None:
    @query(
        f"tearsheet_returns_per_{unit}",
        f"""WITH {SERIES}, g AS (SELECT series, period, CAST(date_trunc('{unit}', datetime) AS DATE) AS starts, product(1 + ret) - 1 AS ret FROM ser GROUP BY 1, 2, 3),
        d AS (SELECT period, starts, max(ret) FILTER (series = 'Q5') - max(ret) FILTER (series = 'Q1') AS ret FROM g GROUP BY 1, 2)
        SELECT series, period, starts, {r('ret', 'ret')} FROM g UNION ALL SELECT 'LS', period, starts, {r('ret', 'ret')} FROM d WHERE ret IS NOT NULL""",
    )
    def run(spark, sf_dir):
        return rounded(tearsheet.compounded_returns(_series(spark, sf_dir), unit))


for _u in ("month", "year"):
    _compounded(_u)


_SUMMARY = ("ic_mean", "ic_ir", "t_stat", "win_rate", "win_rate_sym", "ic_gt_02", "monotonicity", "ls_ann_ret", "ls_sharpe", "net_ic")


@query(
    "tearsheet_summary",
    f"""WITH {IC}, {FACTOR_RETURNS},
    i AS (SELECT period, avg(ic) AS ic_mean, stddev_samp(ic) AS sd, count(ic) AS n_periods, avg(CASE WHEN abs(ic) > 0.02 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ic_gt_02,
            CASE WHEN avg(ic) >= 0 THEN 1 ELSE -1 END::BIGINT AS direction FROM daily GROUP BY 1),
    w AS (SELECT period, avg(CASE WHEN factor_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS up, avg(CASE WHEN factor_return < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS down FROM fr GROUP BY 1),
    qm AS (SELECT period, quantile, avg(ret) AS m FROM lp GROUP BY 1, 2), {rank_ic('mono', 'qm', 'period', 'quantile', 'm', 2, 'mono')},
    sp AS (SELECT datetime, period, avg(ret) FILTER (quantile = 5) - avg(ret) FILTER (quantile = 1) AS s FROM lp GROUP BY 1, 2),
    ls AS (SELECT period, avg(s) AS ls, stddev_samp(s) AS ls_sd FROM sp GROUP BY 1),
    t AS (SELECT i.period, direction, ic_mean, ic_mean * direction / sd AS ic_ir, ic_mean * direction / sd * sqrt(n_periods) AS t_stat,
      CASE WHEN direction = 1 THEN up ELSE down END AS win_rate, CASE WHEN direction = 1 THEN up ELSE down END AS win_rate_sym, ic_gt_02, n_periods, mono * direction AS monotonicity, ls * direction * 252 AS ls_ann_ret,
      CASE WHEN ls_sd > 0 THEN ls * direction / ls_sd * sqrt(252) ELSE 0 END AS ls_sharpe, ic_mean * direction AS net_ic
      FROM i JOIN w ON i.period = w.period JOIN mono ON mono.period = i.period JOIN ls ON ls.period = i.period)
    SELECT period, direction, n_periods, {', '.join(r(c, c) for c in _SUMMARY)},
      coalesce(abs(ic_ir) > 0.4 AND abs(ic_mean) > 0.02 AND monotonicity > 0.7 AND net_ic > 0.02 AND ls_sharpe > 1, false) AS viable FROM t""",
)
def tearsheet_summary(spark, sf_dir):
    long = _long(spark, sf_dir)
    ics = tearsheet.information_coefficient(long)
    return rounded(tearsheet.summary(long, ics, tearsheet.factor_weighted_returns(long), 5))


_BIN = quantile_bin_sql("abs(factor)", "edges", 5)


@query(
    "tearsheet_strength_bins",
    f"""WITH {clean_sql()}, e AS (SELECT datetime, quantile_cont(abs(factor), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS edges FROM clean GROUP BY 1),
    b AS (SELECT 'bin_' || ({_BIN} + 1) AS bin, factor, ret_1 AS ret FROM clean JOIN e USING (datetime) UNION ALL SELECT 'All', factor, ret_1 FROM clean),
    {rank_ic('ri', 'b', 'bin', 'factor', 'ret')},
    m AS (SELECT bin, {corr('factor', 'ret')} AS ic_p, avg(CASE WHEN -ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS win_pct, avg(-ret) * 10000 AS realized_bp,
      coalesce(sum(-ret) FILTER (-ret > 0), 0) / nullif(abs(sum(-ret) FILTER (-ret < 0)), 0) AS odds FROM b GROUP BY 1)
    SELECT m.bin, {r('ic_p', 'ic')}, {r('win_pct', 'win_pct')}, {r('realized_bp', 'realized_bp')}, {r('odds', 'odds')}, {r('ri.ic', 'rank_ic')} FROM m JOIN ri ON m.bin = ri.bin""",
)
def strength_bins(spark, sf_dir):
    return rounded(tearsheet.strength_bins(_clean(spark, sf_dir), "ret_1", -1, 5))
