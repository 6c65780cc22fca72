"""Exact values and invariants on small hand-made tables."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.functions.bins import with_width_bin
from factorloom.functions.numeric import clip, correlation, finite, round_double
from factorloom.functions.rolling import Rolling
from factorloom.operators import (
    book, factors, history, ic, ingest, labels, pit, quality, rotation, screening, splits, tearsheet, xsection,
)

D = dt.date


def day(i):
    return D(2024, 1, 1) + dt.timedelta(days=i)


def _bars(spark, names=2, days=90, seed=42, gaps=False):
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(names):
        c = 100 * np.exp(np.cumsum(rng.standard_normal(days) * 0.02))
        for i in range(days):
            o = c[i] * (1 + rng.standard_normal() * 0.01)
            h, low = max(o, c[i]) * 1.01, min(o, c[i]) * 0.99
            close = None if gaps and i % 17 == 5 else float(c[i])
            rows.append((f"S{n}", day(i), float(o), float(h), float(low), close, float(rng.integers(100, 900)), float(rng.integers(10**4, 10**5))))
    return spark.createDataFrame(rows, "instrument string, datetime date, open double, high double, low double, close double, volume double, amount double")


# --- numeric --------------------------------------------------------------------------


def test_correlation_is_null_for_constant_and_ignores_incomplete_pairs(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 9.0), ("a", 3.0, 6.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.c for r in df.groupBy("g").agg(correlation(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got["a"] == pytest.approx(1.0) and got["c"] is None


def test_finite_and_clip(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (math.nan,), (None,)], "x double")
    assert [r.f for r in df.select(finite(F.col("x")).alias("f")).collect()] == [1.0, None, None, None]
    assert spark.range(1).select(clip(F.lit(5.0), F.lit(0.0), F.lit(1.0)).alias("c")).first().c == 1.0


# --- factors --------------------------------------------------------------------------


def test_factor_table_has_158_factors(spark):
    table = factors.factor_table(_bars(spark, days=65))
    names = [c for c in table.columns if c not in ("instrument", "datetime")]
    assert len(names) == len(set(names)) == 158
    assert names == factors.factor_names()


@pytest.mark.parametrize("gaps", [False, True])
def test_merged_windows_equal_sliding_windows(spark, gaps):
    """Statistics built from shorter windows against direct pandas rolling windows, with missing closes."""
    bars = _bars(spark, names=1, days=130, gaps=gaps)
    roll = Rolling(Window.partitionBy("instrument").orderBy("datetime"))
    wanted = {f"{k}{w}": getattr(roll, k)("close", w) for w in (5, 7, 10, 20, 30, 60) for k in ("mean", "std", "max", "min", "observed")}
    wanted |= {f"corr{w}": roll.correlation("close", "volume", w) for w in (5, 30, 60)}
    got = roll.add_to(bars).select("datetime", *[c.alias(n) for n, c in wanted.items()]).orderBy("datetime").toPandas()
    pdf = bars.orderBy("datetime").toPandas()
    for w in (5, 7, 10, 20, 30, 60):
        window = pdf["close"].rolling(w)
        for name, expected in (("mean", window.mean()), ("std", window.std()), ("max", window.max()), ("min", window.min())):
            np.testing.assert_allclose(got[f"{name}{w}"].astype(float), expected, rtol=1e-10)
        np.testing.assert_array_equal(got[f"observed{w}"], pdf["close"].rolling(w, min_periods=1).count())
    for w in (5, 30, 60):
        np.testing.assert_allclose(got[f"corr{w}"].astype(float), pdf["close"].rolling(w).corr(pdf["volume"]), rtol=1e-8)


def test_constant_prices_have_no_correlation(spark):
    rows = [("S", day(i), 10.1, 10.1, 10.1, 10.1, float(100 + i * i), 1.0) for i in range(70)]
    bars = spark.createDataFrame(rows, "instrument string, datetime date, open double, high double, low double, close double, volume double, amount double")
    last = factors.rolling_factors(bars).orderBy(F.desc("datetime")).first()
    assert last.CORR60 is None and last.RSQR60 is None and last.RESI60 is None
    assert last.STD60 == 0.0 and last.RANK60 == 1.0


def test_blocks_equal_unsplit_windows(spark):
    """One instrument with a long history, cut into blocks, against one window."""
    bars = _bars(spark, names=2, days=200, gaps=True)
    whole = factors.rolling_factors(bars)
    parts = factors.factor_table_in_blocks(bars, F.trunc("datetime", "month"), 64)
    a = whole.orderBy("instrument", "datetime").toPandas()
    b = parts.orderBy("instrument", "datetime").toPandas()
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_block_copies_cover_frames_on_both_sides(spark):
    df = spark.range(100).select(F.lit("S").alias("instrument"), F.col("id").alias("t"))
    blocks = history.overlapping_blocks(df, 10, before=3, after=2)
    spec = history.block_window()
    summed = blocks.withColumn("s", F.sum("t").over(spec.rowsBetween(-3, 2)))
    got = {r.t: r.s for r in history.own_rows(summed).collect()}
    assert got == {t: sum(x for x in range(t - 3, t + 3) if 0 <= x < 100) for t in range(100)}


# --- labels ---------------------------------------------------------------------------


def test_forward_return_values(spark):
    prices = spark.createDataFrame([("A", day(0), 100.0), ("A", day(1), 105.0), ("A", day(2), 110.0)], "instrument string, datetime date, close double")
    got = [r.label_1d for r in labels.forward_returns(prices, (1,)).orderBy("datetime").collect()]
    assert got[0] == pytest.approx(0.05) and got[1] == pytest.approx(110 / 105 - 1) and got[2] is None


def test_rank_label_is_qcut_of_first_ranks(spark):
    """Half of the labels are tied at zero, as for suspended names."""
    rng = np.random.default_rng(3)
    y = np.where(rng.random(57) < 0.5, 0.0, rng.standard_normal(57))
    rows = [(f"S{i:03d}", day(0), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "instrument string, datetime date, label double")
    got = labels.rank_label(df, "label", 5).orderBy("instrument").toPandas()["rank_label"]
    expected = pd.qcut(pd.Series(y).rank(method="first"), 5, labels=False)
    np.testing.assert_array_equal(got, expected)


def test_binary_label_thin_date_is_null_and_bottom_wins_ties(spark):
    rows = [(f"S{i}", day(0), 1.0) for i in range(40)] + [(f"S{i}", day(1), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "instrument string, datetime date, label double")
    got = labels.binary_label(df, "label").toPandas()
    assert (got[got.datetime == day(0)].binary_label == 0).all() and got[got.datetime == day(0)].is_extreme.all()
    assert got[got.datetime == day(1)].binary_label.isna().all() and not got[got.datetime == day(1)].is_extreme.any()


# --- cross-section --------------------------------------------------------------------


def test_preprocess_range(spark):
    rng = np.random.default_rng(5)
    rows = [(day(d), f"S{i}", float(v)) for d in range(5) for i, v in enumerate(rng.standard_normal(20))]
    panel = spark.createDataFrame(rows, "datetime date, instrument string, f double")
    out = xsection.preprocess(xsection.to_long(panel, ["f"])).toPandas()["value"]
    assert out.between(-1, 1).all() and out.max() == 1.0


# --- screening ------------------------------------------------------------------------


def test_quality_reports_constant_but_drops_only_low_coverage(spark):
    rows = [(day(0), f"S{i}", 1.0, None if i % 2 else float(i), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, same double, sparse double, good double")
    got = {r.factor: r for r in screening.factor_quality(df, ["same", "sparse", "good"], 0.6).collect()}
    assert got["same"].reason == "hardly varies" and not got["same"].dropped
    assert got["sparse"].dropped and got["sparse"].coverage == 0.5 and not got["good"].dropped


# --- ingest ---------------------------------------------------------------------------


def test_as_of_join_contract(spark):
    spine = spark.createDataFrame([("A", D(2020, 1, i), float(i)) for i in range(1, 6)], "symbol string, date date, close double")
    reports = spark.createDataFrame([("A", D(2020, 1, 3), 1000.0)], "symbol string, pub_date date, net_profit double")
    got = [r.net_profit for r in pit.as_of_join(spine, reports).orderBy("date").collect()]
    assert got == [None, None, 1000.0, 1000.0, 1000.0]


def test_as_of_join_across_periods_and_ties(spark):
    """A hot symbol, sparse publications years apart, and two reports on one day, against merge_asof."""
    rng = np.random.default_rng(2)
    spine = pd.DataFrame([(s, D(2015, 1, 1) + dt.timedelta(days=int(x))) for s, n in (("hot", 400), ("b", 60)) for x in sorted(rng.choice(3000, n, replace=False))], columns=["symbol", "date"])
    pubs = pd.DataFrame([(s, D(2014, 6, 1) + dt.timedelta(days=int(x)), D(2014, 3, 31) + dt.timedelta(days=int(x) + k), float(x + k)) for s in ("hot", "b") for x in rng.choice(2500, 6, replace=False) for k in (0, 1)], columns=["symbol", "pub_date", "rpt_date", "v"])
    got = pit.as_of_join(spark.createDataFrame(spine), spark.createDataFrame(pubs)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    latest = pubs.sort_values(["pub_date", "rpt_date"]).drop_duplicates(["symbol", "pub_date"], keep="last")
    left = spine.assign(date=pd.to_datetime(spine.date)).sort_values("date")
    right = latest.assign(pub_date=pd.to_datetime(latest.pub_date)).sort_values("pub_date")
    expected = pd.merge_asof(left, right, left_on="date", right_on="pub_date", by="symbol").sort_values(["symbol", "date"])
    np.testing.assert_array_equal(got["v"].astype(float), expected["v"].to_numpy())


def test_bounded_fill_equals_pandas(spark):
    values = [1.0, None, None, None, None, 2.0, None, None]
    df = spark.createDataFrame([("A", day(i), v) for i, v in enumerate(values)], "instrument string, datetime date, x double")
    got = ingest.forward_fill(df, ["x"], limit=3).orderBy("datetime").toPandas()["x"].astype(float)
    np.testing.assert_array_equal(got, pd.Series(values, dtype=float).ffill(limit=3))


def test_append_keeps_stored_rows(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert {(r.k, r.v) for r in ingest.append_new(old, new, ["k"]).collect()} == {(1, "old"), (2, "old"), (3, "new")}


def test_missing_percent(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    row = quality.missing_percent(df, ["x", "absent"]).first()
    assert row.x_missing_pct == 33.33 and row.absent_missing_pct == 100.0
    assert quality.missing_percent(df.where("false"), ["x"]).first().x_missing_pct == 0.0


# --- book -----------------------------------------------------------------------------


def _wide(spark, name, wide):
    rows = [(day(i), int(c), None if np.isnan(v) else float(v)) for i, r in enumerate(wide) for c, v in enumerate(r)]
    return spark.createDataFrame(rows, f"datetime date, instrument int, {name} double")


def test_backtest_equals_matrices(spark):
    """Weights as a matrix over dates and names; turnover is the difference along the dates."""
    rng = np.random.default_rng(42)
    ret, sig = rng.standard_normal((30, 20)) * 0.02, rng.standard_normal((30, 20))
    sig[rng.random((30, 20)) < 0.1] = np.nan
    sig[7, 4:] = np.nan
    ret[rng.random((30, 20)) < 0.05] = np.nan
    order = np.argsort(np.argsort(-np.nan_to_num(sig, nan=-np.inf), axis=1, kind="stable"), axis=1, kind="stable")
    book_days = (~np.isnan(sig)).sum(axis=1) >= 5
    chosen = (order < 5) & book_days[:, None]
    weights = np.vstack([np.zeros(20), chosen[:-1] * 0.2])
    turnover = np.abs(np.diff(np.vstack([np.zeros(20), weights]), axis=0)).sum(axis=1) / 2
    held = weights.sum(axis=1) > 0
    net = np.where(held, (weights * np.nan_to_num(ret)).sum(axis=1) - turnover * 10 / 10000, np.nan)
    returns, signals = _wide(spark, "ret", ret), _wide(spark, "signal", sig)
    got = book.topk_backtest(returns, signals, 5, 10).orderBy("datetime").toPandas()
    np.testing.assert_allclose(got.turnover, turnover, atol=1e-12)
    np.testing.assert_allclose(got.portfolio_return.astype(float), net, atol=1e-12)
    np.testing.assert_allclose(got.excess_return.astype(float), net - np.nanmean(ret, axis=1), atol=1e-12)
    metrics = book.backtest_metrics(book.topk_backtest(returns, signals, 5, 10)).first()
    port = got.portfolio_return.astype(float).dropna()
    curve = (1 + port).cumprod()
    assert metrics.max_drawdown == pytest.approx((curve / curve.cummax() - 1).min())
    assert metrics.ann_return == pytest.approx((1 + port).prod() ** (252 / len(port)) - 1)


def test_backtest_of_several_series_equals_each_alone(spark):
    rng = np.random.default_rng(3)
    returns = _wide(spark, "ret", rng.standard_normal((12, 9)))
    series = {name: _wide(spark, "signal", rng.standard_normal((12, 9))) for name in ("a", "b")}
    both = series["a"].withColumn("model", F.lit("a")).unionByName(series["b"].where("datetime > '2024-01-04'").withColumn("model", F.lit("b")))
    got = book.topk_backtest(returns, both, 3, 10, by=("model",))
    for name, alone in (("a", series["a"]), ("b", series["b"].where("datetime > '2024-01-04'"))):
        expected = book.topk_backtest(returns, alone, 3, 10).orderBy("datetime").toPandas()
        pd.testing.assert_frame_equal(got.where(F.col("model") == name).drop("model").orderBy("datetime").toPandas(), expected)


# --- tear sheet -----------------------------------------------------------------------


def test_price_path_restarts_after_a_gap(spark):
    rows = [("A", day(i), r) for i, r in enumerate([0.1, 0.2, None, 0.5, 0.1])]
    df = spark.createDataFrame(rows, "instrument string, datetime date, ret double")
    got = [r.price for r in tearsheet.price_paths(df).orderBy("datetime").collect()]
    assert got[2] is None
    assert [x for x in got if x is not None] == pytest.approx([1.0, 1.2, 1.0, 1.1])


def test_max_loss_is_part_of_the_query(spark):
    rows = [(day(d), f"S{i}", float(i + d), 10.0 + i + d) for d in range(12) for i in range(6)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, factor double, close double")
    factor, prices = df.select("datetime", "instrument", "factor"), df.select("datetime", "instrument", "close")
    assert tearsheet.clean_factor_data(factor, prices, (1, 5), 2, max_loss=0.5).count() == 42
    with pytest.raises(Exception, match="left out"):
        tearsheet.clean_factor_data(factor, prices, (1, 5), 2, max_loss=0.35).collect()


def test_one_bin_of_equal_width(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None)], "g int, v double")
    got = with_width_bin(df, ["g"], "v", 1, "b").collect()
    assert sorted((r.g, r.b) for r in got if r.v is not None) == [(1, 0), (1, 0)] and [r.b for r in got if r.v is None] == [None]


def test_max_loss_guard(spark):
    factor = spark.range(10).select(F.lit(day(0)).alias("datetime"), F.col("id").alias("instrument"))
    tearsheet.check_max_loss(factor, factor.where("instrument < 8"))
    with pytest.raises(ValueError):
        tearsheet.check_max_loss(factor, factor.where("instrument < 5"))


# --- rotation -------------------------------------------------------------------------


def test_capped_allocation_respects_caps(spark):
    scores = {"A": 5.0, "B": 4.0, "E1": 3.0, "E2": 2.0, "Z": -1.0}
    rows = [(day(0), k, v) for k, v in scores.items()] + [(day(1), k, -v if k != "Z" else v) for k, v in scores.items()]
    df = spark.createDataFrame(rows, "datetime date, instrument string, score double")
    got = rotation.capped_allocation(df, ["E1", "E2"], ["Q", "Z"]).toPandas()
    first = got[got.datetime == day(0)].set_index("instrument").weight
    assert first.sum() == pytest.approx(1.0) and first.max() <= 0.4 and first[["E1", "E2"]].sum() <= 0.31
    assert set(first.index) == {"A", "B", "E1", "E2"}
    second = got[got.datetime == day(1)]
    assert list(second.instrument) == ["Z"] and list(second.weight) == [1.0]


@pytest.mark.parametrize("seed", range(8))
def test_capped_allocation_is_proportional_below_the_caps(spark, seed):
    """Optimality of the filling: below its cap every name of a part has the same weight per score, and caps hold."""
    rng = np.random.default_rng(seed)
    scores = dict(zip("ABCDEF", (float(x) for x in rng.random(6) ** 3)))
    df = spark.createDataFrame([(day(0), k, v) for k, v in scores.items()], "datetime date, instrument string, score double")
    got = rotation.capped_allocation(df, ["A", "B"], top_n=6, single_cap=0.3, group_cap=0.25).toPandas().set_index("instrument").weight
    assert got.sum() == pytest.approx(1.0) and got.max() <= 0.3 + 1e-6 and got[["A", "B"]].sum() <= 0.25 + 1e-6
    for part in (["A", "B"], ["C", "D", "E", "F"]):
        free = [k for k in part if got[k] < 0.3 - 1e-6]
        assert np.ptp([got[k] / scores[k] for k in free]) < 1e-3 * max(got[k] / scores[k] for k in free) if free else True
        held = [k for k in part if k not in free]
        assert all(scores[h] >= scores[k] for h in held for k in free)


# --- splits ---------------------------------------------------------------------------


def test_purged_split_ends_early(spark):
    panel = spark.createDataFrame([(day(i), "A") for i in range(20)], "datetime date, instrument string")
    got = {r.split: r for r in splits.static_splits(panel, 5, ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-15"), ("2024-01-16", None)).collect()}
    assert got["train"].end == D(2024, 1, 5) and got["val"].end == D(2024, 1, 10) and got["test"].end is None


def test_rank_ic_of_a_monotone_factor_is_one(spark):
    rows = [(day(d), f"S{i}", "f", float(i), float(i**3)) for d in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, factor string, value double, label double")
    assert [r.ic for r in ic.daily_rank_ic(df).collect()] == pytest.approx([1.0] * 3)
    assert ic.daily_rank_ic(df, min_names=7).count() == 0


def test_winsorise_and_impute_in_one_step_equals_two_steps(spark):
    rng = np.random.default_rng(9)
    rows = [(day(n), f"S{i}", "f", None if i == n else float(v)) for n in (1, 2, 3, 4, 40) for i, v in enumerate(rng.standard_normal(n + 1))]
    long = spark.createDataFrame(rows, "datetime date, instrument string, factor string, value double")
    for edges in ((0.01, 0.99), (0.2, 0.7), (0.45, 0.55)):
        once = xsection.winsorise_and_impute(long, *edges).orderBy("datetime", "instrument").toPandas()["value"]
        twice = xsection.impute_median(xsection.winsorise(long, *edges)).orderBy("datetime", "instrument").toPandas()["value"]
        np.testing.assert_allclose(once, twice, rtol=1e-12)


# --- rounding and window lists ---------------------------------------------------------


@pytest.mark.parametrize("digits", [0, 2, 6])
def test_round_double_equals_round(spark, digits):
    """Ties, neighbours of ties, signed zeros, large numbers and missing values get the value that ``F.round`` gives."""
    ties = [(k + 0.5) / 10**digits for k in (0, 1, 2, 7, 1004, 10**9 + 1)] + [1.005, 2.675, 0.285, 1.0000005]
    near = [np.nextafter(x, to) for x in ties for to in (-np.inf, np.inf)]
    other = [0.0, -1e-9, 1 / 3, 2.0**40 / 10**digits, 1e15 + 0.5, 1e300, float("nan"), float("inf")]
    rows = [(float(sign * x),) for x in [*ties, *near, *other] for sign in (1, -1)] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    both = df.select(F.round("x", digits).cast("string").alias("a"), round_double(F.col("x"), digits).cast("string").alias("b")).collect()
    assert [r.b for r in both] == [r.a for r in both]


def test_window_lists_are_collected_in_the_last_window(spark):
    """The windows before would copy the lists with every row."""
    table = factors.rolling_factors(_bars(spark, days=5), [factors.extreme_age, factors.trend])
    steps = [line for line in table._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert len(steps) > 2
    assert ["collect_list" in step for step in steps] == [True] + [False] * (len(steps) - 1)
