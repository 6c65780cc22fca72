"""Models, walk-forward predictions and importances on a panel with one known driver."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import ic, models, splits

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    rows = []
    for d in range(30):
        x = rng.standard_normal((40, 3))
        y = 2 * x[:, 0] + 0.1 * rng.standard_normal(40)
        for i in range(40):
            f1 = None if (i + d) % 9 == 0 else float(x[i, 1])
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=d), f"S{i:02d}", float(x[i, 0]), f1, float(x[i, 2]), float(y[i])))
    return spark.createDataFrame(rows, "datetime date, instrument string, f0 double, f1 double, f2 double, label double").cache()


def _mean_ic(predictions, panel):
    joined = predictions.join(panel, ["datetime", "instrument"])
    return ic.rank_correlation(joined, ["datetime"], "prediction", "label").agg(F.avg("ic")).first()[0]


@pytest.mark.parametrize("name", list(models.MODELS))
def test_every_model_recovers_the_driver(panel, name):
    fitted = models.MODELS[name](panel, FEATURES, "label")
    assert _mean_ic(models.predict(fitted, panel, FEATURES), panel) > 0.7
    assert models.feature_importance(fitted, FEATURES, 3).first().feature == "f0"


def test_permutation_importance_finds_the_driver(panel):
    fitted = models.elastic_net(panel, FEATURES, "label")
    got = {r.feature: r.importance for r in models.permutation_importance(fitted, panel, FEATURES, "label", 2).collect()}
    assert set(got) == set(FEATURES)
    assert got["f0"] > 0.5 and abs(got["f1"]) < 0.1 and abs(got["f2"]) < 0.1


def test_feature_without_values_counts_as_zero(panel):
    empty = panel.withColumn("f2", F.lit(None).cast("double"))
    fitted = models.elastic_net(empty, FEATURES, "label")
    assert models.predict(fitted, empty, FEATURES).where("prediction is null").count() == 0


def test_walk_forward_predicts_later_dates_only(panel):
    windows = splits.walk_forward_windows(panel, "2024-01-01", 1, 1, 1, 1).where("oos_end is not null")
    # A short calendar counts 21 dates per month: no window fits, as in the definition.
    assert windows.count() == 0 or windows.agg(F.min(F.date_diff("oos_start", "train_end"))).first()[0] > 1
    rows = panel.crossJoin(windows.sparkSession.range(2).withColumnRenamed("id", "window_id")).withColumn(
        "role", F.when(F.col("datetime") < dt.date(2024, 1, 15), "train").otherwise("oos")
    )
    predictions = models.walk_forward(rows, FEATURES, "label", models.elastic_net)
    merged = splits.concatenated_signals(predictions)
    assert merged.count() == 16 * 40
    assert _mean_ic(merged, panel) > 0.7


def test_model_queries_score_every_labelled_row(spark, tmp_path):
    """Early and late dates alike, also where a bar has no price range and so no driver."""
    from factorloom.plans.catalog import QUERIES

    rng = np.random.default_rng(5)
    lines = []
    for s in range(6):
        for m in range(48):
            for i in range(3):
                # One name trades without prices in some months.
                price = None if s == 5 and m % 7 == 0 else float(rng.uniform(100, 900))
                lines.append((s * 1000 + m, i + 1, i, s, dt.date(1997 + m // 12, m % 12 + 1, 1 + i), 1.0, price))
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    from factorloom.plans.panel import panel as bars_panel

    expected = bars_panel(spark, str(tmp_path)).where("label_1d IS NOT NULL").select("datetime", "instrument")
    found = QUERIES["model_elastic_net"].run(spark, str(tmp_path))
    assert found.where("scored").select("datetime", "instrument").exceptAll(expected).isEmpty()
    assert found.count() == expected.count() > 200


def test_permutation_importance_scores_and_ranks_in_one_pass(panel, monkeypatch):
    """The label is ranked once and all features are scored together; rows without a label move values but do not count."""
    calls = []
    monkeypatch.setattr(models, "predict", lambda *a, f=models.predict: calls.append(a) or f(*a))
    fitted = models.elastic_net(panel, FEATURES, "label")
    some = panel.withColumn("label", F.when(F.col("instrument") != "S07", F.round("label")))
    got = {r.feature: r.importance for r in models.permutation_importance(fitted, some, FEATURES, "label", 2).collect()}
    assert len(calls) == 1

    def pooled(rows):
        scored = models.predict(fitted, rows, FEATURES, ("label",)).where("label IS NOT NULL").toPandas()
        return scored["prediction"].rank().corr(scored["label"].rank())

    base = pooled(some)
    for feature in FEATURES:
        moved = [models.shuffled_values(some, FEATURES, f"{models.SEED}/{i}").withColumn(feature, F.col(f"_s_{feature}")) for i in range(2)]
        assert got[feature] == pytest.approx(sum(base - pooled(m) for m in moved) / 2, abs=1e-12)


def _windowed(panel):
    two = panel.crossJoin(panel.sparkSession.range(2).withColumnRenamed("id", "window_id"))
    return two.withColumn("role", F.when(F.col("datetime") < F.date_add(F.lit("2024-01-10"), F.col("window_id").cast("int") * 5), "train").otherwise("oos"))


def test_lines_of_all_factors_meet_rows_that_do_not_move(panel):
    rows = _windowed(panel)
    found = models.single_factor_columns(rows, FEATURES, "label")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.toPandas()
    assert len(got) == (21 + 16) * 40
    data = rows.toPandas()
    for w in (0, 1):
        train = data[(data.window_id == w) & (data.role == "train") & data.f1.notna()]
        slope, start = np.polyfit(train.f1, train.label, 1)
        later = data[(data.window_id == w) & (data.role == "oos")].merge(got[got.window_id == w], on=["datetime", "instrument"], suffixes=("", "_p"))
        np.testing.assert_allclose(later.f1_p, start + slope * later.f1, atol=1e-9)
    long = models.single_factor_regressions(rows, FEATURES, "label")
    merged = splits.concatenated_signals(found, FEATURES).unpivot(["datetime", "instrument"], FEATURES, "model", "prediction")
    expected = splits.concatenated_signals(long, by=("model",)).select(*merged.columns)
    assert merged.exceptAll(expected).isEmpty() and merged.count() == expected.count() == 21 * 40 * 3


def test_wide_ranks_by_several_keys_equal_long_ones(panel):
    predictions = models.single_factor_columns(_windowed(panel), FEATURES, "label").persist()
    keys = ["role", "window_id", "datetime"]
    wide = {tuple(r)[:4]: (r.ic, r.n) for r in ic.column_rank_correlation(predictions, keys, FEATURES, "label", 5).collect()}
    long = predictions.unpivot([*keys, "instrument", "label"], FEATURES, "factor", "value")
    expected = {tuple(r)[:4]: (r.ic, r.n) for r in ic.rank_correlation(long, [*keys, "factor"], min_count=5).collect()}
    assert wide == expected and len(wide) == (21 + 16) * 3
