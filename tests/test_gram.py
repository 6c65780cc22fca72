"""Linear models of all windows from moment matrices, against fits on the rows themselves."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from factorloom.operators import gram

FEATURES = [f"f{i}" for i in range(6)]
DAY = dt.date(2024, 1, 1)
MODELS = {"line": (0.0, 0.0), "ridge": (0.05, 0.0), "net": (0.05, 0.4), "lasso": (0.02, 1.0)}


def _day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(40):
        x = rng.standard_normal((30, 6)) * [1, 5, 0.1, 1, 1, 0] + [0, 3, 0, 0, 0, 7]
        x[:, 3] = x[:, 0] + 0.05 * x[:, 3]
        y = x[:, 0] - 0.3 * x[:, 1] + 0.2 * d + 0.3 * rng.standard_normal(30)
        for i in range(30):
            values = [float(v) for v in x[i]]
            values[4] = None if (i + d) % 7 == 0 else float("nan") if (i + d) % 11 == 0 else values[4]
            rows.append((_day(d), f"S{i}", *values, None if i == 5 else float(y[i])))
    df = spark.createDataFrame(rows, "datetime date, instrument string, " + ", ".join(f"{f} double" for f in FEATURES) + ", label double")
    edges = [(0, 0, 14, 16, 19, 20, 25), (1, 0, 20, 22, 25, 26, 31), (2, 10, 26, 28, 31, 32, 39)]
    columns = ("train_start", "train_end", "val_start", "val_end", "oos_start", "oos_end")
    windows = spark.createDataFrame([(w, *map(_day, e)) for w, *e in edges], "window_id long, " + ", ".join(f"{c} date" for c in columns))
    return rows, df.repartition(5), windows


def _train(rows, window):
    start, end = ((0, 14), (0, 20), (10, 26))[window]
    used = [r for r in rows if _day(start) <= r[0] <= _day(end) and r[-1] is not None]
    x = np.array([[0.0 if v is None or np.isnan(v) else v for v in r[2:-1]] for r in used])
    return x, np.array([r[-1] for r in used])


@pytest.fixture(scope="module")
def fitted(data):
    _, df, windows = data
    found = gram.window_models(df, gram.window_days(windows), FEATURES, "label", MODELS).collect()
    return {(r.window_id, r.model): (r.n, np.array(r.weights)) for r in found}


def test_least_squares_of_every_window(data, fitted):
    for w in range(3):
        x, y = _train(data[0], w)
        want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x - x.mean(0)]), y, rcond=None)[0]
        n, weights = fitted[w, "line"]
        assert n == len(y)
        np.testing.assert_allclose(weights[1:6], want[1:6], rtol=1e-6, atol=1e-8)
        assert weights[6] == 0.0  # a constant feature
        np.testing.assert_allclose(weights[0] + x.mean(0) @ weights[1:], y.mean(), rtol=1e-9)


@pytest.mark.parametrize("name", list(MODELS))
def test_models_equal_fits_on_the_rows(spark, data, fitted, name):
    """Standardised features and a label of unit spread, because MLlib divides its squared penalty by that spread."""
    alpha, l1 = MODELS[name]
    for w in range(3):
        x, y = _train(data[0], w)
        scale = np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1)
        z = (x - x.mean(0)) / scale
        rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(z, y / y.std(ddof=1))], ", ".join(f"{f} double" for f in FEATURES) + ", y double")
        rows = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(rows)
        sparse, square = alpha * l1 / y.std(ddof=1), alpha * (1 - l1)
        share = sparse / (sparse + square) if alpha else 0.0
        learner = LinearRegression(
            featuresCol="v", labelCol="y", regParam=sparse + square, elasticNetParam=share, standardization=False, maxIter=1000, tol=1e-12
        )
        want = learner.fit(rows).coefficients.toArray() / scale * y.std(ddof=1)
        np.testing.assert_allclose(fitted[w, name][1][1:], want, rtol=1e-3, atol=2e-4)


def test_predictions_cover_the_later_ranges_of_every_window(data, fitted):
    rows, df, windows = data
    found = gram.walk_forward(df, windows, FEATURES, "label", MODELS).collect()
    ranges = {0: ((16, 19), (20, 25)), 1: ((22, 25), (26, 31)), 2: ((28, 31), (32, 39))}
    want = {}
    for w, (val, oos) in ranges.items():
        for role, (first, last) in (("val", val), ("oos", oos)):
            for r in rows:
                if _day(first) <= r[0] <= _day(last):
                    x = np.array([0.0 if v is None or np.isnan(v) else v for v in r[2:-1]])
                    for m in MODELS:
                        weights = fitted[w, m][1]
                        want[m, w, role, r[0], r[1]] = weights[0] + weights[1:] @ x
    got = {(r.model, r.window_id, r.role, r.datetime, r.instrument): r.prediction for r in found}
    assert len(found) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_many_correlated_features_reach_the_minimum():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 20)) @ rng.standard_normal((20, 120)) + 0.01 * rng.standard_normal((500, 120))
    y = x[:, 3] - x[:, 50] + rng.standard_normal(500)
    table = np.column_stack([np.ones(500), x, y])
    weights = gram.elastic_net_from_moments(table.T @ table, 0.05, 0.5)
    scale = x.std(0, ddof=1)
    z, b = (x - x.mean(0)) / scale, weights[1:] * scale
    slopes = z.T @ (y - y.mean() - z @ b) / 500 - 0.025 * b
    assert np.all(np.abs(slopes) <= 0.025 * (1 + 1e-4))
    np.testing.assert_allclose(slopes[b != 0], 0.025 * np.sign(b[b != 0]), rtol=1e-4)


def test_windows_without_rows_have_no_model(spark, data):
    _, df, windows = data
    assert gram.walk_forward(df.where("datetime > '2025-01-01'"), windows, FEATURES, "label", MODELS).count() == 0
    late = windows.select("window_id", *[(F.col(c) + F.expr("interval 1 year")).cast("date").alias(c) for c in windows.columns[1:]])
    assert gram.window_models(df, gram.window_days(late), FEATURES, "label", MODELS).count() == 0
