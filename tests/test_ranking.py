"""The pairwise scorer against loops over all pairs."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest

from factorloom.operators import ranking

FEATURES = ["f0", "f1", "f2"]
SCHEMA = "datetime date, instrument string, f0 double, f1 double, f2 double, label double"


def _planted(dates=12, names=40, seed=3):
    """The order follows f0 less what all names of the date share; f1 follows it weakly, f2 is constant."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        order = rng.standard_normal(names)
        f0 = order + 6 * rng.standard_normal()
        f1 = order + 1.5 * rng.standard_normal(names)
        for i in range(names):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
            rows.append((day, f"S{i:03d}", float(f0[i]), float(f1[i]), 7.0, float(order[i] ** 3 + 5 * d)))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = _planted()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def _pair_gradient(rows, weights):
    """``rows``: (date, bin, vector)."""
    total = np.zeros(len(weights))
    for day in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == day]
        pairs = [(a, b) if a[1] > b[1] else (b, a) for a, b in combinations(mine, 2) if a[1] != b[1]]
        for better, worse in pairs:
            gap = np.subtract(better[2], worse[2])
            total -= max(0.0, 1 - weights @ gap) * gap / len(pairs)
    return total


def test_gradient_equals_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(dt.date(2024, 1, 1 + d), int(rng.integers(0, 5)), tuple(map(float, rng.standard_normal(3)))) for d in range(3) for _ in range(30)]
    df = spark.createDataFrame([(d, b, *x) for d, b, x in rows], "datetime date, _bin bigint, f0 double, f1 double, f2 double").repartition(3)
    for weights in (np.zeros(3), np.array([0.4, -1.0, 0.2]), np.array([3.0, 2.0, 0.0])):
        want = _pair_gradient(rows, weights)
        # Pairs within a cell of the margin may be judged either way.
        np.testing.assert_allclose(ranking.gradient(df, FEATURES, weights, 5), want, atol=2 / ranking.CELLS**2 + 1e-9)


def test_matrix_equals_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(dt.date(2024, 1, 1 + d), int(rng.integers(0, 4)), rng.standard_normal(3)) for d in range(3) for _ in range(20)]
    rows += [(dt.date(2024, 2, 1), 2, rng.standard_normal(3)) for _ in range(5)]  # one bin: no pairs
    want = np.zeros((3, 3))
    for day in {r[0] for r in rows}:
        gaps = [a[2] - b[2] for a, b in combinations([r for r in rows if r[0] == day], 2) if a[1] != b[1]]
        want += sum(np.outer(g, g) for g in gaps) / max(len(gaps), 1)
    df = spark.createDataFrame([(d, b, *map(float, x)) for d, b, x in rows], "datetime date, _bin bigint, f0 double, f1 double, f2 double")
    np.testing.assert_allclose(ranking._pairs_matrix(df.repartition(3), FEATURES), want, rtol=1e-9, atol=1e-9)


def _share(scores, rows):
    won = total = 0
    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] == rows[b][0] and rows[a][-1] != rows[b][-1]:
            total += 1
            won += (scores[a] > scores[b]) == (rows[a][-1] > rows[b][-1])
    return won / total


def test_planted_order_is_recovered_better_than_by_regression_on_bins(data):
    rows, df = data
    model = ranking.pairwise_scorer(df, FEATURES, "label", rounds=6)
    got = {(r.datetime, r.instrument): r.prediction for r in ranking.predict(model, df).collect()}
    x = np.array([r[2:4] for r in rows])
    bins = np.concatenate([np.argsort(np.argsort([r[-1] for r in rows if r[0] == day])) // 8 for day in sorted({r[0] for r in rows})])
    line = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), bins, rcond=None)[0]
    pairwise = _share([got[r[0], r[1]] for r in rows], rows)
    regression = _share(list(line[0] + x @ line[1:]), rows)
    assert pairwise > 0.97 and pairwise > regression + 0.1
    assert model.weights[2] == 0.0


def test_rounds_lead_to_the_minimum(data):
    rows, df = data
    model = ranking.pairwise_scorer(df, FEATURES, "label", ridge=0.01, rounds=25, tolerance=1e-6)
    labelled = []
    for day in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == day), key=lambda r: (r[-1], r[1]))
        edges = [max(-(-(i * 5) // (len(mine) - 1)) - 1, 0) for i in range(len(mine))]
        labelled += [(day, b, (np.array(r[2:5]) - model.means) / model.scales) for r, b in zip(mine, edges)]
    weights = np.array(model.weights)
    slopes = _pair_gradient(labelled, weights)[:2] + 0.01 * 12 * weights[:2]
    start = _pair_gradient(labelled, np.zeros(3))[:2]
    assert np.abs(slopes).max() < 0.01 * np.abs(start).max()


def test_concordance_counts_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(dt.date(2024, 1, 1 + d), float(rng.integers(0, 4)), float(rng.integers(0, 6))) for d in range(2) for _ in range(25)]
    rows += [(dt.date(2024, 2, 1), 1.0, 2.0), (dt.date(2024, 1, 1), None, 2.0), (dt.date(2024, 1, 1), 1.0, None)]
    df = spark.createDataFrame(rows, "datetime date, label double, prediction double")
    got = {r.datetime: (r.n_pairs, r.concordance) for r in ranking.concordance(df, "label").collect()}
    assert len(got) == 2
    for day, (n, share) in got.items():
        pairs = [(a, b) if a[1] > b[1] else (b, a) for a, b in combinations([r for r in rows if r[0] == day and None not in r], 2) if a[1] != b[1]]
        assert n == len(pairs)
        assert share == pytest.approx(np.mean([0.5 * (a[2] == b[2]) + (a[2] > b[2]) for a, b in pairs]))


def test_nothing_to_learn_gives_zero_weights(spark, data):
    _, df = data
    assert ranking.pairwise_scorer(df.where("label is null"), FEATURES, "label").weights == (0.0, 0.0, 0.0)
    thin = ranking.pairwise_scorer(df.where("instrument < 'S005'"), FEATURES, "label")
    assert thin.weights == (0.0, 0.0, 0.0)
    odd = spark.createDataFrame([(dt.date(2024, 1, 1), "A", None, float("nan"), float("inf"), 1.0)], SCHEMA)
    assert ranking.predict(thin, odd).first().prediction == 0.0
