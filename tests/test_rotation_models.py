"""A model per rebalance date, against fits on each window's own rows."""

import datetime as dt

import numpy as np
import pytest

from factorloom.operators import rotation

FEATURES = ["a", "b", "c", "shared"]
WINDOW, PURGE = 20, 4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows, day = [], dt.date(2024, 1, 1)
    days = []
    while len(days) < 90:
        if day.weekday() < 5:
            days.append(day)
        day += dt.timedelta(days=1)
    for i, day in enumerate(days):
        shared = float(rng.standard_normal())
        for k in range(9):
            x = rng.standard_normal(3)
            label = float(x[0] - x[1] * (1 if i < 45 else -1) + 0.2 * rng.standard_normal())
            a = None if (i + k) % 13 == 0 else float(x[0])
            b = float("nan") if (i + k) % 17 == 0 else float(x[1])
            rows.append((f"E{k}", day, a, b, float(x[2]), shared, None if i > 85 else label))
    df = spark.createDataFrame(rows, "instrument string, datetime date, a double, b double, c double, shared double, label double")
    return days, rows, df.repartition(4)


def _bins(values):
    edges = sorted(set(np.quantile(values, [0, 0.2, 0.4, 0.6, 0.8, 1.0])))
    return [max(sum(e < v for e in edges) - 1, 0) for v in values]


def test_scores_of_every_rebalance_date(data):
    days, rows, df = data
    windows = rotation.training_windows(df, WINDOW, PURGE)
    got = {(r.datetime, r.instrument): r.score for r in rotation.trained_scores(df, windows, FEATURES, "label", alpha=0.0).collect()}
    ends = [d for i, d in enumerate(days) if (i + 1 == len(days) or days[i + 1].month != d.month) and i > WINDOW + PURGE]
    complete = [r for r in rows if r[2] is not None and not np.isnan(r[3])]
    want = {}
    for end in ends:
        at = days.index(end)
        x, y = [], []
        for day in days[at - WINDOW : at - PURGE + 1]:
            mine = [r for r in complete if r[1] == day and r[-1] is not None]
            x += [r[2:6] for r in mine]
            y += _bins([r[-1] for r in mine])
        x = np.array(x)
        line = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), np.array(y, float), rcond=None)[0]
        for r in rows:
            if r[1] == end:
                want[end, r[0]] = line[0] + line[1:] @ np.array(r[2:6]) if r in complete else rotation.MISSING_SCORE
    assert len(ends) >= 3 and got.keys() == want.keys()
    assert rotation.MISSING_SCORE in want.values()
    assert all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-7) for k in want)


def test_later_labels_are_not_seen(data):
    """Labels after the purge, and those of the rebalance date itself, change nothing."""
    days, _, df = data
    windows = rotation.training_windows(df, WINDOW, PURGE).orderBy("window_id").limit(1)
    end = windows.first()
    known = rotation.trained_scores(df, windows, FEATURES, "label").collect()
    blind = df.selectExpr("* EXCEPT (label)", f"IF(datetime > DATE '{end.train_end}', 99.0, label) AS label")
    assert sorted(map(tuple, known)) == sorted(map(tuple, rotation.trained_scores(blind, windows, FEATURES, "label").collect()))


def test_nothing_to_train_on_gives_no_scores(data):
    _, _, df = data
    windows = rotation.training_windows(df, WINDOW, PURGE)
    assert rotation.trained_scores(df.selectExpr("* EXCEPT (label)", "CAST(NULL AS DOUBLE) AS label"), windows, FEATURES, "label").count() == 0
    assert rotation.trained_scores(df, rotation.training_windows(df, 500, PURGE), FEATURES, "label").count() == 0
