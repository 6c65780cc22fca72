"""Running values from block summaries against unsplit computation, on a hot key with empty blocks and nulls."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import scans

ROWS = [("hot", 600), ("b", 40), (None, 25), ("empty", 30), ("one", 1)]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    parts = []
    for key, n in ROWS:
        x = rng.standard_normal(n) * 10.0 ** rng.integers(-2, 3, n)
        x[rng.random(n) < 0.4] = np.nan
        if key == "hot":
            x[100:230] = np.nan
            x[:7] = np.nan
        if key == "empty":
            x[:] = np.nan
        parts.append(pd.DataFrame({"k": key, "t": range(n), "x": x}))
    pdf = pd.concat(parts, ignore_index=True)
    rows = [(None if pd.isna(k) else k, int(t), None if np.isnan(x) else float(x)) for k, t, x in pdf.itertuples(index=False)]
    return rows, spark.createDataFrame(rows, "k string, t long, x double").repartition(5)


def expected(rows):
    """Per (key, t): fill, maximum, count, previous value, product of 1 + x / 1e4."""
    out, state = {}, {}
    for k, t, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        fill, most, known, last, grown = state.get(k, (None, None, 0, None, None))
        out[k, t] = [x if x is not None else fill, None, known + (x is not None), last, None]
        if x is not None:
            most = x if most is None else max(most, x)
            grown = (1.0 if grown is None else grown) * (1 + x / 1e4)
        out[k, t][1], out[k, t][4] = most, grown
        state[k] = (out[k, t][0], most, out[k, t][2], x, grown)
    return out


@pytest.mark.parametrize("block", [1, 16, 50, 1000])
def test_running_values(frame, block):
    rows, df = frame
    wanted = {
        "fill": scans.last_known("x", "t"),
        "most": scans.maximum(F.col("x")),
        "known": scans.total(F.when(F.col("x").isNotNull(), 1).otherwise(0)),
        "last": scans.previous(F.col("x"), "t"),
        "grown": scans.product(1 + F.col("x") / 1e4),
    }
    found = scans.running(df, wanted, ["k"], "t", F.floor(F.col("t") / block)).collect()
    want = expected(rows)
    assert len(found) == len(rows)
    for r in found:
        fill, most, known, last, grown = want[r.k, r.t]
        assert (r.fill, r.most, r.known, r.last) == (fill, most, known, last)
        assert r.grown is None if grown is None else r.grown == pytest.approx(grown, rel=1e-12)


def test_a_running_value_may_replace_its_column(frame):
    rows, df = frame
    found = scans.running(df, {"x": scans.last_known("x", "t")}, ["k"], "t", F.floor(F.col("t") / 9))
    assert found.columns == df.columns
    want = expected(rows)
    assert all(r.x == want[r.k, r.t][0] for r in found.collect())


@pytest.mark.parametrize("scale", [500.0, 60.0, 6.0, 1.5])
def test_decayed_means_of_whole_histories(frame, monkeypatch, scale):
    monkeypatch.setattr(scans, "SCALE", scale)
    rows, df = frame
    found = {(r.k, r.t): r for r in scans.decayed_means(df, {"a": ("x", 5), "b": ("x", 40)}, ["k"]).collect()}
    assert len(found) == len(rows)
    state = {}
    for k, t, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        for name, span in (("a", 5), ("b", 40)):
            keep = 1 - 2 / (span + 1)
            num, den = state.get((k, name), (0.0, 0.0))
            num, den = num * keep + (x or 0.0), den * keep + (x is not None)
            state[k, name] = num, den
            got = found[k, t][name]
            # Long runs without values decay the brute-force state too, but far from underflow here.
            want = None if den == 0 else num / den
            assert (k, t, name, got) == (k, t, name, want if want is None else pytest.approx(want, rel=1e-9, abs=1e-9))
