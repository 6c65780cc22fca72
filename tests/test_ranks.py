"""The distributed rank kernel against brute force in pandas, on skewed and tied groups."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.bins import with_quantile_bin
from factorloom.functions import ranks
from factorloom.functions.ranks import divided_slices, group_quantiles, value_slice, with_average_ranks, with_ordinal
from factorloom.operators import ic


@pytest.fixture(scope="module")
def frame(spark):
    """One group holds more than a third of all rows, and half of those share one value."""
    rng = np.random.default_rng(7)
    sizes = {"hot": 600, "b": 300, "c": 250, "lone": 1, "flat": 40}
    parts = []
    for g, n in sizes.items():
        x = rng.standard_normal(n) * 10.0 ** rng.integers(-6, 6, n)
        if g == "hot":
            x[: n // 2] = 0.25
        if g == "flat":
            x[:] = -3.0
        parts.append(pd.DataFrame({"g": g, "k": [f"SHSE.60{i:05d}" for i in rng.permutation(n)], "x": x, "y": rng.integers(-3, 3, n).astype(float)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[pdf.index % 13 == 0, "x"] = None
    pdf.loc[3, "x"] = -0.0
    pdf.loc[4, "x"] = 0.0
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df


def _indexed(df, column):
    return df.toPandas().set_index(["g", "k"])[column].sort_index()


def test_average_ranks_equal_pandas(frame):
    pdf, df = frame
    ranked = with_average_ranks(df, ["g"], {"x": "rx", "y": "ry"}, "n")
    base = pdf.set_index(["g", "k"])
    for value, rank in (("x", "rx"), ("y", "ry")):
        expected = base.groupby("g")[value].rank().sort_index()
        pd.testing.assert_series_equal(_indexed(ranked, rank), expected, check_names=False)


def test_ordinal_breaks_ties_by_key(frame):
    pdf, df = frame
    placed = _indexed(with_ordinal(df, ["g"], "x", "k", "o", "n"), "o")
    ordered = pdf.dropna(subset="x").sort_values(["g", "x", "k"]).copy()
    ordered["o"] = ordered.groupby("g").cumcount() + 1.0
    expected = ordered.set_index(["g", "k"])["o"].reindex(placed.index)
    pd.testing.assert_series_equal(placed.astype(float), expected, check_names=False)


@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_quantiles_equal_pandas(frame, interpolation):
    pdf, df = frame
    probabilities = {"a": 0.0, "b": 0.01, "c": 0.37, "d": 0.5, "e": 1.0}
    actual = group_quantiles(df, ["g"], "x", probabilities, interpolation).toPandas().set_index("g").sort_index()
    for g, x in pdf.dropna(subset="x").groupby("g")["x"]:
        values = np.sort(x.to_numpy())
        for name, p in probabilities.items():
            at = p * (len(values) - 1)
            expected = np.quantile(values, p) if interpolation == "linear" else values[int(np.floor(at + 0.5))]
            assert actual.loc[g, name] == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_quantile_bins_merge_repeated_edges(frame):
    pdf, df = frame
    binned = _indexed(with_quantile_bin(df, ["g"], "x", 5, "bin"), "bin")
    base = pdf.set_index(["g", "k"])["x"].sort_index()
    for g in ("hot", "b", "c"):
        expected = pd.qcut(base[g], 5, labels=False, duplicates="drop").astype(float)
        pd.testing.assert_series_equal(binned[g].astype(float), expected, check_names=False)
    assert (binned["flat"].dropna() == 0).all()


def test_slices_never_decrease(spark):
    values = sorted([*np.random.default_rng(1).standard_normal(500), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1e-300])
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").withColumn("s", value_slice(F.col("x")))
    slices = rows.toPandas().sort_values("x", kind="stable")["s"].tolist()
    assert slices == sorted(slices)


@pytest.mark.parametrize("pooled", [False, True])
def test_doubled_ranks_are_twice_the_ranks(frame, pooled, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_VALUES", 20)
    pdf, df = frame
    ranked = with_average_ranks(df, ["g"], {"x": "rx", "y": "ry"}, pooled=pooled, doubled=True)
    assert dict(ranked.dtypes)["rx"] == "bigint"
    expected = 2 * pdf.set_index(["g", "k"]).groupby("g")["x"].rank().sort_index()
    pd.testing.assert_series_equal(_indexed(ranked, "rx").astype(float), expected, check_names=False)


def test_narrow_band_is_spread_evenly(spark):
    """A million values in one fixed slice, most of them within a billionth beside a far one: every task gets its share."""
    x = 1 + F.rand(1) * F.when(F.col("id") % 10 == 0, 1e-2).otherwise(1e-9)
    rows = spark.range(1_000_000).select(F.lit("hot").alias("g"), x.alias("x")).withColumn("_slice", value_slice(F.col("x")))
    assert rows.where("x < 1.01").groupBy("g", "_slice").count().agg(F.max("count")).first()[0] > 900_000
    cut = divided_slices(rows, ["g"], "x", 4096).persist()
    held = cut.groupBy("g", "_slice").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_slice").collect()
    assert max(r.n for r in held) <= 4096
    assert all(a.hi < b.lo for a, b in zip(held, held[1:]))
    tasks = [r["count"] for r in cut.repartition(8, "g", "_slice").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 8 and max(tasks) < 1.5 * 125_000
    cut.unpersist()


def test_ic_is_zero_exactly_where_arithmetic_says_so(spark):
    """Two dates with an IC of 0, whose floating-point value may have either sign, and one above it."""
    zero = [(1.0, 2.0), (2.0, 4.0), (3.0, 1.0), (4.0, 3.0)]
    flat = [(float(k), float(v)) for k, v in zip((1, 2, 3, 4, 5, 6, 7), (4, 1, 6, 7, 5, 2, 3))]
    flat = flat if np.isclose(np.corrcoef(*zip(*flat))[0, 1], 0) else zero
    up = [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)]
    rows = [(f"199{d}-01-01", "f", x, y) for d, part in enumerate((zero, flat, up)) for x, y in part]
    rows += [("1990-01-01", "f", None, 1.0), ("1990-01-01", "f", 2.0, None)]
    long = spark.createDataFrame(rows, "datetime string, factor string, value double, label double")
    daily = {r.datetime: r.ic for r in ic.daily_rank_ic(long, 2).collect()}
    assert daily["1990-01-01"] == 0.0 and daily["1991-01-01"] == 0.0 and daily["1992-01-01"] == pytest.approx(0.8)
    assert ic.ic_summary(ic.daily_rank_ic(long, 2)).first().win_rate == pytest.approx(1 / 3)


@pytest.mark.parametrize("pooled", [False, True])
def test_rank_correlation_equals_pandas(frame, pooled):
    pdf, df = frame
    got = {r.g: (r.ic, r.n) for r in ic.rank_correlation(df, ["g"], "x", "y", pooled=pooled).collect()}
    for g, part in pdf.dropna().groupby("g"):
        rho = part["x"].rank().corr(part["y"].rank())
        assert got[g][1] == len(part)
        assert got[g][0] is None if np.isnan(rho) else got[g][0] == pytest.approx(rho, abs=1e-12)


def test_slices_that_are_not_crowded_are_not_sketched(spark, monkeypatch):
    from factorloom.functions import ranks

    names = []
    monkeypatch.setattr(ranks, "stored", lambda df, name: names.append(name) or df)
    cells = spark.range(500).select(F.col("id").cast("double").alias("x")).withColumn("_slice", value_slice(F.col("x")))
    assert divided_slices(cells, [], "x", 1000).count() == 500 and "cuts" not in names


def test_strength_bins_compute_their_input_once(spark, monkeypatch):
    from factorloom.operators import tearsheet

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(3)
    rows = [(dt.date(2024, 1, 1 + i % 4), float(rng.standard_normal()), float(rng.standard_normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "datetime date, factor double, ret double")
    found = {r.bin: r for r in tearsheet.strength_bins(df.mapInArrow(count, df.schema), "ret", 1, 2).collect()}
    assert seen.value == 200 and set(found) == {"All", "bin_1", "bin_2"}
    x, y = df.toPandas()["factor"], df.toPandas()["ret"]
    assert found["All"].rank_ic == pytest.approx(x.rank().corr(y.rank()), abs=1e-12)
    assert found["All"].win_pct == pytest.approx((y > 0).mean() * 100)
