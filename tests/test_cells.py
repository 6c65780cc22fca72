"""Measures of the columns of a wide table equal those of the long table, whatever a task may hold."""

import datetime as dt
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.functions import cells
from factorloom.operators import ic, screening, xsection
from factorloom.sources.shared import CLEANUP, stored

NAMES = [f"f{i}" for i in range(10)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(6):
        for i in range(30):
            values = [None if rng.random() < 0.1 else float(v) for v in np.round(rng.standard_normal(9), 1)]
            label = None if rng.random() < 0.1 else float(np.round(rng.standard_normal() * 8) / 8)
            # Labels add up exactly, in any order. Two names are a whole cross-section of the last column, and one value is not finite.
            last = float(i) if i < 2 else float("nan") if i == 2 else None
            rows.append((None if d == 5 else dt.date(2024 + d // 3, 1, 1 + d), i, label, *values, last))
    return spark.createDataFrame(rows, f"datetime date, instrument long, label double, {', '.join(f'{n} double' for n in NAMES)}").cache()


@pytest.fixture(params=[cells.CELL_VALUES, 100, 0], ids=["whole", "few columns", "slices"])
def held(request, monkeypatch):
    monkeypatch.setattr(cells, "CELL_VALUES", request.param)
    return request.param


def _same(got, expected, keys):
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, expected))
    assert a.keys() == b.keys()
    for k, row in b.items():
        for c in columns:
            assert a[k][c] == (pytest.approx(row[c], abs=1e-12) if isinstance(row[c], float) else row[c]), (k, c)


def _long(table):
    return xsection.to_long(table, NAMES, ["label"])


def test_columns_follow_the_largest_group(table, held):
    assert cells.columns_per_cell(table, ["datetime"]) == {cells.COLUMNS: cells.COLUMNS, 100: 2, 0: 0}.get(held, cells.COLUMNS)


def test_daily_ics(table, held):
    _same(ic.daily_rank_ic(table, 2, NAMES), ic.daily_rank_ic(_long(table), 2), ["datetime", "factor"])


@pytest.mark.parametrize("mode", ["even", "literal"])
def test_profile(table, held, mode):
    table = table.where("datetime IS NOT NULL") if mode == "literal" else table
    _same(screening.profile(table, 5, mode, factors=NAMES), screening.profile(_long(table), 5, mode), ["factor"])


def test_stability(table, held):
    _same(screening.stability(table, rolling_days=2, factors=NAMES), screening.stability(_long(table), rolling_days=2), ["factor"])


def test_composites(table):
    weights = screening.signal_weights(ic.ic_summary(ic.daily_rank_ic(_long(table), 2))).where("factor <> 'f9'")
    got = screening.composite_columns(table, NAMES, weights)
    assert got.where("signal IS NOT NULL").count() > 0
    _same(got, screening.composite_signals(_long(table), weights), ["portfolio", "datetime", "instrument"])
    assert screening.composite_columns(table, NAMES, weights.where("false")).count() == 0


def test_preprocessing(table, held):
    expected = xsection.to_wide(xsection.preprocess(_long(table)), NAMES, ["label"])
    _same(xsection.preprocess_columns(table, NAMES, ["label"]), expected, ["datetime", "instrument"])


def test_large_groups_sum_without_rounding():
    rng = np.random.default_rng(0)
    a, b = (cells.doubled_ranks(rng.standard_normal(200_000)) for _ in range(2))
    exact = sum(int(x) * int(y) for x, y in zip(a, b)) - len(a) * (len(a) + 1) ** 2
    assert cells.rank_moment(a, b) == exact


def test_wide_rows_are_made_in_one_shuffle(spark):
    """Long rows are dealt once and added up where they are, also where a date, a name or a factor is missing."""
    rows = [("d1", 1, "a", 1.0), ("d1", 1, "b", None), ("d1", None, "a", 2.0), (None, 1, "b", 3.0), ("d2", 1, None, 4.0)]
    long = spark.createDataFrame(rows, "datetime string, instrument int, factor string, value double")
    wide = xsection.to_wide(long, ["a", "b"])
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in wide.collect()} == {("d1", 1, 1.0, None), ("d1", None, 2.0, None), (None, 1, None, 3.0), ("d2", 1, None, None)}


def test_packed_values_are_the_same_and_smaller():
    values = np.random.default_rng(1).standard_normal((3, 1000)) * 100
    values[1, :3] = np.nan, -0.0, 5e-324
    packed = cells.pack(values)
    assert len(packed) < 0.95 * values.nbytes
    assert cells.unpack(pa.py_buffer(packed), 3, 1000).tobytes() == values.tobytes()


def test_shuffle_carries_packed_cells(table):
    """A row of the shuffle is a cell's share of a task, not a row of the table or a part of one."""
    plan = ic.column_rank_correlation(table, "datetime", NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    (row,) = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert "_kept" in row


def test_columns_of_a_family_share_a_pass(monkeypatch):
    names = ["K", "A5", "B5", "A10", "B10"]
    assert cells.passes(names, 0) == cells.passes(names, 10) == [names]
    monkeypatch.setattr(cells, "PASS_VALUES", 20)
    assert cells.passes(names, 10) == [["K", "A5"], ["A10", "B5"], ["B10"]]
    assert cells.passes(names, 10**9) == [["K"], ["A5"], ["A10"], ["B5"], ["B10"]]


def test_passes_find_what_one_finds(table, monkeypatch):
    monkeypatch.setattr(cells, "PASS_VALUES", 600)
    kept = []
    monkeypatch.setattr(cells, "stored", lambda df, name: kept.append(name) or stored(df, name))
    _same(ic.daily_rank_ic(table, 2, NAMES), ic.daily_rank_ic(_long(table), 2), ["datetime", "factor"])
    assert len(kept) > 1
    _same(screening.profile(table, factors=NAMES), screening.profile(_long(table)), ["factor"])
    _same(screening.stability(table, rolling_days=2, factors=NAMES), screening.stability(_long(table), rolling_days=2), ["factor"])


def test_stability_stores_no_rows_of_the_table(table, monkeypatch):
    """Dates and strata are ranked from one reading: what is stored has a row per cell and factor."""
    sizes = {}

    def noted(df, name, compression=None):
        out = stored(df, name, compression)
        sizes[name] = len(out.columns)
        return out

    for module in (ic, screening, cells):
        monkeypatch.setattr(module, "stored", noted)
    screening.stability(table, rolling_days=2, factors=NAMES).collect()
    assert sizes == {"correlations": 6}


def test_prepared_ranks_are_stored_as_whole_numbers(table, monkeypatch):
    kept = []

    def noted(df, name, compression=None):
        kept.append(df)
        return stored(df, name, compression)

    monkeypatch.setattr(xsection, "stored", noted)
    xsection.preprocess_columns(table, NAMES, ["label"])
    (ranks,) = kept
    assert {t for c, t in ranks.dtypes if c in NAMES} == {"int"}
    # From the cells of a date straight to rows.
    assert ranks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_shuffles_go_when_their_result_is_stored(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    rows = stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert rows.count() == 7 and spark.conf.get(CLEANUP) == "false"
