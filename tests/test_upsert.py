"""Merging an increment into a table by year."""

import datetime as dt

from factorloom.sources import sinks
from factorloom.sources.shared import shared_folder

SCHEMA = "instrument string, datetime date, close double"


def _files(spark, path):
    return {f for f in spark.read.parquet(path).inputFiles()}


def test_only_touched_years_are_written(spark):
    path = shared_folder(spark, "upsert-test")
    rows = {(k, dt.date(y, 3, d)): float(y + d) for k in "AB" for y in (2021, 2022, 2023) for d in (1, 2)}
    sinks.write_by_year(spark.createDataFrame([(*k, v) for k, v in rows.items()], SCHEMA), path)
    before = _files(spark, path)
    change = {("A", dt.date(2022, 3, 1)): -1.0, ("C", dt.date(2022, 5, 5)): 5.0, ("B", dt.date(2024, 1, 1)): None}
    increment = spark.createDataFrame([(*k, v) for k, v in change.items()], SCHEMA)
    for _ in range(2):
        sinks.upsert_by_year(increment, path)
        got = {(r.instrument, r.datetime): r.close for r in spark.read.parquet(path).collect()}
        assert got == rows | change and spark.read.parquet(path).count() == len(got)
    kept = {f for f in before if "year=2022" not in f}
    assert kept and kept <= _files(spark, path) and not (before - kept) & _files(spark, path)


def test_empty_increment_changes_nothing(spark):
    path = shared_folder(spark, "upsert-empty")
    sinks.write_by_year(spark.createDataFrame([("A", dt.date(2021, 1, 1), 1.0)], SCHEMA), path)
    before = _files(spark, path)
    sinks.upsert_by_year(spark.createDataFrame([], SCHEMA), path)
    assert _files(spark, path) == before
