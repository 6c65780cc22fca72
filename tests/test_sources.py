"""Readers, sinks and streams on files written by the test."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import factors
from factorloom.sources import readers, sinks, tables
from factorloom.sources.tables import bars
from factorloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_symbol_comes_from_the_file_name(spark, tmp_path):
    for s in ("SH600000", "SZ000001"):
        pd.DataFrame({"date": ["2024-01-02", "2024-01-03", "2024-02-01"], "close": [1.0, 2.0, 3.0]}).to_parquet(tmp_path / f"{s}.parquet")
    got = readers.scan_symbol_files(spark, str(tmp_path), "2024-01-03", "2024-01-31").collect()
    assert {(r.instrument, r.close) for r in got} == {("SH600000", 2.0), ("SZ000001", 2.0)}


def test_csv_headers_may_drift(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,trade_date,pe_ttm,pb_mrq\nA,2024-01-02,1.5,2.5\nA,2024-01-03,,3.5\n", encoding="gbk")
    (tmp_path / "b.csv").write_text("trade_date,symbol,备注,pe_ttm\n2024-01-02,B,说明,7\n", encoding="gbk")
    raw = readers.scan_export_csv(spark, str(tmp_path), ["symbol", "trade_date", "pe_ttm", "pb_mrq"], "GBK")
    got = readers.with_export_date(raw).select("symbol", "date", F.col("pe_ttm").cast("double"), F.col("pb_mrq").cast("double"))
    d = dt.date
    assert {tuple(r) for r in got.collect()} == {
        ("A", d(2024, 1, 2), 1.5, 2.5), ("A", d(2024, 1, 3), None, 3.5), ("B", d(2024, 1, 2), 7.0, None),
    }


def test_csv_line_equal_to_its_header_is_a_row(spark, tmp_path):
    """Only the first line is the header: a later line of the same text, blank lines, short lines and files without rows."""
    (tmp_path / "a.csv").write_text("\nsymbol,note\nA,1\nsymbol,note\n\nB\n")
    (tmp_path / "b.csv").write_text('note,"symbol",symbol\n"x, ""y""",C,D\n')
    (tmp_path / "c.csv").write_text("symbol,note\n")
    (tmp_path / "d.csv").write_text("")
    got = readers.scan_export_csv(spark, str(tmp_path), ["symbol", "note", "absent"]).collect()
    assert sorted(tuple(r) for r in got if r.note) == [("A", "1", None), ("C", 'x, "y"', None), ("symbol", "note", None)]
    assert [tuple(r) for r in got if not r.note] == [("B", None, None)]


def test_csv_header_of_a_file_in_many_blocks(spark, tmp_path, request):
    """Only the first block starts with the header; the others start with rows."""
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.files.maxPartitionBytes"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    (tmp_path / "a.csv").write_text("symbol,n\n" + "".join(f"S{i},{i}\n" for i in range(3000)))
    raw = readers.scan_export_csv(spark, str(tmp_path), ["n", "symbol"])
    assert raw.select(F.spark_partition_id()).distinct().count() > 1
    got = raw.collect()
    assert sorted(int(r.n) for r in got) == list(range(3000)) and all(r.symbol == f"S{r.n}" for r in got)


def test_factor_pool_round_trip_and_year_pruning(spark, tmp_path):
    table = factors.rolling_factors(bars(spark, SF), [factors.trend], (5,)).withColumn("label_1d", F.lit(0.0))
    path = str(tmp_path / "pool")
    summary = sinks.write_factor_pool(table, path).first()
    assert (summary.n_rows, summary.n_symbols, summary.n_factors, summary.n_labels) == (table.count(), 10, 3, 1)
    pruned = spark.read.parquet(path).where("year = 1997")
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().toString()
    sinks.write_filtered_pool(table, ["MA5"], str(tmp_path / "kept"))
    assert set(readers.read_factor_pool(spark, str(tmp_path / "kept")).columns) == {"datetime", "instrument", "MA5", "label_1d", "year"}


def test_bucketed_table_needs_no_shuffle_for_history_windows(spark, tmp_path, request):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS pool_db LOCATION '{tmp_path / 'db'}'")
    request.addfinalizer(lambda: spark.sql("DROP DATABASE pool_db CASCADE"))
    sinks.write_by_instrument(bars(spark, SF), "pool_db.bars", 4)
    plan = factors.rolling_factors(spark.table("pool_db.bars"), [factors.trend], (5,))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_result_tables_are_written_side_by_side(spark, tmp_path):
    sinks.write_tables({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("y")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3 and spark.read.parquet(str(tmp_path / "b")).columns == ["y"]


def test_stream_keeps_rows_of_any_age(spark, tmp_path):
    """Three batches, the last one ten days older than the others, with repeats within and across batches."""
    source = tmp_path / "in"
    source.mkdir()
    schema = "symbol string, bob timestamp_ntz, v int"
    t = dt.datetime
    deliveries = [
        [("A", t(2024, 1, 11), 1), ("B", t(2024, 1, 11), 1), ("A", t(2024, 1, 11), 9)],
        [("A", t(2024, 1, 11), 2), ("A", t(2024, 1, 12), 2)],
        [("A", t(2024, 1, 1), 3), ("B", t(2024, 1, 11), 3)],
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    typed = spark.read.parquet(str(source)).schema
    stream = incremental.read_bars(spark, str(source), typed, files_per_trigger=1)
    writer = incremental.write_first_arrivals(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ["symbol", "bob"], "bob", str(tmp_path / "c"), "symbol")
    writer.trigger(availableNow=True).start().awaitTermination()
    stored = incremental.stored_rows(spark, str(tmp_path / "t"), typed)
    assert {(r.symbol, r.bob) for r in stored.collect()} == {("A", t(2024, 1, 11)), ("B", t(2024, 1, 11)), ("A", t(2024, 1, 12)), ("A", t(2024, 1, 1))}
    assert stored.count() == 4 and stored.select("batch").distinct().count() == 3
    got = {r.symbol: (r.last_time.date(), r.n_events) for r in incremental.coverage(spark, str(tmp_path / "c"), "symbol").collect()}
    assert got == {"A": (dt.date(2024, 1, 12), 3), "B": (dt.date(2024, 1, 11), 1)}


def test_symbol_files_missing_directory_fails(spark, tmp_path):
    with pytest.raises(Exception):
        readers.scan_symbol_files(spark, str(tmp_path / "none")).collect()


def test_line_order_puts_the_digits_of_its_parts_together_without_text(spark):
    rows = [("1995-03-01", 7, 1, 12, 1234.565), ("2024-12-31", 999_999_999_999, 7, 91_999_999_999, 999_999.99), ("1960-01-01", 1, 1, 1, 0.0)]
    rows += [(None, 7, 1, 12, 1.0), ("1995-03-01", 7, 1, 12, None)]
    lines = spark.createDataFrame(rows, "l_shipdate string, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double")
    ordered = lines.select(tables._line_order().alias("line"))
    assert ordered.schema["line"].dataType.simpleString() == "decimal(38,0)"
    assert [None if r.line is None else int(r.line) for r in ordered.collect()] == [
        int("109190" + "000000000007" + "1" + "00000000012" + "00123457"),
        int("120088" + "999999999999" + "7" + "91999999999" + "99999999"),
        int("096347" + "000000000001" + "1" + "00000000001" + "00000000"),
        None,
        None,
    ]
    assert "lpad" not in ordered._jdf.queryExecution().optimizedPlan().toString()
