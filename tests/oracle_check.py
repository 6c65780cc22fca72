"""Run registered queries beside their SQL statements and report differences.

``python -m tests.oracle_check [--sf 0.01] [name ...]`` checks the named queries, or all.
"""

from __future__ import annotations

import argparse
import datetime
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=lambda t: str(t))


def compare(df, con, sql: str) -> str | None:
    """None if both results are equal as sets of rows, else a description of the difference."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    sql_types = dict(zip(sql_columns, (str(d[1]) for d in result.description)))
    expected = _rows(sql_columns, result.fetchall())
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(sql_columns)}"
    odd = {c: (t, sql_types[c]) for c, t in df.dtypes if not _same_type(t, sql_types[c])}
    if odd:
        return f"types differ: {odd}"
    actual = _rows(df.columns, df.collect())
    if len(actual) != len(expected):
        return f"row counts differ: {len(actual)} / {len(expected)}"
    bad = [(a, e) for a, e in zip(actual, expected) if a != e or str(a) != str(e)]
    if bad:
        a, e = bad[0]
        cells = [(c, x, y) for c, x, y in zip(sorted(df.columns), a, e) if x != y or str(x) != str(y)]
        return f"{len(bad)} of {len(actual)} rows differ, first: {cells[:6]} in {a[:8]}"
    return None


_SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def _same_type(spark_type: str, sql_type: str) -> bool:
    known = _SAME.get(spark_type)
    return known is None or known == sql_type or (known == "VARCHAR" and sql_type in ("STRING", "VARCHAR"))


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factorloom-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def main() -> int:
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--dir", help="table directory, instead of a scale factor")
    args = parser.parse_args()
    sf_dir = args.dir or f"/root/testdata/sf{args.sf}"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in queries:
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, con, oracle[name]) if name in oracle else f"(rows only: {df.count()})"
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failures += problem is not None and not problem.startswith("(rows only")
        print(f"{time.time() - start:6.1f}s {name}: {problem or 'ok'}", flush=True)
    spark.stop()
    return failures


if __name__ == "__main__":
    raise SystemExit(main())
