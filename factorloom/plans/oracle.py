"""Building blocks of the SQL statements: derived tables, windows, ranks and safe statistics."""

from __future__ import annotations

BARS = """bars AS (
  SELECT l_suppkey AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS datetime,
         first(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(px) AS high, min(px) AS low,
         last(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem)
  GROUP BY 1, 2)"""

CALENDAR = """cal AS (
  SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS date_idx
  FROM (SELECT DISTINCT datetime FROM bars))"""

HISTORY = "h AS (PARTITION BY instrument ORDER BY datetime)"


def r(expression: str, name: str, digits: int = 6) -> str:
    """Rounded output column, without negative zero."""
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"


def frame(name: str, rows: int) -> str:
    return f"{name} AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def full(aggregate: str, observed: str, window: str, rows: int) -> str:
    return f"CASE WHEN count({observed}) OVER {window} >= {rows} THEN {aggregate} OVER {window} END"


def corr(a: str, b: str, over: str = "", min_count: int = 2) -> str:
    """Pairwise complete correlation, null on constant input."""
    x = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)"
    y = f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    w = f" OVER {over}" if over else ""
    return (
        f"CASE WHEN count({x}){w} >= {min_count}"
        f" AND stddev_samp({x}){w} > 1e-12 * abs(avg({x}){w}) AND stddev_samp({y}){w} > 1e-12 * abs(avg({y}){w})"
        f" THEN covar_samp({x}, {y}){w} / (stddev_samp({x}){w} * stddev_samp({y}){w}) END"
    )


def average_rank(column: str, by: str) -> str:
    """Average rank among the group's rows; the column must not be null."""
    part = f"PARTITION BY {by}" if by else ""
    ties = f"PARTITION BY {by}, {column}" if by else f"PARTITION BY {column}"
    return f"(rank() OVER ({part} ORDER BY {column}) + (count(*) OVER ({ties}) - 1) / 2.0::DOUBLE)"


def doubled_rank(column: str, by: str) -> str:
    """Twice the average rank among the group's rows, a whole number; the column must not be null."""
    return f"(2 * rank() OVER (PARTITION BY {by} ORDER BY {column}) + count(*) OVER (PARTITION BY {by}, {column}) - 1)"


def rank_ic(name: str, source: str, by: str, x: str = "value", y: str = "label", min_count: int = 2, out: str = "ic") -> str:
    """CTEs ending in ``name``: rank correlation and count per group, from whole-number moments."""
    return f"""{name}_r AS (
  SELECT {by}, {doubled_rank('x', by)} AS rx, {doubled_rank('y', by)} AS ry
  FROM (SELECT {by}, {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)),
{name}_m AS (
  SELECT {by}, count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * rx) AS sxx, sum(ry * ry) AS syy, sum(rx * ry) AS sxy
  FROM {name}_r GROUP BY {by}),
{name} AS (
  SELECT {by}, CASE WHEN n >= {min_count} AND n * sxx > sx * sx AND n * syy > sy * sy
    THEN (n * sxy - sx * sy)::DOUBLE / (sqrt((n * sxx - sx * sx)::DOUBLE) * sqrt((n * syy - sy * sy)::DOUBLE)) END AS {out}, n
  FROM {name}_m)"""
