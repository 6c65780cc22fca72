"""Ingest, point-in-time and data-quality queries."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from factorloom.functions import symbols
from factorloom.functions.numeric import rounded
from factorloom.operators import ingest, labels, pit, quality
from factorloom.plans.oracle import BARS, CALENDAR, HISTORY, r
from factorloom.plans.panel import PANEL, panel
from factorloom.plans.registry import query
from factorloom.sources import readers, sinks, tables
from factorloom.sources.shared import shared_folder, stored

INCOME = """income AS (
  SELECT l_suppkey AS symbol, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + 45 AS pub_date,
         CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS rpt_date, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net_prof
  FROM (SELECT *, date_trunc('quarter', l_shipdate) AS q FROM lineitem) GROUP BY l_suppkey, q)"""
BALANCE = """balance AS (
  SELECT l_suppkey AS symbol, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + 45 AS pub_date,
         CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS rpt_date, sum(l_quantity) AS ttl_ast
  FROM (SELECT *, date_trunc('quarter', l_shipdate) AS q FROM lineitem WHERE l_returnflag = 'A') GROUP BY l_suppkey, q)"""
SUPPLEMENT = f"{BARS}, {CALENDAR}, sup AS (SELECT instrument, datetime, volume / amount AS turnrate FROM bars JOIN cal USING (datetime) WHERE date_idx % 2 = 0)"
DAYS = "days AS (SELECT user_id, CAST(ts AS DATE) AS date, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"
UNIVERSE = "uni AS (SELECT s_suppkey AS instrument FROM supplier WHERE s_acctbal > 0)"

# --- sources --------------------------------------------------------------------------


@query("source_monthly_bars", f"WITH {BARS} SELECT * FROM bars")
def monthly_bars(spark, sf_dir):
    return tables.bars(spark, sf_dir)


@query(
    "source_symbol_from_file",
    "SELECT 'lineitem' AS instrument, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' GROUP BY 2",
)
def symbol_from_file(spark, sf_dir):
    """The file's base name becomes the instrument; the date filter reaches the scan."""
    schema = tables.table(spark, sf_dir, "lineitem").select("l_shipdate").schema
    lines = readers.scan_symbol_files(spark, f"{sf_dir}/lineitem.parquet", schema=schema)
    lines = lines.where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("date")).withColumn("date", F.to_date("l_shipdate"))
    return lines.groupBy("instrument", "date").agg(F.count(F.lit(1)).alias("n"))


@query("source_export_date", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders")
def export_date(spark, sf_dir):
    """Textual timestamps with a zone suffix are cut to their date."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+08:00"))
    raw = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"), text.alias("bob"))
    return readers.with_export_date(raw).select("o_orderkey", "symbol", "date")


@query("source_without_timezone", "SELECT event_id, CAST(ts AS DATE) AS date, hour(ts)::INTEGER AS hour FROM events")
def without_timezone(spark, sf_dir):
    zoned = tables.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    plain = zoned.withColumn("ts", readers.without_timezone(F.col("ts")))
    return plain.select("event_id", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"))


@query(
    "source_symbol_notations",
    """WITH s AS (SELECT DISTINCT instrument, CASE WHEN instrument % 3 = 0 THEN 'SHSE' WHEN instrument % 3 = 1 THEN 'SZSE' ELSE 'HKEX' END AS ex,
        lpad(instrument::VARCHAR, 6, '0') AS code FROM (SELECT l_suppkey AS instrument FROM lineitem))
    SELECT instrument, CASE ex WHEN 'SHSE' THEN 'SH' WHEN 'SZSE' THEN 'SZ' ELSE ex END || code AS prefixed,
      CASE ex WHEN 'SHSE' THEN 'SHSE.' || code WHEN 'SZSE' THEN 'SZSE.' || code ELSE 'HK.EX' || code END AS dotted,
      code || '.' || CASE ex WHEN 'SHSE' THEN 'XSHG' WHEN 'SZSE' THEN 'XSHE' ELSE ex END AS suffixed,
      ex || '.' || code AS restored FROM s""",
)
def symbol_notations(spark, sf_dir):
    number = F.col("l_suppkey")
    exchange = F.when(number % 3 == 0, "SHSE").when(number % 3 == 1, "SZSE").otherwise("HKEX")
    symbol = F.concat_ws(".", exchange, F.lpad(number.cast("string"), 6, "0"))
    names = tables.table(spark, sf_dir, "lineitem").select(number.alias("instrument"), symbol.alias("symbol")).distinct()
    named = names.withColumns(
        {"prefixed": symbols.to_prefixed(F.col("symbol")), "suffixed": symbols.to_suffixed(F.col("symbol"))}
    )
    return named.select(
        "instrument",
        "prefixed",
        symbols.to_dotted(F.col("prefixed")).alias("dotted"),
        "suffixed",
        symbols.from_suffixed(F.col("suffixed")).alias("restored"),
    )


@query(
    "sink_pool_summary",
    f"WITH {PANEL} SELECT count(*) AS n_rows, count(DISTINCT instrument) AS n_symbols, 8::BIGINT AS n_factors, 2::BIGINT AS n_labels, min(datetime) AS first_date, max(datetime) AS last_date FROM panel",
)
def pool_summary(spark, sf_dir):
    """Written by year, summarised from the written files."""
    return sinks.write_factor_pool(panel(spark, sf_dir).drop("amount"), f"{shared_folder(spark, 'pool')}/pool")


_POOL_COLUMNS = ", ".join(r(c, c) for c in ("KMID", "MA20", "label_1d"))


@query("source_factor_pool", f"WITH {PANEL} SELECT datetime, instrument, {_POOL_COLUMNS}, year(datetime)::INTEGER AS year FROM panel")
def factor_pool(spark, sf_dir):
    """A pool written by year and read back."""
    path = f"{shared_folder(spark, 'pool')}/pool"
    sinks.write_factor_pool(panel(spark, sf_dir), path)
    return rounded(readers.read_factor_pool(spark, path).select("datetime", "instrument", "KMID", "MA20", "label_1d", "year"))


@query("sink_filtered_pool", f"WITH {PANEL} SELECT datetime, instrument, {r('MA20', 'MA20')}, {r('label_1d', 'label_1d')}, {r('label_5d', 'label_5d')} FROM panel")
def filtered_pool(spark, sf_dir):
    """Keys, one surviving factor and all labels."""
    path = f"{shared_folder(spark, 'filtered')}/pool"
    sinks.write_filtered_pool(panel(spark, sf_dir), ["MA20"], path)
    return rounded(readers.read_factor_pool(spark, path).drop("year"))


@query("sink_by_instrument", f"WITH {BARS} SELECT * FROM bars")
def by_instrument(spark, sf_dir):
    """Bars in a table bucketed by instrument, read back; the table goes once its rows are stored."""
    name = f"bars_{uuid.uuid4().hex}"
    sinks.write_by_instrument(tables.bars(spark, sf_dir), name, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(spark.table(name), "bars")
    spark.sql(f"DROP TABLE {name}")
    return rows


@query(
    "sink_result_tables",
    f"WITH {BARS} SELECT 'per_instrument' AS name, instrument::BIGINT AS key, count(*) AS n FROM bars GROUP BY 2 UNION ALL SELECT 'per_year', year(datetime)::BIGINT, count(*) FROM bars GROUP BY 2",
)
def result_tables(spark, sf_dir):
    """Two result tables side by side in one folder, read back from it."""
    rows, folder = tables.bars(spark, sf_dir), shared_folder(spark, "results")
    count = F.count(F.lit(1)).alias("n")
    results = {
        "per_instrument": rows.groupBy(F.col("instrument").alias("key")).agg(count),
        "per_year": rows.groupBy(F.year("datetime").cast("bigint").alias("key")).agg(count),
    }
    sinks.write_tables(results, folder)
    first, second = (spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("name"), "key", "n") for name in results)
    return first.unionByName(second)


_EXPORT_SQL = "SELECT o_orderkey::VARCHAR AS symbol, CAST(o_orderdate AS DATE) AS date, {0} AS note, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders"
_GBK_NOTE = "\u4ef7, \u201c\u503c\u201d \"x\" "


def _exports(spark, sf_dir, note: str, encode=None) -> str:
    """Orders as CSV files whose headers drift: another order of columns, a column too many, one missing."""
    folder = shared_folder(spark, "exports")
    rows = tables.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("symbol"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("trade_date"),
        F.concat(F.lit(note), "o_orderpriority").alias("note"),
        F.col("o_totalprice").alias("price"),
        F.lit("symbol").alias("kind"),
    )
    if encode is not None:
        rows = rows.withColumn("note", encode("note"))
    halves = {"even": ["price", "symbol", "note", "trade_date"], "odd": ["symbol", "trade_date", "kind", "note"]}
    for i, (name, columns) in enumerate(halves.items()):
        half = rows.where(F.col("o_orderkey") % 2 == i).select(*columns)
        half.write.option("header", True).option("encoding", "UTF-8" if encode is None else "ISO-8859-1").option("escape", '"').csv(f"{folder}/{name}")
    return f"{folder}/*"


def _export_rows(raw):
    dated = readers.with_export_date(raw)
    return dated.select("symbol", "date", "note", F.col("price").cast("double").alias("price"))


@query("source_export_csv", _EXPORT_SQL.format("""'a, "b" ' || o_orderpriority"""))
def export_csv(spark, sf_dir):
    """Drifting headers; cells hold commas, quotes and a column's name."""
    folder = _exports(spark, sf_dir, 'a, "b" ')
    return _export_rows(readers.scan_export_csv(spark, folder, ["symbol", "trade_date", "note", "price"]))


@query("source_export_gbk", _EXPORT_SQL.format(f"""'{_GBK_NOTE}' || o_orderpriority"""))
def export_gbk(spark, sf_dir):
    """The same in an encoding that Spark's reader does not know."""

    @F.pandas_udf("string")
    def as_latin(note: pd.Series) -> pd.Series:
        return note.map(lambda text: text.encode("gbk").decode("latin-1"))

    folder = _exports(spark, sf_dir, _GBK_NOTE, as_latin)
    return _export_rows(readers.scan_export_csv(spark, folder, ["symbol", "trade_date", "note", "price"], "GBK"))


@query("ingest_available", "SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders")
def available(spark, sf_dir):
    """Of the wanted fields those that the table has."""
    return ingest.available(tables.table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "absent", "o_custkey"])


# --- assembly -------------------------------------------------------------------------


@query(
    "ingest_supplements",
    f"WITH {SUPPLEMENT} SELECT bars.instrument, bars.datetime, close, turnrate FROM bars LEFT JOIN sup USING (instrument, datetime)",
)
def supplements(spark, sf_dir):
    return ingest.with_supplements(tables.closes(spark, sf_dir), [tables.supplement(spark, sf_dir)])


@query(
    "ingest_adjusted_prices",
    f"""WITH {SUPPLEMENT}, a AS (SELECT bars.*, coalesce(1 + turnrate, 1.0::DOUBLE) AS factor FROM bars LEFT JOIN sup USING (instrument, datetime))
    SELECT instrument, datetime, factor, close * factor AS adj_close, high * factor AS adj_high, close > 0 AND open > 0 AND high > 0 AND low > 0 AND volume > 0 AS is_valid_bar FROM a""",
)
def adjusted(spark, sf_dir):
    factors = tables.supplement(spark, sf_dir).select("instrument", "datetime", (1 + F.col("turnrate")).alias("adj_factor_fwd"))
    joined = ingest.with_adjustment_factor(tables.bars(spark, sf_dir), factors)
    return ingest.adjusted_prices(joined).select("instrument", "datetime", "factor", "adj_close", "adj_high", "is_valid_bar")


def _fill_sql(frame: str) -> str:
    return f"""WITH {SUPPLEMENT}, j AS (SELECT bars.instrument, bars.datetime, close, turnrate FROM bars LEFT JOIN sup USING (instrument, datetime))
    SELECT instrument, datetime, close, last_value(turnrate IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {frame} AND CURRENT ROW) AS turnrate FROM j"""


@query("ingest_forward_fill", _fill_sql("UNBOUNDED PRECEDING"))
def forward_fill(spark, sf_dir):
    joined = ingest.with_supplements(tables.closes(spark, sf_dir), [tables.supplement(spark, sf_dir)])
    return ingest.forward_fill(joined, ["turnrate"])


def _sparse(spark, sf_dir):
    """Supplement values of every sixth date only."""
    from factorloom.functions.calendar import with_date_index

    indexed = with_date_index(tables.bars(spark, sf_dir))
    value = F.when(F.col("date_idx") % 6 == 0, F.col("volume"))
    return indexed.select("instrument", "datetime", value.alias("holders"))


@query(
    "ingest_forward_fill_limited",
    f"""WITH {BARS}, {CALENDAR}, j AS (SELECT instrument, datetime, CASE WHEN date_idx % 6 = 0 THEN volume END AS holders FROM bars JOIN cal USING (datetime))
    SELECT instrument, datetime, last_value(holders IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS holders FROM j""",
)
def forward_fill_limited(spark, sf_dir):
    return ingest.forward_fill(_sparse(spark, sf_dir), ["holders"], limit=3)


@query("ingest_assembled_daily", _fill_sql("UNBOUNDED PRECEDING"))
def assembled_daily(spark, sf_dir):
    """A spine with repeated rows: supplements joined, one row per date, low-frequency fields filled."""
    spine = tables.closes(spark, sf_dir)
    return ingest.assemble_daily(spine.unionByName(spine), [tables.supplement(spark, sf_dir)])


@query(
    "ingest_first_per_key",
    """SELECT l_suppkey, day, first(l_orderkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS l_orderkey,
      first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS l_extendedprice
    FROM (SELECT *, CAST(l_shipdate AS DATE) AS day FROM lineitem) GROUP BY 1, 2""",
)
def first_per_key(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    first = ingest.keep_first(lines, ["l_suppkey", "day"], ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return first.drop("l_linenumber")


@query(
    "ingest_calendar_grid",
    f"""WITH {DAYS}, g AS (SELECT d.date, u.user_id FROM (SELECT DISTINCT date FROM days) d, (SELECT DISTINCT user_id FROM days) u)
    SELECT user_id, date, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS value
    FROM g LEFT JOIN days USING (user_id, date)""",
)
def calendar_grid(spark, sf_dir):
    return ingest.on_calendar_grid(tables.user_days(spark, sf_dir), "user_id", "date")


@query(
    "ingest_listing_range",
    f"""WITH {BARS}, {CALENDAR}, x AS (SELECT instrument, min(datetime) AS first_date, max(datetime) AS last_date FROM bars GROUP BY 1)
    SELECT instrument, first_date, last_date, a.date_idx AS first_idx, b.date_idx AS last_idx
    FROM x JOIN cal a ON a.datetime = first_date JOIN cal b ON b.datetime = last_date""",
)
def listing_range(spark, sf_dir):
    return ingest.listing_range(tables.closes(spark, sf_dir))


@query(
    "ingest_universe",
    f"WITH {BARS}, {UNIVERSE} SELECT instrument, datetime, close FROM bars SEMI JOIN uni USING (instrument)",
)
def in_universe(spark, sf_dir):
    return ingest.in_universe(tables.closes(spark, sf_dir), tables.universe(spark, sf_dir))


@query(
    "ingest_without_index_codes",
    "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE NOT ends_with(l_suppkey::VARCHAR, '00') AND NOT ends_with(l_suppkey::VARCHAR, '7') GROUP BY 1",
)
def without_index_codes(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").withColumn("symbol", F.col("l_suppkey").cast("string"))
    kept = ingest.without_index_codes(lines, ["00", "7"])
    return kept.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingest_append_new",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 10 = 5 THEN value ELSE value + 1000 END AS value FROM events""",
)
def append_new(spark, sf_dir):
    """Two overlapping batches; on common keys the stored row stays."""
    events = tables.table(spark, sf_dir, "events").select("event_id", "value")
    stored = events.where((F.col("event_id") % 2 == 0) | (F.col("event_id") % 10 == 5))
    batch = events.where((F.col("event_id") % 2 == 1) | (F.col("event_id") % 10 == 0))
    return ingest.append_new(stored, batch.withColumn("value", F.col("value") + 1000), ["event_id"])


@query(
    "ingest_time_coverage",
    f"""WITH {DAYS}, x AS (SELECT user_id, max(date) AS last_date FROM days GROUP BY 1)
    SELECT user_id, last_date, last_date >= DATE '2024-01-30' AS covered, CASE WHEN last_date < DATE '2024-01-30' THEN last_date + 1 END AS gap_start FROM x""",
)
def time_coverage(spark, sf_dir):
    return ingest.time_coverage(tables.user_days(spark, sf_dir), "2024-01-30", "user_id", "date")


_LATE = "SELECT DISTINCT l_suppkey AS instrument FROM lineitem WHERE l_shipdate < DATE '1995-02-01' AND l_suppkey % 3 <> 0"


def _early(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").where("l_shipdate < DATE '1995-02-01' AND l_suppkey % 3 <> 0")
    return lines.select(F.col("l_suppkey").alias("instrument"))


@query("ingest_missing_symbols", f"WITH {UNIVERSE} SELECT instrument FROM uni ANTI JOIN ({_LATE}) e USING (instrument)")
def missing_symbols(spark, sf_dir):
    return ingest.missing_symbols(tables.universe(spark, sf_dir), _early(spark, sf_dir))


@query("ingest_existing_symbols", f"WITH {UNIVERSE} SELECT instrument FROM uni SEMI JOIN ({_LATE}) e USING (instrument)")
def existing_symbols(spark, sf_dir):
    return ingest.existing_symbols(tables.universe(spark, sf_dir), _early(spark, sf_dir))


@query(
    "ingest_tradability",
    f"""WITH {BARS}, s AS (SELECT *, close / lag(close) OVER h - 1 AS ret, min(datetime) OVER (PARTITION BY instrument) AS first_date,
      avg(amount) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS liquidity,
      lead(open) OVER h / close - 1 AS gap FROM bars WINDOW {HISTORY})
    SELECT instrument, datetime, coalesce(ret >= 0.098::DOUBLE AND close >= high, false) AS at_upper_limit,
      coalesce(ret <= -0.098::DOUBLE AND close <= low, false) AS at_lower_limit, (datetime - first_date)::BIGINT AS listed_days,
      datetime - first_date >= 60 AS is_seasoned, coalesce(gap < 0.098::DOUBLE, false) AS next_open_buyable FROM s""",
)
def tradability(spark, sf_dir):
    return ingest.tradability(tables.bars(spark, sf_dir)).drop("liquidity")


@query(
    "ingest_tradable_universe",
    f"""WITH {BARS}, f AS (SELECT instrument, datetime, datetime - min(datetime) OVER (PARTITION BY instrument) >= 60 AS seasoned,
        avg(amount) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS liquidity,
        coalesce(lead(open) OVER h / close - 1 < 0.098::DOUBLE, false) AS buyable FROM bars WINDOW {HISTORY}),
      q AS (SELECT datetime, quantile_cont(liquidity, 0.2) AS floor FROM f GROUP BY 1)
    SELECT instrument, datetime FROM f JOIN q USING (datetime) WHERE seasoned AND buyable AND liquidity >= floor""",
)
def tradable_universe(spark, sf_dir):
    return ingest.tradable_universe(ingest.tradability(tables.bars(spark, sf_dir)))


# --- point in time --------------------------------------------------------------------


@query("pit_income_statement", f"WITH {INCOME} SELECT * FROM income")
def income_statement(spark, sf_dir):
    return tables.income(spark, sf_dir)


@query(
    "pit_typed_statement",
    """SELECT o_custkey::VARCHAR AS symbol, CAST(o_orderdate AS DATE) AS pub_date, CAST(o_orderdate AS DATE) AS rpt_date,
      o_totalprice AS net_prof, TRY_CAST(o_orderpriority AS DOUBLE) AS note, NULL::DOUBLE AS ttl_ast FROM orders""",
)
def typed_statement(spark, sf_dir):
    raw = tables.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("symbol"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"),
        F.col("o_orderdate").alias("rpt_date"),
        F.col("o_totalprice").cast("string").alias("net_prof"),
        F.col("o_orderpriority").alias("note"),
    )
    return pit.typed_statement(raw, ["net_prof", "note", "ttl_ast"])


@query(
    "pit_deduplicated",
    """SELECT o_custkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS pub_date, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS rpt_date,
      min(o_totalprice) AS net_prof FROM orders GROUP BY 1, 2, 3""",
)
def deduplicated(spark, sf_dir):
    quarter = F.to_date(F.trunc("o_orderdate", "quarter"))
    raw = tables.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("symbol"), quarter.alias("pub_date"), quarter.alias("rpt_date"), F.col("o_totalprice").alias("net_prof")
    )
    return pit.deduplicated(raw)


FULL = "fo AS (SELECT symbol, pub_date, rpt_date, net_prof, ttl_ast FROM income FULL JOIN balance USING (symbol, pub_date, rpt_date))"


def _statements(spark, sf_dir):
    """Both statements; the second repeats a column of the first, which must win."""
    second = tables.balance(spark, sf_dir).withColumn("net_prof", F.lit(-1.0))
    return pit.full_outer([tables.income(spark, sf_dir), second])


@query("pit_full_outer", f"WITH {INCOME}, {BALANCE}, {FULL} SELECT * FROM fo")
def full_outer(spark, sf_dir):
    return _statements(spark, sf_dir)


@query(
    "pit_stacked",
    f"WITH {INCOME}, {BALANCE} SELECT symbol, pub_date, rpt_date, net_prof, NULL::DOUBLE AS ttl_ast, 'income' AS _source FROM income UNION ALL SELECT symbol, pub_date, rpt_date, NULL, ttl_ast, 'balance' FROM balance",
)
def stacked(spark, sf_dir):
    income = tables.income(spark, sf_dir)
    return pit.stacked({"income": income.unionByName(income), "balance": tables.balance(spark, sf_dir)})


@query("pit_field_batches", f"WITH {INCOME}, {BALANCE}, {FULL} SELECT * FROM fo")
def field_batches(spark, sf_dir):
    return pit.merged_field_batches([tables.income(spark, sf_dir), tables.balance(spark, sf_dir)])


@query(
    "pit_as_of_join",
    f"""WITH {BARS}, {INCOME}, {BALANCE}, {FULL}
    SELECT b.symbol, b.date, b.close, pub_date, rpt_date, net_prof, ttl_ast
    FROM (SELECT instrument AS symbol, datetime AS date, close FROM bars) b ASOF LEFT JOIN fo ON b.symbol = fo.symbol AND b.date >= fo.pub_date""",
)
def as_of_join(spark, sf_dir):
    """Every bar with the latest statement published by then."""
    spine = tables.closes(spark, sf_dir).select(F.col("instrument").alias("symbol"), F.col("datetime").alias("date"), "close")
    return pit.as_of_join(spine, _statements(spark, sf_dir))


# --- quality --------------------------------------------------------------------------

_HOLES = "holes AS (SELECT instrument, datetime, open, CASE WHEN (instrument * 31 + month(datetime)) % 7 = 0 THEN NULL ELSE close END AS close, volume FROM bars)"


def _holes(spark, sf_dir):
    missing = (F.col("instrument") * 31 + F.month("datetime")) % 7 == 0
    return tables.bars(spark, sf_dir).select(
        "instrument", "datetime", "open", F.when(~missing, F.col("close")).alias("close"), "volume"
    )


@query("quality_coverage", f"WITH {BARS} SELECT count(DISTINCT instrument) AS symbol_count, min(datetime) AS min_date, max(datetime) AS max_date FROM bars")
def quality_coverage(spark, sf_dir):
    return quality.coverage(tables.closes(spark, sf_dir))


@query(
    "quality_missing",
    f"WITH {BARS}, {_HOLES} SELECT round((count(*) - count(close)) * 100.0 / count(*)::DOUBLE, 2) AS close_missing_pct, 0.0::DOUBLE AS open_missing_pct, 100.0::DOUBLE AS pe_ttm_missing_pct FROM holes",
)
def quality_missing(spark, sf_dir):
    return quality.missing_percent(_holes(spark, sf_dir), ["close", "open", "pe_ttm"])


@query(
    "quality_duplicates",
    "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
)
def quality_duplicates(spark, sf_dir):
    return quality.duplicate_count(tables.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "quality_column_summary",
    f"WITH {BARS}, {_HOLES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS total_rows, round((count(*) - count({c})) * 100.0 / count(*)::DOUBLE, 2) AS missing_pct, 0::BIGINT AS inf_count, "
        + (f"round(count({c}) * 100.0 / count(*)::DOUBLE, 2)" if c == "close" else "NULL::DOUBLE")
        + " AS financial_coverage FROM holes"
        for c in ("instrument", "datetime", "open", "close", "volume")
    ),
)
def quality_column_summary(spark, sf_dir):
    return quality.column_summary(_holes(spark, sf_dir), ["close"])


_CATEGORY_SQL = f"""cats AS (SELECT 'valuation' AS category, count(DISTINCT instrument) AS symbols FROM sup
  UNION ALL SELECT 'basic', count(*) FROM uni),
cov AS (SELECT category, symbols, round(symbols * 100.0::DOUBLE / (SELECT count(DISTINCT instrument) FROM bars), 1) AS coverage FROM cats)"""


def _categories(spark, sf_dir):
    return {"valuation": tables.supplement(spark, sf_dir), "basic": tables.universe(spark, sf_dir)}


@query("quality_category_coverage", f"WITH {SUPPLEMENT}, {UNIVERSE}, {_CATEGORY_SQL} SELECT * FROM cov")
def quality_category_coverage(spark, sf_dir):
    return quality.category_coverage(tables.closes(spark, sf_dir), _categories(spark, sf_dir))


@query(
    "quality_report",
    f"""WITH {SUPPLEMENT}, {UNIVERSE}, {_CATEGORY_SQL}, {INCOME}, {_HOLES},
    m AS (SELECT count(DISTINCT instrument) AS symbol_count, min(datetime) AS min_date, max(datetime) AS max_date,
      round((count(*) - count(close)) * 100.0 / count(*)::DOUBLE, 2) AS close_missing_pct, 0::BIGINT AS duplicate_count,
      (SELECT avg(coverage) FROM cov) AS feature_coverage, (SELECT count(DISTINCT symbol) FROM income) AS pit_symbols FROM holes)
    SELECT symbol_count, min_date, max_date, close_missing_pct, duplicate_count, {r('feature_coverage', 'feature_coverage')}, pit_symbols,
      round(least(symbol_count / 10.0::DOUBLE, 100) * 0.4::DOUBLE + feature_coverage * 0.3::DOUBLE + least(pit_symbols / 10.0::DOUBLE, 100) * 0.2::DOUBLE
        + (100 - close_missing_pct) * 0.1::DOUBLE)::BIGINT AS score FROM m""",
)
def quality_report(spark, sf_dir):
    return rounded(quality.quality_report(_holes(spark, sf_dir), _categories(spark, sf_dir), tables.income(spark, sf_dir)))


@query(
    "quality_export_diagnostics",
    f"""WITH {PANEL} SELECT count(*) AS n_rows, count(DISTINCT datetime) AS n_dates, count(DISTINCT instrument) AS n_symbols, min(datetime) AS first_date,
      max(datetime) AS last_date, round(count(label_1d) * 100.0 / count(*)::DOUBLE, 2) AS label_1d_valid_pct, round(count(label_5d) * 100.0 / count(*)::DOUBLE, 2) AS label_5d_valid_pct FROM panel""",
)
def quality_export_diagnostics(spark, sf_dir):
    labelled = labels.forward_returns(tables.closes(spark, sf_dir), (1, 5))
    return quality.export_diagnostics(labelled, ["label_1d", "label_5d"])
