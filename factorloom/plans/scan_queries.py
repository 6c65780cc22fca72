"""Running values of long histories from block summaries, beside the plain windows they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.numeric import rounded
from factorloom.operators import book, ingest, scans, tearsheet
from factorloom.operators.history import number_rows
from factorloom.plans import ingest_queries, portfolio_queries  # noqa: F401
from factorloom.plans.oracle import r
from factorloom.plans.registry import QUERIES, query
from factorloom.sources import tables

# Lines of a return flag, in the order of their keys: three histories, one of which has half of all rows.
_TICKS = """tk AS (SELECT l_returnflag AS flag, l_orderkey * 8 + l_linenumber AS seq, max(CASE WHEN l_quantity > 25 THEN l_extendedprice END) AS price,
  max(CASE WHEN l_linenumber <> 3 THEN l_discount / 100 END) AS ret FROM lineitem GROUP BY 1, 2)"""


def _ticks(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")
    return lines.groupBy(F.col("l_returnflag").alias("flag"), seq).agg(
        F.max(F.when(F.col("l_quantity") > 25, F.col("l_extendedprice"))).alias("price"),
        F.max(F.when(F.col("l_linenumber") != 3, F.col("l_discount") / 100)).alias("ret"),
    )


def _blocks(rows: int = 4096):
    return F.floor(F.col("seq") / rows)


@query(
    "scan_running_values",
    f"""WITH {_TICKS} SELECT flag, seq, {r('last_value(price IGNORE NULLS) OVER w', 'last_price')}, {r('max(price) OVER w', 'highest')},
      count(price) OVER w AS known, {r('lag(ret) OVER h', 'previous_ret')}, {r('exp(sum(ln(1 + ret)) OVER w - 8 * round(sum(ln(1 + ret)) OVER w / 8))', 'growth')}
    FROM tk WINDOW h AS (PARTITION BY flag ORDER BY seq), w AS (PARTITION BY flag ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
)
def running_values(spark, sf_dir):
    """Fill, maximum, count, lag and a compounded return (its logarithm, folded into a fixed range) of three long histories."""
    wanted = {
        "last_price": scans.last_known("price", "seq"),
        "highest": scans.maximum(F.col("price")),
        "known": scans.total(F.when(F.col("price").isNotNull(), 1).otherwise(0)),
        "previous_ret": scans.previous(F.col("ret"), "seq"),
        "_log": scans.total(F.log1p("ret")),
    }
    found = scans.running(_ticks(spark, sf_dir), wanted, ["flag"], "seq", _blocks())
    growth = F.exp(F.col("_log") - 8 * F.round(F.col("_log") / 8))
    return rounded(found.select("flag", "seq", "last_price", "highest", "known", "previous_ret", growth.alias("growth")))


# The SQL side looks back over a thousand rows at least; what is older weighs less than 1e-40.
_SPAN, _REACH = 20, 1000


@query(
    "scan_decayed_mean",
    f"""WITH {_TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY seq) - 1 AS t FROM tk),
    p AS (SELECT flag, t // {_REACH} AS b, t % {_REACH} AS i, seq, price, pow({_SPAN + 1} / {_SPAN - 1}.0::DOUBLE, t % {_REACH}) AS g FROM n),
    s AS (SELECT *, sum(price * g) OVER w / g AS num, sum(g) FILTER (WHERE price IS NOT NULL) OVER w / g AS den FROM p
          WINDOW w AS (PARTITION BY flag, b ORDER BY i ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT flag, b + 1 AS b, num AS num0, den AS den0 FROM s WHERE i = {_REACH} - 1)
    SELECT flag, seq, {r(f'(coalesce(num, 0) + coalesce(num0, 0) * pow({_SPAN - 1} / {_SPAN + 1}.0::DOUBLE, i + 1)) / nullif(coalesce(den, 0) + coalesce(den0, 0) * pow({_SPAN - 1} / {_SPAN + 1}.0::DOUBLE, i + 1), 0)', 'mean', 3)}
    FROM s LEFT JOIN e USING (flag, b)""",
)
def decayed_mean(spark, sf_dir):
    """Exponential mean of the known prices of three long histories."""
    rows = number_rows(_ticks(spark, sf_dir), _blocks(), "flag", "seq")
    return rounded(scans.decayed_means(rows, {"mean": ("price", _SPAN)}, ["flag"]).select("flag", "seq", "mean"), 3)


@query("ingest_forward_fill_blocked", QUERIES["ingest_forward_fill"].sql)
def forward_fill(spark, sf_dir):
    joined = ingest.with_supplements(tables.closes(spark, sf_dir), [tables.supplement(spark, sf_dir)])
    return ingest.forward_fill(joined, ["turnrate"], block=F.year("datetime"))


@query("tearsheet_price_paths_blocked", QUERIES["tearsheet_price_paths"].sql)
def price_paths(spark, sf_dir):
    held = F.when((F.col("instrument") + F.col("date_idx")) % 11 != 0, "held")
    returns = portfolio_queries._returns(spark, sf_dir).withColumn("hold_contract", held)
    return rounded(tearsheet.price_paths(returns, held="hold_contract", block=F.year("datetime")))


@query(
    "book_drawdown_blocked",
    f"""WITH {portfolio_queries.RETURNS}, c AS (SELECT instrument, datetime, product(1 + ret) OVER w AS cumulative FROM ret WHERE ret IS NOT NULL
      WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS UNBOUNDED PRECEDING))
    SELECT instrument, datetime, {r('cumulative', 'cumulative')},
      {r('cumulative / max(cumulative) OVER (PARTITION BY instrument ORDER BY datetime ROWS UNBOUNDED PRECEDING) - 1', 'drawdown')} FROM c""",
)
def drawdown(spark, sf_dir):
    """Cumulative return and drawdown of every instrument, in yearly blocks."""
    series = portfolio_queries._returns(spark, sf_dir).select("instrument", "datetime", "ret")
    by, block = ["instrument"], F.year("datetime")
    path = book.drawdown(book.cumulative(series, "ret", by, block=block), by=by, block=block)
    return rounded(path.select("instrument", "datetime", "cumulative", "drawdown"))
