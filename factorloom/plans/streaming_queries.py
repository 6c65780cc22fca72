"""Incremental ingest as a stream over the events table, in several micro-batches, run until all data is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.plans.oracle import BARS
from factorloom.plans.registry import query
from factorloom.sources import sinks
from factorloom.sources.shared import shared_folder, stored
from factorloom.sources.tables import bars, table
from factorloom.streaming import incremental

DELIVERIES = 3


def _run(spark, sf_dir, out: str, **coverage):
    """Deliver the events in three overlapping parts of all ages, one micro-batch for each, and stream them into a table.

    Every delivery spans the whole time range, so later ones bring rows older than the newest stored one.
    """
    events = table(spark, sf_dir, "events")
    for i in range(DELIVERIES):
        part = events.where((F.col("event_id") % DELIVERIES == i) | (F.col("event_id") % 10 == 0))
        part.write.parquet(f"{out}/inbox/delivery={i}")
    files = len(spark.read.parquet(f"{out}/inbox").inputFiles())
    stream = incremental.read_bars(spark, f"{out}/inbox", events.schema, files_per_trigger=-(-files // DELIVERIES))
    writer = incremental.write_first_arrivals(stream, f"{out}/table", f"{out}/checkpoint", ["event_id"], "ts", **coverage)
    writer.trigger(availableNow=True).start().awaitTermination()
    return incremental.stored_rows(spark, f"{out}/table", events.schema)


@query("stream_first_arrivals", "SELECT event_id, user_id, value, CAST(ts AS DATE) AS date FROM events")
def first_arrivals(spark, sf_dir):
    stored = _run(spark, sf_dir, shared_folder(spark, "arrivals"))
    return stored.select("event_id", "user_id", "value", F.to_date("ts").alias("date"))


@query("stream_coverage", "SELECT user_id, CAST(max(ts) AS DATE) AS last_date, count(*) AS n_events FROM events GROUP BY 1")
def coverage(spark, sf_dir):
    out = shared_folder(spark, "coverage")
    _run(spark, sf_dir, out, coverage_dir=f"{out}/coverage", key="user_id")
    merged = incremental.coverage(spark, f"{out}/coverage", "user_id")
    return merged.select("user_id", F.to_date("last_time").alias("last_date"), "n_events")


@query("sink_upserted_bars", f"WITH {BARS} SELECT instrument, datetime, close, volume FROM bars")
def upserted_bars(spark, sf_dir):
    """A table with outdated bars of 1995 and none of 1996 on, brought up to date by an increment that is merged twice."""
    current = stored(bars(spark, sf_dir).select("instrument", "datetime", "close", "volume"), "bars")
    path = shared_folder(spark, "upserted")
    year = F.year("datetime")
    outdated = F.when(year == 1995, -F.col("close")).otherwise(F.col("close"))
    sinks.write_by_year(current.where(year < 1996).withColumn("close", outdated), path)
    for _ in range(2):
        sinks.upsert_by_year(current.where(year >= 1995), path)
    return spark.read.parquet(path).drop("year")
