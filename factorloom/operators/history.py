"""Splitting a long instrument history into blocks that overlap by the window length.

A plain window puts an instrument's whole history into one task. Where one instrument may
hold a large share of all rows (intraday bars), number its rows without a single ordered
pass, cut them into blocks, and copy the last rows of each block into the next one, so that
every trailing frame is complete inside its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from factorloom.functions.frames import DATE, INSTRUMENT


def number_rows(df: DataFrame, period: Column, key: str = INSTRUMENT, order: str = DATE, index: str = "t") -> DataFrame:
    """0-based row number of each key, in ``order``.

    ``period`` is a coarse, non-decreasing function of ``order`` (a month, say): rows are
    numbered inside a period, and the counts of earlier periods are added.
    """
    rows = df.withColumn("_period", period)
    counts = rows.groupBy(key, "_period").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(key).orderBy("_period")) - F.col("_n")
    starts = counts.select(key, "_period", earlier.alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, "_period").orderBy(order))
    return (
        rows.withColumn("_inside", inside)
        .join(starts, [key, "_period"])
        .withColumn(index, F.col("_start") + F.col("_inside") - 1)
        .drop("_period", "_inside", "_start")
    )


def overlapping_blocks(df: DataFrame, block_rows: int, before: int, after: int = 0, index: str = "t") -> DataFrame:
    """Assign each row to its block, and copy it to every block whose frames reach it.

    Frames reach ``before`` rows back and ``after`` rows ahead. Own rows have ``_own`` true;
    drop the copies with ``own_rows`` once the windows are computed.
    """
    row = F.col(index)
    first = F.greatest(F.floor((row - after) / block_rows), F.lit(0).cast("bigint"))
    last = F.floor((row + before) / block_rows)
    blocks = df.withColumn("_block", F.explode(F.sequence(first, last)))
    return blocks.withColumn("_own", F.col("_block") == F.floor(row / block_rows))


def block_window(key: str = INSTRUMENT, index: str = "t") -> WindowSpec:
    return Window.partitionBy(key, "_block").orderBy(index)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_block", "_own")
