"""Window specifications over one instrument's history.

A per-instrument window puts one instrument's rows into one task. That is bounded by
the calendar, because a de-duplicated panel has at most one row per instrument and
date; ``factorloom.operators.history`` splits longer histories into blocks.
Cross-sections are not bounded that way and never use a window here (see ``ranks``).
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INSTRUMENT = "instrument"
DATE = "datetime"


def history(*keys: str, order: str = DATE) -> WindowSpec:
    """All rows of one instrument in date order."""
    return Window.partitionBy(*(keys or (INSTRUMENT,))).orderBy(order)


def trailing(spec: WindowSpec, rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` before it."""
    return spec.rowsBetween(-(rows - 1), Window.currentRow)


def so_far(spec: WindowSpec) -> WindowSpec:
    """Everything up to and including the current row."""
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def full(aggregate: Column, observed: Column, frame: WindowSpec, rows: int) -> Column:
    """The aggregate over the frame, null until ``rows`` non-null observations are in it."""
    return F.when(F.count(observed).over(frame) >= rows, aggregate.over(frame))
