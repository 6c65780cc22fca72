"""The panel most queries start from: eight factors, forward returns and the close, per bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import factors, labels
from factorloom.operators.xsection import to_long
from factorloom.plans.oracle import BARS, HISTORY, frame, full
from factorloom.sources.tables import bars

FACTORS = ["KMID", "KSFT", "ROC5", "MA5", "STD5", "ROC20", "MA20", "STD20"]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = labels.with_forward_returns(bars(spark, sf_dir), (1, 5))
    shapes = factors.bar_shape()
    return factors.rolling_factors(
        labelled,
        [factors.trend],
        (5, 20),
        keep=("instrument", "datetime", "close", "amount", "label_1d", "label_5d"),
        row_factors={n: shapes[n] for n in ("KMID", "KSFT")},
    )


def long_panel(spark: SparkSession, sf_dir: str, names: list[str] = FACTORS, label: str = "label_1d") -> DataFrame:
    """``(datetime, instrument, label, factor, value)``."""
    labelled = panel(spark, sf_dir).withColumn("label", F.col(label))
    return to_long(labelled, names, ["label"])


def _trend(w: int) -> str:
    return (
        f"close / lag(close, {w}) OVER h - 1 AS ROC{w}, "
        f"({full('avg(close)', 'close', f'w{w}', w)}) / close - 1 AS MA{w}, "
        f"({full('stddev_samp(close)', 'close', f'w{w}', w)}) / close AS STD{w}"
    )


PANEL = f"""{BARS},
panel AS (
  SELECT instrument, datetime, close, amount, lead(close, 1) OVER h / close - 1 AS label_1d, lead(close, 5) OVER h / close - 1 AS label_5d,
         (close - open) / (open + 1e-8) AS KMID, (close - low) / (high - low + 1e-8) AS KSFT, {_trend(5)}, {_trend(20)}
  FROM bars WINDOW {HISTORY}, {frame('w5', 5)}, {frame('w20', 20)})"""


def long_sql(names: list[str] = FACTORS, label: str = "label_1d", name: str = "long") -> str:
    rows = " UNION ALL ".join(
        f"SELECT datetime, instrument, '{f}' AS factor, {f} AS value, {label} AS label FROM panel" for f in names
    )
    return f"{PANEL},\n{name} AS ({rows})"
