"""Data-quality measures, each from one aggregation over the whole table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.frames import DATE, INSTRUMENT
from factorloom.functions.numeric import div

# Expected number of symbols and the weights of the overall score.
EXPECTED_SYMBOLS = 1000
SCORE_WEIGHTS = {"ohlcv": 0.4, "features": 0.3, "pit": 0.2, "missing": 0.1}


def coverage(df: DataFrame, key: str = INSTRUMENT, date: str = DATE) -> DataFrame:
    return df.agg(
        F.count_distinct(key).alias("symbol_count"), F.min(date).alias("min_date"), F.max(date).alias("max_date")
    )


def _missing(c: Column, dtype: str) -> Column:
    return (c.isNull() | F.isnan(c)) if dtype in ("double", "float") else c.isNull()


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(div(part * 100.0, whole), F.lit(0.0)), 2)


def missing_percent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``{column}_missing_pct``: 100 for an absent column, 0 for an empty table."""
    types, rows = dict(df.dtypes), F.count(F.lit(1))
    out = []
    for c in columns:
        share = _percent(F.count(F.when(_missing(F.col(c), types[c]), 1)), rows) if c in types else (
            F.when(rows > 0, 100.0).otherwise(0.0)
        )
        out.append(share.alias(f"{c}_missing_pct"))
    return df.agg(*out)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first on the same key."""
    if not all(k in df.columns for k in keys):
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicate_count"))
    per_key = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return per_key.agg(F.coalesce(F.sum("_extra"), F.lit(0).cast("bigint")).alias("duplicate_count"))


def column_summary(df: DataFrame, financial: Sequence[str] = ()) -> DataFrame:
    """Per column: missing percent, infinite count and, for financial fields, the covered percent."""
    types, rows = dict(df.dtypes), F.count(F.lit(1))
    infinite = {
        c: F.count(F.when(F.abs(c) == float("inf"), 1)) if t in ("double", "float") else F.lit(0).cast("bigint")
        for c, t in types.items()
    }
    stats = df.agg(
        rows.alias("_rows"),
        *[F.count(F.when(_missing(F.col(c), t), 1)).alias(f"m_{c}") for c, t in types.items()],
        *[infinite[c].alias(f"i_{c}") for c in types],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("total_rows"),
            _percent(F.col(f"m_{c}"), F.col("_rows")).alias("missing_pct"),
            F.col(f"i_{c}").alias("inf_count"),
            (_percent(F.col("_rows") - F.col(f"m_{c}"), F.col("_rows")) if c in financial else F.lit(None).cast("double"))
            .alias("financial_coverage"),
        )
        for c in types
    ]
    return stats.select(F.inline(F.array(*entries)))


def category_coverage(base: DataFrame, categories: dict[str, DataFrame], key: str = INSTRUMENT) -> DataFrame:
    """Share of the base table's symbols that appear in each category."""
    tagged = [
        df.select(key).distinct().select(F.lit(name).alias("category"), key) for name, df in categories.items()
    ]
    total = base.agg(F.count_distinct(key)).scalar()
    # A category's symbols count as in the export directory, whether or not the base has them.
    present = reduce(DataFrame.unionByName, tagged).groupBy("category").agg(F.count(F.lit(1)).alias("symbols"))
    return present.select("category", "symbols", F.round(div(F.col("symbols") * 100.0, total), 1).alias("coverage"))


def quality_score(
    symbols: Column, feature_coverage: Column, pit_symbols: Column, missing_pct: Column, expected: int = EXPECTED_SYMBOLS
) -> Column:
    """Overall score 0..100 from symbol counts, feature coverage and missing closes."""
    share = lambda c: F.least(c * 100.0 / expected, F.lit(100.0))
    w = SCORE_WEIGHTS
    return F.bround(
        share(symbols) * w["ohlcv"]
        + feature_coverage * w["features"]
        + share(pit_symbols) * w["pit"]
        + (100 - missing_pct) * w["missing"],
        0,
    ).cast("bigint")


def quality_report(
    bars: DataFrame, categories: dict[str, DataFrame], statements: DataFrame, key: str = INSTRUMENT, date: str = DATE
) -> DataFrame:
    """Coverage, missing closes, duplicates and the overall score, over all rows rather than a sample."""
    features = category_coverage(bars, categories, key).agg(F.avg("coverage"))
    measures = {
        "close_missing_pct": missing_percent(bars, ["close"]),
        "duplicate_count": duplicate_count(bars, [key, date]),
        "feature_coverage": features,
        "pit_symbols": statements.agg(F.count_distinct("symbol")),
    }
    report = coverage(bars, key, date).withColumns({name: df.scalar() for name, df in measures.items()})
    return report.withColumn(
        "score",
        quality_score(F.col("symbol_count"), F.col("feature_coverage"), F.col("pit_symbols"), F.col("close_missing_pct")),
    )


def export_diagnostics(panel: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows, dates, symbols, date range and the valid percent of each label."""
    rows = F.count(F.lit(1))
    return panel.agg(
        rows.alias("n_rows"),
        F.count_distinct(DATE).alias("n_dates"),
        F.count_distinct(INSTRUMENT).alias("n_symbols"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        *[_percent(F.count(c), rows).alias(f"{c}_valid_pct") for c in labels],
    )
