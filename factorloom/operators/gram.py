"""Linear models of all walk-forward windows from one pass over the rows.

A linear fit needs its training rows only through their moments: counts, sums, products of features, and products with the label. Moments
of disjoint row sets add up. So the dates are cut at all window boundaries into segments, one pass gives every segment's moment matrix,
a window's matrix is the sum of its segments, and any number of ridge, lasso or elastic-net models is solved from it. Rows
are neither copied per window nor read again per model, and nothing but coefficients reaches the driver.

Matrices are dealt by their rows: partial sums of a task leave as one vector per segment and matrix row, meet in two steps, and are
put together again per window. A window's matrix, of ``(features + 2) ** 2`` numbers, is the largest thing a task holds.

Missing feature values count as zero: transform features per date first, or let zero stand for them. A row without a finite label is not
trained on. Features are standardised inside each window; a constant one gets no weight.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factorloom.functions.frames import DATE, INSTRUMENT

#: Partial sums of this many groups of tasks are added up before they meet.
SLOTS = 64
#: Most rounds of the sparse solver, and the relative change below which it stops.
ROUNDS = 20_000
TOLERANCE = 1e-9

EPOCH = datetime.date(1970, 1, 1)
RANGES = {"train": ("train_start", "train_end"), "val": ("val_start", "val_end"), "oos": ("oos_start", "oos_end")}


def day(value) -> int:
    value = value.date() if isinstance(value, datetime.datetime) else value
    return (value - EPOCH).days


def window_days(windows: DataFrame) -> list[dict]:
    """``splits.walk_forward_windows`` as day numbers; their number is bounded by the calendar."""
    rows = windows.orderBy("window_id").collect()
    return [{"window_id": r.window_id, **{c: day(r[c]) for pair in RANGES.values() for c in pair}} for r in rows]


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """Features as columns, zero where they are missing or not finite."""
    x = np.empty((batch.num_rows, len(features)))
    for i, name in enumerate(features):
        x[:, i] = batch.column(name).to_numpy(zero_copy_only=False)
    return np.where(np.isfinite(x), x, 0.0)


def _rows(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    values = [F.col(f).cast("double").alias(f) for f in features]
    return rows.select(F.datediff(F.to_date(DATE), F.lit(EPOCH)).alias("_day"), DATE, INSTRUMENT, F.col(label).cast("double").alias("_label"), *values)


def segment_moments(rows: DataFrame, windows: list[dict], features: Sequence[str], label: str) -> DataFrame:
    """``line, segment, values``: line ``line`` of each segment's moment matrix of (1, features, label), summed over all tasks."""
    features, width = list(features), len(features) + 2
    rows = rows if windows else rows.where("false")
    cuts = np.array(sorted({d for w in windows for d in (w["train_start"], w["train_end"] + 1)}))
    used = [any(w["train_start"] <= cut <= w["train_end"] for w in windows) for cut in cuts]
    schema = "slot int, line int, segment int, values array<double>"
    arrow = pa.schema([("slot", pa.int32()), ("line", pa.int32()), ("segment", pa.int32()), ("values", pa.list_(pa.float64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, sums = TaskContext.get().partitionId() % SLOTS, {}
        for batch in batches:
            days, y = batch.column("_day").to_numpy(zero_copy_only=False), batch.column("_label").to_numpy(zero_copy_only=False)
            segments = np.where(np.isfinite(y) & np.isfinite(days), np.searchsorted(cuts, np.nan_to_num(days, nan=cuts[0] - 1), side="right") - 1, -1)
            table = np.column_stack([np.ones(batch.num_rows), _matrix(batch, features), np.nan_to_num(y)])
            for s in np.unique(segments):
                if s >= 0 and used[s]:
                    part = table[segments == s]
                    sums[s] = sums.get(s, 0) + part.T @ part
        for s, matrix in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([slot] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([int(s)] * width, pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))],
                schema=arrow,
            )

    def added(keys: list[str]):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            # The order of arrival would change last digits.
            part = part.sort_values("values", key=lambda v: v.map(tuple))
            out = part.groupby(keys, sort=True)["values"].agg(lambda v: np.sum(np.stack(v.to_list()), axis=0)).reset_index()
            out["slot"] = 0
            return out[["slot", "line", "segment", "values"]]

        return run

    summed = _rows(rows, features, label).mapInArrow(partial, schema)
    summed = summed.groupBy("line", "slot").applyInPandas(added(["line", "segment"]), schema)
    return summed.groupBy("line").applyInPandas(added(["line", "segment"]), schema).drop("slot")


def window_moments(moments: DataFrame, windows: list[dict]) -> DataFrame:
    """``window_id, line, values``: each window's matrix, the sum of the segments in its training range."""
    cuts = sorted({d for w in windows for d in (w["train_start"], w["train_end"] + 1)})
    inside = {w["window_id"]: {i for i, cut in enumerate(cuts) if w["train_start"] <= cut <= w["train_end"]} for w in windows}

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        found = dict(zip(part["segment"], part["values"]))
        rows = []
        for window_id, segments in inside.items():
            held = [found[s] for s in sorted(segments) if s in found]
            if held:
                rows.append((window_id, int(part["line"].iloc[0]), np.sum(held, axis=0)))
        return pd.DataFrame(rows, columns=["window_id", "line", "values"])

    return moments.groupBy("line").applyInPandas(merged, "window_id long, line int, values array<double>")


def _sparse(gram: np.ndarray, target: np.ndarray, limit: float) -> np.ndarray:
    """The ``b`` that minimises ``b' gram b / 2 - target' b + limit * |b|``.

    Alternating directions find which coefficients are not zero, with one factorisation for all rounds; given these and their
    signs, the rest is a linear system, whose solution is taken if it meets the conditions of the minimum.
    """
    width = len(target)
    step = max(float(np.trace(gram)) / width, 1e-12)
    inverse = np.linalg.inv(gram + step * np.eye(width))
    kept, dual = np.zeros(width), np.zeros(width)
    for i in range(ROUNDS):
        free = inverse @ (target + step * (kept - dual))
        moved, kept = kept, np.sign(free + dual) * np.maximum(np.abs(free + dual) - limit / step, 0.0)
        dual += free - kept
        if max(np.abs(free - kept).max(), np.abs(kept - moved).max()) < TOLERANCE * max(np.abs(kept).max(), limit):
            break
    active = kept != 0
    exact = np.zeros(width)
    exact[active] = np.linalg.lstsq(gram[np.ix_(active, active)], target[active] - limit * np.sign(kept[active]), rcond=1e-12)[0]
    slopes = target - gram @ exact
    holds = np.all(np.sign(exact[active]) == np.sign(kept[active])) and np.all(np.abs(slopes) <= limit * (1 + 1e-6))
    return exact if holds else kept


def elastic_net_from_moments(matrix: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """Intercept and coefficients that minimise ``RSS / 2n + alpha * (l1_ratio * |b| + (1 - l1_ratio) / 2 * b * b)`` on standardised features.

    Without an absolute penalty that is a linear system, of which the least-norm solution is taken.
    """
    n, width = matrix[0, 0], len(matrix) - 2
    mean = matrix[0, 1:-1] / n
    label_mean = matrix[0, -1] / n
    covariance = matrix[1:-1, 1:-1] / n - np.outer(mean, mean)
    # As in the estimators of MLlib, features are scaled by the sample standard deviation.
    spread = np.sqrt(np.maximum(np.diag(covariance), 0) * n / max(n - 1, 1))
    varies = spread > 1e-9 * np.maximum(np.abs(mean), 1e-12)
    scale = np.where(varies, spread, 1.0)
    gram = covariance / np.outer(scale, scale) * np.outer(varies, varies)
    target = (matrix[1:-1, -1] / n - mean * label_mean) / scale * varies
    limit, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
    if limit == 0:
        beta = np.linalg.lstsq(gram + ridge * np.eye(width), target, rcond=1e-12)[0]
    else:
        beta = _sparse(gram + ridge * np.eye(width), target, limit)
    weights = beta / scale
    return np.concatenate([[label_mean - weights @ mean], weights])


def window_models(rows: DataFrame, windows: list[dict], features: Sequence[str], label: str, models: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``window_id, model, n, weights`` of every window and ``{model: (alpha, l1_ratio)}``; weights start with the intercept."""
    width, models = len(features) + 2, dict(models)

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.zeros((width, width))
        for line, values in zip(part["line"], part["values"]):
            matrix[line] = values
        found = [
            (part["window_id"].iloc[0], name, int(matrix[0, 0]), elastic_net_from_moments(matrix, alpha, l1))
            for name, (alpha, l1) in models.items()
        ]
        return pd.DataFrame(found, columns=["window_id", "model", "n", "weights"])

    moments = window_moments(segment_moments(rows, windows, features, label), windows)
    return moments.groupBy("window_id").applyInPandas(solved, "window_id long, model string, n long, weights array<double>")


def window_predictions(rows: DataFrame, windows: list[dict], features: Sequence[str], label: str, fitted: DataFrame) -> DataFrame:
    """``model, window_id, role, datetime, instrument, label, prediction`` of all rows in validation and out-of-sample ranges.

    ``fitted`` has a row per window and model, which the driver reads: windows are bounded by the calendar.
    """
    features, ranges = list(features), {w["window_id"]: w for w in windows}
    weights = [(r.model, r.window_id, np.array(r.weights)) for r in fitted.orderBy("window_id", "model").collect()]
    source = _rows(rows, features, label)
    out = source.select(F.lit("").alias("model"), F.lit(0).cast("long").alias("window_id"), F.lit("").alias("role"), DATE, INSTRUMENT, F.col("_label").alias(label), F.lit(0.0).alias("prediction"))
    arrow = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            days, x = batch.column("_day").to_numpy(zero_copy_only=False), _matrix(batch, features)
            for model, window_id, w in weights:
                for role in ("val", "oos"):
                    first, last = (ranges[window_id][c] for c in RANGES[role])
                    at = np.flatnonzero((days >= first) & (days <= last))
                    if len(at):
                        kept = batch.take(pa.array(at))
                        columns = [pa.array([v] * len(at)) for v in (model, window_id, role)]
                        columns += [kept.column(c) for c in (DATE, INSTRUMENT, "_label")]
                        values = [*columns, pa.array(w[0] + x[at] @ w[1:])]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(values, arrow)], schema=arrow)

    return source.mapInArrow(run, out.schema)


def walk_forward(rows: DataFrame, windows: DataFrame, features: Sequence[str], label: str, models: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Predictions of all models in all windows. ``rows`` should be stored: it is read once to fit and once to predict."""
    days = window_days(windows)
    return window_predictions(rows, days, features, label, window_models(rows, days, features, label, models))
