"""A linear scorer trained on pairs of names of the same date, without making the pairs.

Each date's labels fall into ordinal bins. A pair of names with different bins should be scored with the better one ahead by at least
one: the loss of a pair is the square of what is missing, and every date counts the same however many pairs it holds. What all names of a
date share cancels out, so neither features nor labels need a common level over time.

Pairs are never made. What a row has to do with all its partners is a count and a sum of their scores, which are prefix sums over the
date's rows in score order; rows enter them as counts per (date, bin, score cell), added up before the shuffle, so a date of any size is a
bounded table. Only whether a pair is still short of its margin is judged by cells, ``1 / CELLS`` wide: there its loss is nearly zero.

Training solves a linear system with the moment matrix of all pairs, found in one pass, and then corrects it round by round with the
gradient of the pairs still short of the margin. That matrix bounds the curvature of the loss, so no round makes it worse.

Defined cases: missing features count as zero before standardising; rows without a label, and dates with fewer than ``min_names``
labels or with one bin only, teach nothing; a constant feature gets no weight; without any pair all weights are zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.frames import DATE, INSTRUMENT
from factorloom.functions.numeric import div, finite
from factorloom.functions.ranks import with_average_ranks
from factorloom.operators.gram import SLOTS
from factorloom.operators.labels import rank_label
from factorloom.sources.shared import stored

#: Cells per margin, and the most standard deviations that a feature value may lie from its mean.
CELLS = 64
REACH = 8.0
#: Most distinct labels that concordance takes.
MOST_LABELS = 100


@dataclass(frozen=True)
class LinearScorer:
    """Weights of standardised features; what training saw of each feature is part of the model."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]

    def standardised(self) -> dict[str, Column]:
        return {
            f: F.greatest(F.lit(-REACH), F.least(F.lit(REACH), (F.coalesce(finite(F.col(f)), F.lit(0.0)) - m) / s))
            for f, m, s in zip(self.features, self.means, self.scales)
        }

    def score(self) -> Column:
        return _weighted(self.standardised(), self.weights)


def _weighted(values: dict[str, Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * v for v, w in zip(values.values(), weights)], F.lit(0.0))


def weighted_gram(rows: DataFrame, weight: str, features: Sequence[str]) -> np.ndarray:
    """The sum of ``weight * x x'`` over all rows; partial matrices per task meet line by line in two steps."""
    features = list(features)
    schema = "slot int, line int, values array<double>"
    arrow = pa.schema([("slot", pa.int32()), ("line", pa.int32()), ("values", pa.list_(pa.float64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, total = TaskContext.get().partitionId() % SLOTS, np.zeros((len(features), len(features)))
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            total += x.T @ (x * batch.column(weight).to_numpy(zero_copy_only=False)[:, None])
        lines = range(len(features))
        yield pa.RecordBatch.from_arrays(
            [pa.array([slot] * len(features), pa.int32()), pa.array(lines, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=arrow
        )

    def added(part: pd.DataFrame) -> pd.DataFrame:
        # The order of arrival would change last digits.
        values = sorted(map(tuple, part["values"]))
        return pd.DataFrame({"slot": [0], "line": [part["line"].iloc[0]], "values": [np.sum(values, axis=0)]})

    summed = rows.select(weight, *features).mapInArrow(partial, schema).groupBy("line", "slot").applyInPandas(added, schema)
    lines = {r.line: r["values"] for r in summed.groupBy("line").applyInPandas(added, schema).collect()}
    return np.array([lines[i] for i in range(len(features))]) if lines else np.zeros((len(features), len(features)))


def _pairs_matrix(rows: DataFrame, features: Sequence[str]) -> np.ndarray:
    """The sum of ``(x - y) (x - y)'`` over all pairs of different bins, each date divided by its number of pairs.

    With n rows in a date, n_b of them in bin b, that is the rows' products weighted by ``n - n_b``, less the products of the
    date's sum, plus those of the bins' sums: three kinds of rows in one weighted matrix.
    """
    date, sums = Window.partitionBy(DATE), {f: F.sum(f).alias(f) for f in features}
    bins = rows.groupBy(DATE, "_bin").agg(F.count(F.lit(1)).alias("_n"), *sums.values())
    bins = bins.withColumn("_all", F.sum("_n").over(date))
    pairs = (F.col("_all") * F.col("_all") - F.sum(F.col("_n") * F.col("_n")).over(date)) / 2
    bins = stored(bins.withColumn("_pairs", pairs).where("_pairs > 0"), "bins")
    own = bins.select(DATE, "_bin", ((F.col("_all") - F.col("_n")) / F.col("_pairs")).alias("_w"))
    # One row per date and bin; a join by date alone would meet hot dates.
    of_rows = rows.join(own, [DATE, "_bin"]).select("_w", *features)
    of_bins = bins.select((1 / F.col("_pairs")).alias("_w"), *features)
    of_dates = bins.groupBy(DATE).agg((-1 / F.first("_pairs")).alias("_w"), *sums.values()).drop(DATE)
    return weighted_gram(of_rows.unionByName(of_bins).unionByName(of_dates), "_w", features)


def pair_pulls(scored: DataFrame, bins: int) -> DataFrame:
    """``datetime, _bin, _cell, _a, _b``: a row of this bin, cell and score s has the derivative ``_a + _b * s`` of its date's mean pair loss.

    ``scored`` has ``datetime, _bin, _score``. Counts and sums per cell are all that is shuffled.
    """
    cells = scored.groupBy(DATE, _cell().alias("_cell")).agg(
        *[F.count(F.when(F.col("_bin") == b, 1)).alias(f"_n{b}") for b in range(bins)],
        *[F.coalesce(F.sum(F.when(F.col("_bin") == b, F.col("_score"))), F.lit(0.0)).alias(f"_s{b}") for b in range(bins)],
    )
    date = Window.partitionBy(DATE)
    order = date.orderBy("_cell")
    reached = order.rangeBetween(Window.unboundedPreceding, CELLS - 1)
    passed = order.rangeBetween(Window.unboundedPreceding, -CELLS)
    columns = [f"_{k}{b}" for k in "ns" for b in range(bins)]
    staged = cells.withColumns(
        {
            # Better names that are not a margin ahead, and worse ones that are not a margin behind.
            **{f"{c}_ahead": F.coalesce(F.sum(c).over(reached), F.lit(0)) for c in columns},
            **{f"{c}_behind": F.sum(c).over(date) - F.coalesce(F.sum(c).over(passed), F.lit(0)) for c in columns},
            **{f"_t{b}": F.sum(f"_n{b}").over(date) for b in range(bins)},
        }
    )
    total = reduce(lambda a, b: a + b, [F.col(f"_t{b}") for b in range(bins)])
    pairs = (total * total - reduce(lambda a, b: a + b, [F.col(f"_t{b}") * F.col(f"_t{b}") for b in range(bins)])) / 2

    def pulls(own: int) -> Column:
        zero = F.lit(0.0)
        better = [reduce(lambda a, b: a + b, [F.col(f"_{k}{b}_ahead") for b in range(own + 1, bins)], zero) for k in "ns"]
        worse = [reduce(lambda a, b: a + b, [F.col(f"_{k}{b}_behind") for b in range(own)], zero) for k in "ns"]
        a = better[0] - worse[0] - better[1] - worse[1]
        return F.struct(F.lit(own).cast("bigint").alias("_bin"), div(a, pairs).alias("_a"), div(better[0] + worse[0], pairs).alias("_b"), F.col(f"_n{own}").alias("_n"))

    each = staged.select(DATE, "_cell", F.explode(F.array(*[pulls(b) for b in range(bins)])).alias("_p"))
    return each.where("_p._n > 0 AND _p._a IS NOT NULL").select(DATE, "_cell", "_p._bin", "_p._a", "_p._b")


def _cell() -> Column:
    return F.floor(F.col("_score") * CELLS)


def gradient(rows: DataFrame, features: Sequence[str], weights: Sequence[float], bins: int) -> np.ndarray:
    """Gradient of the loss summed over dates at ``weights``: one number per feature reaches the driver."""
    scored = rows.withColumn("_score", _weighted({f: F.col(f) for f in features}, weights)).withColumn("_cell", _cell())
    pulled = scored.join(pair_pulls(scored, bins), [DATE, "_bin", "_cell"])
    pull = F.col("_a") + F.col("_b") * F.col("_score")
    found = pulled.agg(*[F.sum(pull * F.col(f)).alias(f) for f in features]).first()
    return np.array([found[f] or 0.0 for f in features])


def pairwise_scorer(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    bins: int = 5,
    min_names: int = 10,
    ridge: float = 1e-3,
    rounds: int = 12,
    tolerance: float = 1e-3,
) -> LinearScorer:
    """Train the scorer. ``ridge`` is the penalty on squared weights, relative to one date's mean loss of a pair."""
    features = list(features)
    clean = train.select(DATE, INSTRUMENT, label, *[F.coalesce(finite(F.col(f)), F.lit(0.0)).alias(f) for f in features])
    labelled = rank_label(clean, label, bins, min_names, "_bin").where(F.col("_bin").isNotNull())
    labelled = stored(labelled.select(DATE, "_bin", *features), "labelled")
    moments = labelled.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    means = [moments[f"m_{f}"] or 0.0 for f in features]
    spreads = [moments[f"s_{f}"] or 0.0 for f in features]
    varies = np.array([s > 1e-9 * max(abs(m), 1e-12) for m, s in zip(means, spreads)])
    scales = [s if v else 1.0 for s, v in zip(spreads, varies)]
    model = LinearScorer(tuple(features), tuple(means), tuple(scales), (0.0,) * len(features))
    rows = stored(labelled.select(DATE, "_bin", *[c.alias(f) for f, c in model.standardised().items()]), "standardised")

    dates = rows.select(DATE).distinct().count()
    curvature = _pairs_matrix(rows, features) * np.outer(varies, varies)
    penalty = ridge * max(dates, 1)
    weights = np.zeros(len(features))
    for _ in range(rounds):
        slopes = gradient(rows, features, weights, bins) * varies + penalty * weights
        step = np.linalg.solve(curvature + penalty * np.eye(len(features)), slopes)
        weights = weights - step
        if np.abs(step).max() <= tolerance * max(np.abs(weights).max(), 1e-12):
            break
    return LinearScorer(model.features, model.means, model.scales, tuple(float(w) for w in weights))


def predict(model: LinearScorer, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(datetime, instrument, *keep, prediction)``."""
    return rows.select(DATE, INSTRUMENT, *keep, model.score().alias("prediction"))


def concordance(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """``datetime, n_pairs, concordance``: the share of a date's pairs of different labels whose better name is scored higher.

    Equal scores count half. Rows with a missing label or score do not count. ``label`` holds few distinct values: for each, the
    names that hold it win as often as their ranks among all names not better exceed their ranks among themselves.
    """
    held = scored.select(DATE, F.col(label).alias("_l"), finite(F.col(prediction)).alias("_s")).where("_l IS NOT NULL AND _s IS NOT NULL")
    held = stored(held, "scored")
    sizes = held.groupBy(DATE, "_l").agg(F.count(F.lit(1)).alias("_n"))
    values = sorted(r[0] for r in sizes.select("_l").distinct().limit(MOST_LABELS + 1).collect())
    if len(values) > MOST_LABELS:
        raise ValueError(f"{label} holds more than {MOST_LABELS} values")
    worse = F.sum("_n").over(Window.partitionBy(DATE).orderBy("_l")) - F.col("_n")
    pairs = sizes.withColumn("_worse", worse).groupBy(DATE).agg(F.sum(F.col("_n") * F.col("_worse")).alias("n_pairs"))
    parts = []
    for value in values[1:]:
        ranked = with_average_ranks(held.where(F.col("_l") <= value), [DATE], {"_s": "_r"}, doubled=True)
        own = ranked.where(F.col("_l") == value).groupBy(DATE).agg(F.sum("_r").alias("_r"), F.count(F.lit(1)).alias("_n"))
        parts.append(own.select(DATE, (F.col("_r") - F.col("_n") * (F.col("_n") + 1)).alias("_wins")))
    if not parts:
        return pairs.where("false").select(DATE, "n_pairs", F.lit(0.0).alias("concordance"))
    won = reduce(DataFrame.unionByName, parts).groupBy(DATE).agg(F.sum("_wins").alias("_wins"))
    return pairs.where("n_pairs > 0").join(won, DATE).select(DATE, "n_pairs", (F.col("_wins") / (2 * F.col("n_pairs"))).alias("concordance"))
