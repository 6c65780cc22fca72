"""Toxicity by non-negative positive-unlabelled learning: a few confirmed toxic documents against text of unknown kind.

Unlabelled text is a mixture of both kinds, so it can't stand for clean text. With the share ``prior`` of toxic documents, the risk on
clean text is the risk of calling unlabelled text clean, less ``prior`` times that of calling confirmed text clean. That difference estimates
something that can't be negative; where it is, a flexible model is fitting noise, and the step goes the other way (Kiryo et al., 2017).

Several linear classifiers are fitted with numpy, each in its own task, on all sampled positives and its own share of the unlabelled
sample; a score is the logistic function of their mean. Features are hashed words, and word starts of 4 to 6 letters, which stand for
stems: how many of a thousand words have them, on a logarithmic scale. A classifier keeps those features that are more frequent in confirmed
text than chance explains, by a threshold that grows with the number of features.

Bounds: the fit reads at most about ``MAX_POSITIVE`` positives, and ``MAX_UNLABELLED`` unlabelled documents per classifier, chosen by
hash of ``doc_id``; ``prior`` is counted over all labels. Every document is scored, over its whole text. Only rows outside the held-out
fold are read for the fit, with or without labels.

Defined cases: a null text is an empty one, and an empty text has the score of no features at all; a null ``doc_id`` is not held out and has no
label; a document is confirmed if any of its rows in ``labels`` says so; rows that share a ``doc_id`` enter the fit once, with the least of
their texts, and are scored one by one; without any confirmed document all scores are 0; an empty table gives no rows; further columns are
ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factorloom.llm.shared import map_rows, stored

FOLDS = 5
MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
CLASSIFIERS = 3
EPOCHS = 100
RIDGE = 1e-3
LEARNING_RATE = 0.1
BITS = 20
STEMS = (4, 5, 6)
#: Features of fewer sampled documents are not considered.
MIN_DOCUMENTS = 3
#: Words whose features a task remembers.
CACHE_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    names = [word, *(f"^{word[:k]}" for k in STEMS if len(word) > k)]
    return [crc32(name.encode()) & ((1 << BITS) - 1) for name in names]


def feature_counter() -> Callable[[str | None], tuple[np.ndarray, np.ndarray]]:
    """A function from a text to its features and their values, with a bounded memory of words."""
    known: dict[str, list[int]] = {}

    def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = Counter(WORD.findall((text or "").lower()))
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        ids: list[int] = []
        times: list[int] = []
        for word, n in words.items():
            features = known.get(word)
            if features is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                features = known[word] = word_features(word)
            ids += features
            times += [n] * len(features)
        unique, place = np.unique(np.array(ids), return_inverse=True)
        return unique, np.log2(1 + 1000 * np.bincount(place, weights=times) / words.total())

    return counted


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Sparse rows in one buffer."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray]) -> None:
        self.n = len(ids)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in ids])
        self.ids = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        self.values = np.concatenate([np.zeros(0), *values]).astype(np.float64)

    def only(self, keep: np.ndarray) -> Rows:
        """The features marked in ``keep``, renumbered."""
        out, chosen = Rows([], []), keep[self.ids]
        out.n, out.row, out.values = self.n, self.row[chosen], self.values[chosen]
        out.ids = (np.cumsum(keep) - 1)[self.ids[chosen]]
        return out

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.ids] * self.values, minlength=self.n)

    def gradient(self, slopes: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.ids, weights=slopes[self.row] * self.values, minlength=features)


def excess(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """Signed root of the Poisson deviance of a feature's documents among positives, against its share of the unlabelled."""
    expected = n_positive * (unlabelled + 0.5) / max(n_unlabelled, 1)
    logs = np.where(positive > 0, positive * np.log(np.maximum(positive, 1) / expected), 0.0)
    return np.sqrt(np.maximum(2 * (logs - (positive - expected)), 0)) * np.sign(positive - expected)


def risk_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the non-negative risk in the scores of both kinds of rows, for the logistic loss."""
    p, u = logistic(positive), logistic(unlabelled)
    clean_risk = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    if clean_risk < 0:
        return prior * p / len(p), -u / len(u)
    return prior * (p - 1) / len(p) - prior * p / len(p), u / len(u)


def fit(positive: Rows, unlabelled: Rows, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Features kept, their weights, and the intercept."""
    size = 1 << BITS
    in_p, in_u = np.bincount(positive.ids, minlength=size), np.bincount(unlabelled.ids, minlength=size)
    seen = in_p + in_u >= MIN_DOCUMENTS
    limit = np.sqrt(2 * np.log(seen.sum() + 2))
    keep = seen & (excess(in_p, in_u, positive.n, unlabelled.n) > limit)
    positive, unlabelled, features = positive.only(keep), unlabelled.only(keep), int(keep.sum())
    weights = np.append(np.zeros(features), np.log(prior / (1 - prior)))
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for epoch in range(1, EPOCHS + 1):
        z_p, z_u = (rows.times(weights[:-1]) + weights[-1] for rows in (positive, unlabelled))
        s_p, s_u = risk_slopes(z_p, z_u, prior)
        slope = positive.gradient(s_p, features) + unlabelled.gradient(s_u, features) + RIDGE * weights[:-1]
        slope = np.append(slope, s_p.sum() + s_u.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        step = first / (1 - 0.9**epoch) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        weights = weights - LEARNING_RATE * step
    return np.flatnonzero(keep), weights[:-1], float(weights[-1])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def share(doc_id: Column, purpose: str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(doc_id, F.lit(purpose)), F.lit(1 << 31)) / float(1 << 31)


def trained(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> dict[int, float] | None:
    """Mean weights of the classifiers by feature, the intercept at -1; None without confirmed documents.

    ``prior`` is the share of toxic documents; if it is not given, that among the labelled documents outside the held-out fold.
    """
    outside = F.coalesce(remainder(F.col("doc_id")) != 0, F.lit(False))
    judged = labels.where(outside & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("confirmed"))
    judged = stored(judged, "toxicity-labels")
    n_judged, n_confirmed = judged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("confirmed").cast("long")), F.lit(0))).first()
    n_rows = docs.where(outside).count()
    if not n_confirmed or not n_rows:
        return None
    prior = min(max(prior if prior is not None else n_confirmed / n_judged, 1e-4), 0.9)
    chosen = judged.where(F.col("confirmed") & (share(F.col("doc_id"), "positive") < MAX_POSITIVE / n_confirmed))
    # At most about MAX_POSITIVE numbers.
    chosen = F.broadcast(chosen.select("doc_id", F.lit(True).alias("positive")))
    drawn = F.when(
        share(F.col("doc_id"), "unlabelled") < CLASSIFIERS * MAX_UNLABELLED / n_rows,
        F.pmod(F.xxhash64("doc_id", F.lit("classifier")), F.lit(CLASSIFIERS)).cast("int"),
    )
    sample = docs.where(outside).select("doc_id", "text").join(chosen, "doc_id", "left").withColumn("classifier", drawn)
    sample = sample.where(F.col("positive") | F.col("classifier").isNotNull())
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("positive").alias("positive"), F.max("classifier").alias("classifier"))

    def rows() -> Callable[..., Iterator[tuple]]:
        counted = feature_counter()

        def one(doc_id, text, positive, classifier):
            ids, values = counted(text)
            for k in range(CLASSIFIERS):
                if positive:
                    yield k, True, doc_id, ids, values
                if classifier == k:
                    yield k, False, doc_id, ids, values

        return one

    featured = map_rows(sample, rows, f"classifier int, positive boolean, doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, values array<float>")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        # The order of arrival would change the last digits of the sums.
        rows = rows.sort_values("doc_id")
        kinds = [rows[rows["positive"]], rows[~rows["positive"]]]
        if not all(map(len, kinds)):
            return pd.DataFrame({"ids": [], "weights": [], "intercept": []})
        ids, weights, intercept = fit(*(Rows(list(k["ids"]), list(k["values"])) for k in kinds), prior)
        return pd.DataFrame({"ids": [ids], "weights": [weights], "intercept": [intercept]})

    models = featured.groupBy("classifier").applyInPandas(fitted, "ids array<int>, weights array<double>, intercept double")
    # Each at most as many numbers as there are hash values, and in practice some hundreds.
    found = models.collect()
    if not found:
        return None
    mean: dict[int, float] = {-1: sum(m.intercept for m in found) / len(found)}
    for m in found:
        for i, w in zip(m.ids, m.weights):
            mean[i] = mean.get(i, 0.0) + w / len(found)
    return mean


def scores(docs: DataFrame, model: dict[int, float] | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    source = docs.select("doc_id", "text")

    def rows() -> Callable[..., Iterator[tuple]]:
        known: dict[str, list[int]] = {}

        def one(doc_id, text):
            if model is None:
                yield doc_id, 0.0
                return
            words = WORD.findall((text or "").lower())
            times: dict[int, int] = {}
            for word, n in Counter(words).items():
                features = known.get(word)
                if features is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    features = known[word] = [f for f in word_features(word) if f in model]
                for f in features:
                    times[f] = times.get(f, 0) + n
            z = model[-1] + sum(model[f] * float(np.log2(1 + 1000 * n / len(words))) for f, n in sorted(times.items()))
            yield doc_id, float(logistic(np.float64(z)))

        return one

    scored = map_rows(source, rows, StructType([source.schema["doc_id"], StructField("score", DoubleType())]))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    return scores(docs, trained(docs, labels, prior))
