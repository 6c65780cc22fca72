"""Cross-sectional models on MLlib, walk-forward training and model choice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.frames import DATE, INSTRUMENT
from factorloom.functions.numeric import finite
from factorloom.operators.ic import label_ranks, pooled_rank_correlation
from factorloom.operators.labels import binary_label, rank_label
from factorloom.operators.xsection import zero_missing
from factorloom.sources.shared import stored

SEED = 42


def elastic_net(train: DataFrame, features: Sequence[str], label: str, alpha: float = 0.01, l1_ratio: float = 0.2) -> Model:
    """Median imputation, standardisation, elastic net. A feature without any training value is zero."""
    clean = train.withColumns({f: finite(F.col(f)) for f in features})
    known = clean.agg(*[F.count(f).alias(f) for f in features]).first()
    empty = [f for f in features if known[f] == 0]
    filled = [f for f in features if f not in empty]
    zeros = ", ".join(["*", *[f"coalesce({f}, 0.0D) AS {f}_imputed" for f in empty]])
    stages = [
        SQLTransformer(statement=f"SELECT {zeros} FROM __THIS__"),
        Imputer(strategy="median", inputCols=filled, outputCols=[f"{f}_imputed" for f in filled]),
        VectorAssembler(inputCols=[f"{f}_imputed" for f in features], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LinearRegression(labelCol=label, regParam=alpha, elasticNetParam=l1_ratio, standardization=False, maxIter=100),
    ]
    return Pipeline(stages=stages).fit(clean)


def _trees(learner, train: DataFrame, features: Sequence[str]) -> Model:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, learner]).fit(zero_missing(train, features))


def boosted_regressor(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 4) -> Model:
    learner = GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.05, minInstancesPerNode=50, seed=SEED)
    return _trees(learner, train, features)


def boosted_classifier(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 4) -> Model:
    """Trained on the top and bottom fifth of each date; its score is the probability of the top."""
    extremes = binary_label(train, label).where("is_extreme")
    learner = GBTClassifier(labelCol="binary_label", maxIter=trees, maxDepth=depth, stepSize=0.05, seed=SEED)
    return _trees(learner, extremes, features)


def boosted_ranker(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 4) -> Model:
    """Boosted regression on the ordinal label of each date (MLlib has no pairwise ranking objective)."""
    ranked = rank_label(train, label, bins=5, min_names=10).where(F.col("rank_label").isNotNull())
    ranked = ranked.withColumn("rank_label", F.col("rank_label").cast("double"))
    learner = GBTRegressor(labelCol="rank_label", maxIter=trees, maxDepth=depth, stepSize=0.05, minInstancesPerNode=50, seed=SEED)
    return _trees(learner, ranked, features)


Trainer = Callable[[DataFrame, Sequence[str], str], Model]

MODELS: dict[str, Trainer] = {
    "elastic_net": elastic_net,
    "boosted_regressor": boosted_regressor,
    "boosted_classifier": boosted_classifier,
    "boosted_ranker": boosted_ranker,
}


def predict(model: Model, rows: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(datetime, instrument, *keep, prediction)``; a classifier's score is the probability of the top."""
    linear = isinstance(model.stages[-1], LinearRegressionModel)
    clean = rows.withColumns({f: finite(F.col(f)) for f in features}) if linear else zero_missing(rows, features)
    scored = model.transform(clean)
    score = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.select(DATE, INSTRUMENT, *keep, score.alias("prediction"))


def feature_importance(model: Model, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Importance or coefficient of every feature, or of the ``top`` ones for a report."""
    fitted = model.stages[-1]
    values = fitted.coefficients if hasattr(fitted, "coefficients") else fitted.featureImportances
    entries = [F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("importance")) for f, v in zip(features, values.toArray())]
    table = SparkSession.active().range(1).select(F.inline(F.array(*entries)))
    return table if top is None else table.orderBy(F.desc(F.abs("importance")), "feature").limit(top)


def shuffled_values(rows: DataFrame, columns: Sequence[str], salt: str, prefix: str = "_s_") -> DataFrame:
    """Add every column with its values moved to other rows, all columns of a row together.

    Rows are dealt into random blocks, and in each block every row takes the values of the next one in a random order;
    both follow from a hash of the row's key, so a task that runs again moves the same values. The number of blocks
    follows the shuffle partitions.
    """
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(f"{salt}/block"), DATE, INSTRUMENT), F.lit(blocks)))
    order = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(salt), DATE, INSTRUMENT), DATE, INSTRUMENT)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = F.struct(*columns)
    moved = keyed.withColumn("_moved", F.coalesce(F.lead(values).over(order), F.first(values).over(whole)))
    return moved.select(*rows.columns, *[F.col("_moved")[c].alias(f"{prefix}{c}") for c in columns])


def permutation_importance(
    model: Model, rows: DataFrame, features: Sequence[str], label: str, shuffles: int = 3, seed: int = SEED
) -> DataFrame:
    """Drop of the pooled rank IC when one feature's values are shuffled, mean over ``shuffles``.

    Missing values are left to the model's own rule, which gives every row a prediction. The label is ranked once: shuffles
    move the features only. All features and shuffles are scored in one pass, and one number for each returns. ``rows`` should be a
    stored table.
    """
    rows = rows.select(DATE, INSTRUMENT, label, *features)
    labels = label_ranks(rows, [], label)
    ranked = stored(rows.join(labels.select(label, "_ry"), label, "left").drop(label), "ranked")
    rounds = [shuffled_values(ranked, features, f"{seed}/{i}").withColumn("_round", F.lit(i)) for i in range(shuffles)]
    # Feature number -1 is the rows as they are.
    moved = reduce(DataFrame.unionByName, rounds).where(F.col("_ry").isNotNull())
    changed = [
        F.struct(F.lit(i).alias("_feature"), *[F.col(f"_s_{c}" if c == feature else c).alias(c) for c in features])
        for i, feature in enumerate(features)
    ]
    changed = moved.select(DATE, INSTRUMENT, "_ry", "_round", F.inline(F.array(*changed)))
    as_is = ranked.where(F.col("_ry").isNotNull()).withColumns({"_feature": F.lit(-1), "_round": F.lit(0)})
    keys = ["_feature", "_round"]
    predictions = predict(model, changed.unionByName(as_is), features, (*keys, "_ry"))
    found = pooled_rank_correlation(predictions.select(*keys, "prediction", "_ry"), keys, "prediction", labels)
    ics = {(r["_feature"], r["_round"]): r.ic for r in found.collect()}
    base = ics[-1, 0]
    drops = [(f, sum(base - ics[i, j] for j in range(shuffles)) / shuffles) for i, f in enumerate(features)]
    return rows.sparkSession.createDataFrame(drops, "feature string, importance double")


def walk_forward(rows: DataFrame, features: Sequence[str], label: str, trainer: Trainer) -> DataFrame:
    """Validation and out-of-sample predictions of every window: ``window_id, role, prediction, label``.

    ``rows`` is ``splits.window_rows``, stored. One distributed fit per window; the loop is over the windows, whose
    number is bounded by the calendar.
    """
    windows = sorted(r.window_id for r in rows.select("window_id").distinct().collect())
    parts = []
    for w in windows:
        window = rows.where(F.col("window_id") == w)
        model = trainer(window.where(F.col("role") == "train"), features, label)
        scored = window.where(F.col("role") != "train")
        parts.append(predict(model, scored, features, ("window_id", "role", label)))
    return reduce(DataFrame.unionByName, parts)


def single_factor_regressions(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Predictions of one least-squares line per window and factor: ``model, window_id, role, datetime, instrument, prediction, label``.

    As ``single_factor_columns``, one row per factor.
    """
    ids = ["window_id", "role", DATE, INSTRUMENT, label]
    return single_factor_columns(rows, features, label).unpivot(ids, list(features), "model", "prediction").select("model", *ids, "prediction")


def single_factor_columns(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``window_id, role, datetime, instrument, label`` and in the column of each factor its line's prediction.

    All windows and factors are fitted in one aggregation over their training rows, which leaves one row per window; these lines
    are then applied to the later rows, which do not move. No fit runs on the driver.
    """
    ids = ["window_id", "role", DATE, INSTRUMENT, label]
    clean = rows.select(*ids, *[finite(F.col(f)).alias(f) for f in features])
    y = F.col(label)
    fits = [(fit(y, F.col(f)), f"{name}_{f}") for f in features for name, fit in (("_a", F.regr_intercept), ("_b", F.regr_slope))]
    lines = clean.where("role = 'train'").groupBy("window_id").agg(*[fit.alias(name) for fit, name in fits])
    # One row per window, whose number is bounded by the calendar.
    later = clean.where("role <> 'train'").join(F.broadcast(lines), "window_id")
    return later.select(*ids, *[(F.col(f"_a_{f}") + F.col(f"_b_{f}") * F.col(f)).alias(f) for f in features])


# --- choice for live use --------------------------------------------------------------

# Hard limits and score weights.
LIMITS = {
    "min_oos_ic": 0.0,
    "min_oos_icir": 0.0,
    "min_ann_excess_return": 0.0,
    "min_excess_sharpe": 0.0,
    "max_drawdown": -0.25,
    "max_avg_turnover": 0.8,
    "min_positive_ratio": 0.52,
    "min_rolling_windows": 3,
}
WEIGHTS = {
    "oos_icir": 0.30,
    "excess_sharpe": 0.30,
    "ann_excess_return": 0.20,
    "positive_ratio": 0.10,
    "drawdown": 0.05,
    "turnover": 0.05,
}


def best_by_icir(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The model with the largest absolute validation ICIR; of equal ones the first by name."""
    return metrics.groupBy(*by).agg(F.min_by("model", F.struct(-F.abs("icir"), "model")).alias("model"))


def select_live(candidates: DataFrame, limits: dict | None = None, weights: dict | None = None) -> DataFrame:
    """Candidates with the limits they break, and score and rank of those that break none.

    ``candidates`` has one row per model: model, oos_ic, oos_icir, ann_excess_return,
    excess_sharpe, max_drawdown, avg_turnover, positive_ratio, n_windows (null for a static split).
    """
    lim = {**LIMITS, **(limits or {})}
    if not set(weights or ()) <= set(WEIGHTS) or any(v <= 0 for v in (weights or {}).values()):
        raise ValueError(f"weights must be positive numbers for some of {sorted(WEIGHTS)}")
    chosen = {**WEIGHTS, **(weights or {})}
    w = {name: weight / sum(chosen.values()) for name, weight in chosen.items()}

    broken = {
        "oos_ic": ~(F.col("oos_ic") > lim["min_oos_ic"]),
        "oos_icir": ~(F.col("oos_icir") > lim["min_oos_icir"]),
        "ann_excess_return": ~(F.col("ann_excess_return") > lim["min_ann_excess_return"]),
        "excess_sharpe": ~(F.col("excess_sharpe") > lim["min_excess_sharpe"]),
        "max_drawdown": ~(F.col("max_drawdown") >= lim["max_drawdown"]),
        "avg_turnover": ~(F.col("avg_turnover") <= lim["max_avg_turnover"]),
        "positive_ratio": ~(F.col("positive_ratio") >= lim["min_positive_ratio"]),
    }
    # A missing measure counts as a broken limit; a missing window count means a static split.
    flags = {k: F.coalesce(v, F.lit(True)) for k, v in broken.items()}
    flags["n_windows"] = F.coalesce(F.col("n_windows") < lim["min_rolling_windows"], F.lit(False))
    reasons = F.concat_ws(", ", *[F.when(v, F.lit(k)) for k, v in flags.items()])
    judged = candidates.withColumn("rejection_reasons", reasons).withColumn("passed", F.col("rejection_reasons") == "")

    def percentile(name: str):
        group = Window.partitionBy("passed")
        ties = Window.partitionBy("passed", name)
        rank = F.rank().over(group.orderBy(name)) + (F.count(F.lit(1)).over(ties) - 1) / 2
        return rank / F.count(F.lit(1)).over(group)

    parts = {name: percentile(name) for name in ("oos_icir", "excess_sharpe", "ann_excess_return", "positive_ratio")}
    parts["drawdown"] = 1 + F.col("max_drawdown")
    parts["turnover"] = 1 - F.least(F.col("avg_turnover") / lim["max_avg_turnover"], F.lit(1.0))
    score = F.lit(0.0)
    for name, weight in w.items():
        score = score + weight * parts[name]
    scored = judged.withColumn("score", F.when(F.col("passed"), score))
    place = F.row_number().over(Window.partitionBy("passed").orderBy(F.desc("score"), "model"))
    return scored.withColumn("place", F.when(F.col("passed"), place.cast("bigint")))
