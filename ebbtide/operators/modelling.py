"""Preparation, candidates, cross-validation, search and hold-out evaluation on Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    ElementwiseProduct, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions.scalars import split_by_type
from ebbtide.operators.distributions import describe_categorical
from ebbtide.operators.evaluation import binary_metrics, score
from ebbtide.operators.splitting import with_class_weight, with_folds
from ebbtide.operators.summaries import exact_quantiles
from ebbtide.runtime import checkpointed, materialized, new_path

WEIGHT = "class_weight"


def feature_columns(df: DataFrame, drop: Sequence[str] = fv.NON_FEATURES) -> tuple[list[str], list[str]]:
    """Predictors by type: (numeric, categorical)."""
    return split_by_type(df.drop(*drop, WEIGHT, "fold", "split"))


def _literal(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else f"{value!r}D"


def medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact training medians, 0 where a column has no value."""
    return {c: 0.0 if m is None else m for c, (m,) in zip(columns, exact_quantiles(train, columns, [0.5]))}


def numeric_prep(train: DataFrame, columns: Sequence[str], middle: dict[str, float] | None = None) -> list:
    """Exact training medians for missing values, then zero mean and unit population deviation.

    The ML ``Imputer`` only approximates medians, so they are computed here, unless given, and written into an
    SQL stage. ``StandardScaler`` divides by the sample deviation; the last stage corrects that.
    """
    middle = medians(train, columns) if middle is None else middle
    rows = train.count()
    filled = ", ".join(
        f"coalesce(cast(`{c}` AS double), {_literal(middle[c])}) AS `{c}__filled`" for c in columns
    )
    correction = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    return [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}__filled" for c in columns], outputCol="numeric_filled"),
        StandardScaler(inputCol="numeric_filled", outputCol="numeric_scaled", withMean=True, withStd=True),
        ElementwiseProduct(
            inputCol="numeric_scaled", outputCol="numeric_features",
            scalingVec=Vectors.dense([correction] * len(columns)),
        ),
    ]


def categorical_prep(train: DataFrame, columns: Sequence[str]) -> list:
    """Most common training value for missing ones, then one 0/1 column per known value."""
    top = {r["column"]: r["top"] for r in describe_categorical(train, columns).collect()}
    filled = ", ".join(
        f"coalesce(cast(`{c}` AS string), {_literal(top.get(c, ''))}) AS `{c}__filled`" for c in columns
    )
    return [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        StringIndexer(
            inputCols=[f"{c}__filled" for c in columns], outputCols=[f"{c}__index" for c in columns],
            handleInvalid="keep",
        ),
        # the unknown value holds the last place, which is the one dropped: all zeros
        OneHotEncoder(
            inputCols=[f"{c}__index" for c in columns], outputCols=[f"{c}__onehot" for c in columns],
            dropLast=True,
        ),
    ]


def preprocessor(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), middle: dict[str, float] | None = None
) -> Pipeline:
    """Both branches into one ``features`` vector."""
    stages, parts = [], []
    if numeric:
        stages += numeric_prep(train, numeric, middle)
        parts.append("numeric_features")
    if categorical:
        stages += categorical_prep(train, categorical)
        parts += [f"{c}__onehot" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


# Results can equal those of other implementations on the same search spaces alone. Options without a counterpart in Spark ML (solver, l2 of the histogram
# booster, minimum rows to split) are left out; a leaf limit becomes the depth that holds it.
PARAM_GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1, 5, 10]},
    "random_forest": {
        "numTrees": [200, 300, 500, 700],
        "maxDepth": [30, 5, 8, 12, 20],
        "minInstancesPerNode": [1, 2, 4, 8],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
    },
    "gradient_boosting": {
        "maxIter": [100, 200, 300],
        "stepSize": [0.01, 0.05, 0.1, 0.2],
        "maxDepth": [2, 3, 4],
        "subsamplingRate": [0.6, 0.8, 1.0],
    },
    "hist_gradient_boosting": {
        "stepSize": [0.01, 0.05, 0.1, 0.2],
        "maxIter": [200, 300, 500],
        "maxDepth": [4, 5, 6],
    },
}

BASELINES = tuple(PARAM_GRIDS)
SLOWEST_FIRST = ("random_forest", "hist_gradient_boosting", "gradient_boosting", "logistic_regression")


def param_grid(name: str) -> list[dict]:
    """Every combination of a model's search space."""
    space = PARAM_GRIDS[name]
    return [dict(zip(space, values)) for values in product(*space.values())]


def candidate(name: str, weight_sum: float, **params):
    """An unfitted classifier by name. All but ``gradient_boosting`` weight the classes.

    ``C`` multiplies the summed loss while Spark's ``regParam`` goes with the mean loss, hence
    ``regParam = 1 / (C * sum of weights)``.
    """
    common = {"featuresCol": "features", "labelCol": fv.LABEL}
    seeded = {**common, "seed": fv.SEED}
    if name == "logistic_regression":
        strength = params.pop("C", 1.0)
        options = {"maxIter": 300, **params}
        return LogisticRegression(
            **common, weightCol=WEIGHT, standardization=False,
            regParam=1.0 / (strength * weight_sum), **options,
        )
    if name == "random_forest":
        # rows keep the node they are at in every tree: the same trees, without a walk from each root per pass
        options = {"numTrees": 300, "maxDepth": 30, "featureSubsetStrategy": "sqrt", "cacheNodeIds": True, **params}
        return RandomForestClassifier(**seeded, weightCol=WEIGHT, **options)
    if name == "gradient_boosting":
        return GBTClassifier(**seeded, **{"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, **params})
    if name == "hist_gradient_boosting":
        options = {
            "maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "maxBins": 255, "minInstancesPerNode": 20,
            **params,
        }
        return GBTClassifier(**seeded, weightCol=WEIGHT, **options)
    raise ValueError(f"unknown model: {name}")


def fit(train: DataFrame, name: str, **params) -> PipelineModel:
    """Preparation and classifier, fitted on the same rows and kept as one pipeline."""
    weighted = with_class_weight(train)
    prepared = preprocessor(train, *feature_columns(train)).fit(weighted)
    ready = prepared.transform(weighted).select("features", fv.LABEL, WEIGHT).cache()
    weight_sum = float(ready.agg(F.sum(WEIGHT)).first()[0])
    checkpointed(train.sparkSession)
    model = candidate(name, weight_sum, **params).fit(ready)
    ready.unpersist()
    return PipelineModel(stages=[*prepared.stages, model])


@dataclass(frozen=True)
class Trial:
    """One setting to cross-validate."""

    label: str
    model: str
    params: tuple = ()

    def build(self, weight_sum: float):
        return candidate(self.model, weight_sum, **dict(self.params))


def _in_threads(function: Callable, items: Sequence, parallelism: int, spark: SparkSession) -> list:
    """Run several fits at once: each is a series of small Spark jobs."""
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(function), items, chunksize=1)


def fold_medians(folded: DataFrame, columns: Sequence[str], k: int) -> list[dict[str, float]]:
    """The medians of every fold's training rows, all folds in the same passes."""
    outside = folded.select(*[
        F.when(F.col("fold") != fold, F.col(c)).alias(f"{fold}_{i}") for fold in range(k) for i, c in enumerate(columns)
    ])
    found = list(medians(outside, outside.columns).values())
    return [dict(zip(columns, found[fold * len(columns):(fold + 1) * len(columns)])) for fold in range(k)]


def prepared_folds(train: DataFrame, k: int = 5, seed: int = fv.SEED, parallelism: int = 8) -> DataFrame:
    """Every fold's rows, prepared by what its training rows say: fold, held_out, features, label, weight.

    Written once, a folder per fold and side, so that all fits of a fold read its vectors and nothing
    else, in as many partitions as its size asks for.
    """
    spark = train.sparkSession
    folded = materialized(with_folds(train, k=k, seed=seed))
    numeric, categorical = feature_columns(folded)
    middle = fold_medians(folded, numeric, k)

    def prepare(fold: int) -> DataFrame:
        outside, inside = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold).drop("fold")
        weighted = with_class_weight(outside)
        prepared = preprocessor(outside, numeric, categorical, middle[fold]).fit(weighted)
        side = lambda df, held_out: prepared.transform(df).select(
            F.lit(fold).alias("fold"), F.lit(held_out).alias("held_out"), "features", fv.LABEL, F.col(WEIGHT).cast("double").alias(WEIGHT))
        return side(weighted, False).unionByName(side(inside.withColumn(WEIGHT, F.lit(None)), True))

    return materialized(reduce(DataFrame.unionByName, _in_threads(prepare, range(k), parallelism, spark)), ["fold", "held_out"])


def out_of_fold_scores(
    train: DataFrame, trials: Sequence[Trial], k: int = 5, seed: int = fv.SEED, parallelism: int = 8
) -> DataFrame:
    """Each training row scored by the models that did not see it.

    The loop runs over folds and settings, never over rows. A model scores its rows as soon as it is fitted and
    is let go then: a forest of full depth has about a node per three rows and tree, and one plan over the
    scores of all models would send all of them to every task. Models are sent one at a time.
    """
    spark = train.sparkSession
    checkpointed(spark)
    folds = prepared_folds(train, k, seed, parallelism)
    sums = {row["fold"]: row["weights"] for row in folds.filter("NOT held_out").groupBy("fold").agg(F.sum(WEIGHT).alias("weights")).collect()}
    of = lambda fold, held_out: folds.filter((F.col("fold") == fold) & (F.col("held_out") == held_out)).select("features", fv.LABEL, WEIGHT)
    ready = {fold: of(fold, False).cache() for fold in sums}

    sending = Lock()

    def scored(pair: tuple[Trial, int]) -> str:
        trial, fold = pair
        model = trial.build(sums[fold]).fit(ready[fold])
        path = new_path(spark)
        with sending:
            score(PipelineModel(stages=[model]), of(fold, True)).select(
                F.lit(trial.label).alias("model"), F.lit(fold).alias("fold"), "y_true", "y_prob").write.parquet(path)
        return path

    # the slow kinds first, so that none of them is left over at the end
    pairs = [(t, f) for t in sorted(trials, key=lambda trial: SLOWEST_FIRST.index(trial.model)) for f in sums]
    paths = _in_threads(scored, pairs, parallelism, spark)
    for frame in ready.values():
        frame.unpersist()
    return spark.read.schema("model string, fold int, y_true int, y_prob double").parquet(*paths)


def cross_validate(
    train: DataFrame, trials: Sequence[Trial], k: int = 5, seed: int = fv.SEED, parallelism: int = 8
) -> DataFrame:
    """Mean precision, recall, F1 and ROC-AUC over the folds, best ROC-AUC first."""
    scores = out_of_fold_scores(train, trials, k, seed, parallelism)
    per_fold = binary_metrics(scores, by=["model", "fold"])
    return (
        per_fold.groupBy("model")
        .agg(
            F.avg("precision").alias("cv_precision_mean"),
            F.avg("recall").alias("cv_recall_mean"),
            F.avg("f1_score").alias("cv_f1_mean"),
            F.avg("roc_auc").alias("cv_roc_auc_mean"),
        )
        .orderBy(F.desc("cv_roc_auc_mean"), "model")
    )


def baseline_trials(names: Sequence[str] = BASELINES) -> list[Trial]:
    return [Trial(name, name) for name in names]


def best_name(comparison: DataFrame) -> str:
    """The front-runner of a comparison table."""
    return comparison.orderBy(F.desc("cv_roc_auc_mean"), "model").first()["model"]


def search_trials(name: str, n_iter: int = 25, seed: int = fv.SEED) -> list[Trial]:
    """A random sample of a model's grid, no larger than the grid."""
    grid = param_grid(name)
    drawn = random.Random(seed).sample(grid, min(n_iter, len(grid)))
    text = lambda params: ", ".join(f"{k}={v}" for k, v in params.items())
    return [Trial(text(params), name, tuple(params.items())) for params in drawn]


def randomized_search(
    train: DataFrame, name: str, n_iter: int = 25, k: int = 5, seed: int = fv.SEED, parallelism: int = 8
) -> tuple[DataFrame, Trial]:
    """Cross-validated settings, best first, and the best one."""
    trials = search_trials(name, n_iter, seed)
    table = cross_validate(train, trials, k, seed, parallelism).withColumnRenamed("model", "params")
    table = materialized(table)
    best = table.orderBy(F.desc("cv_roc_auc_mean"), "params").first()["params"]
    return table, next(t for t in trials if t.label == best)


def tune(train: DataFrame, name: str, **options) -> PipelineModel:
    """Search, then fit the best setting on all training rows."""
    _, best = randomized_search(train, name, **options)
    return fit(train, best.model, **dict(best.params))


def evaluate(model: PipelineModel, test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and ROC-AUC on held-out rows."""
    return binary_metrics(score(model, test).select("y_true", "y_prob"), threshold)


def logistic_gradient(model: PipelineModel, train: DataFrame) -> DataFrame:
    """The optimality certificate of a fitted logistic regression, in one row: ``weights``, their number
    with the intercept, and ``largest_gradient``, the largest size of a partial derivative of the objective there.

    The objective is the mean loss by class weight and the penalty; it is convex, so it is at its least
    where all derivatives are 0. One aggregation over the rows gives them all.
    """
    *prepared, fitted = model.stages
    size, strength = fitted.numFeatures, fitted.getRegParam()
    ready = PipelineModel(stages=prepared).transform(with_class_weight(train))
    x, weight = vector_to_array(F.col("features")), F.col(WEIGHT)
    rows = ready.select(x.alias("x"), weight.alias("w"), F.col(fv.LABEL).cast("double").alias("y"))
    margin = reduce(lambda a, b: a + b, [F.get("x", F.lit(i)) * float(c) for i, c in enumerate(fitted.coefficients)], F.lit(float(fitted.intercept)))
    wrong = rows.select("x", "w", (F.col("w") * (1 / (1 + F.exp(-margin)) - F.col("y"))).alias("wrong"))
    slopes = wrong.agg(
        F.sum("w").alias("all"), F.sum("wrong").alias("intercept"), *[F.sum(F.col("wrong") * F.get("x", F.lit(i))).alias(f"g{i}") for i in range(size)])
    of = [F.abs(F.col("intercept") / F.col("all"))] + [F.abs(F.col(f"g{i}") / F.col("all") + strength * float(c)) for i, c in enumerate(fitted.coefficients)]
    return slopes.select(F.lit(size + 1).alias("weights"), F.array_max(F.array(*of)).alias("largest_gradient"))
