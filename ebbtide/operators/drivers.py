"""Which features a model leans on, which way they point, and what to do about it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions.scalars import map_labels
from ebbtide.operators.evaluation import roc_auc, score
from ebbtide.operators.ordering import ranked
from ebbtide.runtime import materialized


def with_donors(source: DataFrame, carried: Sequence[str], repeats: int, seed: int, key: str) -> DataFrame:
    """Every row once per repeat, with ``<c>__donor`` of another row for each carried column.

    Row ``i`` of repeat ``r`` receives from the row at place ``i`` in the repeat's own hash order: a
    random permutation, found by two distributed ranks and a join on the place.
    """
    base = ranked(source, [key], "_place")
    shuffled = ranked(
        source.select(key, *carried, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
        .withColumn("_hash", F.xxhash64(F.col(key), F.col("repeat"), F.lit(seed))),
        ["repeat", "_hash", key],
    )
    rows = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    donors = shuffled.select(
        "repeat", (F.col("global_rank") - F.col("repeat") * rows).alias("_place"),
        *[F.col(c).alias(f"{c}__donor") for c in carried],
    )
    return base.join(donors, "_place").drop("_place")


def permuted(df: DataFrame, columns: Sequence[str], repeats: int, seed: int, key: str) -> DataFrame:
    """Every row once per (feature, repeat), that feature taken from another row."""
    paired = with_donors(df.select(key, fv.LABEL, *columns), columns, repeats, seed, key).withColumn(
        "_feature", F.explode(F.array(*map(F.lit, range(len(columns)))))
    )
    swapped = {c: F.when(F.col("_feature") == i, F.col(f"{c}__donor")).otherwise(F.col(c)) for i, c in enumerate(columns)}
    return paired.withColumns(swapped).select(_named(columns, F.col("_feature")), "repeat", fv.LABEL, *columns)


def _named(columns: Sequence[str], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, columns)), place).alias("feature")


def _areas_by_feature(numbered: DataFrame, columns: Sequence[str], repeats: int) -> DataFrame:
    """ROC-AUC per ``feature`` and ``repeat`` of scores with ``_group``, one number for both: names are not shuffled.

    Rows are scored once: the order by score passes over its rows several times, so the scores are written first.
    """
    group = F.col("_group")
    return roc_auc(materialized(numbered), by=["_group"]).select(
        _named(columns, F.floor(group / repeats).cast("int")), F.pmod(group, F.lit(repeats)).cast("int").alias("repeat"), "roc_auc")


def _group(place: Column, repeats: int) -> Column:
    return (place * repeats + F.col("repeat")).cast("int").alias("_group")


def feature_places(model: PipelineModel) -> dict[str, range]:
    """Where in the prepared vector each column of the table is."""
    places, at = {}, 0
    stages = {type(stage).__name__: stage for stage in model.stages}
    assembled = {stage.getOutputCol(): stage.getInputCols() for stage in model.stages if isinstance(stage, VectorAssembler)}
    sizes = dict(zip(stages["OneHotEncoderModel"].getOutputCols(), stages["OneHotEncoderModel"].categorySizes)) if "OneHotEncoderModel" in stages else {}
    for part in assembled["features"]:
        if part == "numeric_features":
            for c in assembled["numeric_filled"]:
                places[c.removesuffix("__filled")] = range(at, at + 1)
                at += 1
        else:  # the encoder was told of one value more, the unknown one, and drops it
            places[part.removesuffix("__onehot")] = range(at, at + sizes[part] - 1)
            at += sizes[part] - 1
    return places


def _areas(model: PipelineModel, df: DataFrame, columns: Sequence[str], repeats: int, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """ROC-AUC of the rows as they are, and per feature that the model uses and repeat, with the feature shuffled.

    Rows are prepared once. A linear model's margin changes by weight times donor less own, for all
    features of a pair of rows at once; other models score the prepared vectors again, of the features they
    split on alone. No wide row is copied per feature.
    """
    *stages, fitted = model.stages
    places = feature_places(model)
    ready = PipelineModel(stages=stages).transform(df)
    own = materialized(ready.select(key, F.col(fv.LABEL).cast("int").alias("y_true"), vector_to_array("features").alias("x")))
    paired = with_donors(own, ["x"], repeats, seed, key)
    at = lambda c, i: F.get(c, F.lit(i))
    if isinstance(fitted, LogisticRegressionModel):
        weights = [float(w) for w in fitted.coefficients]
        used = [c for c in columns if any(weights[i] for i in places[c])]
        total = lambda terms: reduce(lambda a, b: a + b, terms, F.lit(0.0))
        margin = total([at("x", i) * w for i, w in enumerate(weights)])
        moved = [F.struct(_group(F.lit(columns.index(c)), repeats), (F.col("_margin") + total([(at("x__donor", i) - at("x", i)) * weights[i] for i in places[c]])).alias("y_prob")) for c in used]
        base = own.select("y_true", margin.alias("y_prob"))
        shuffled = paired.withColumn("_margin", margin).select("y_true", F.inline(F.array(*moved))) if used else None
    else:
        split_on = set(np.flatnonzero(fitted.featureImportances.toArray()).tolist())
        used = [c for c in columns if split_on & set(places[c])]
        probability = vector_to_array(F.col("probability"))[1].alias("y_prob")
        both = F.zip_with("x", "x__donor", lambda x, d: F.struct(x.alias("x"), d.alias("d")))
        index = F.sequence(F.lit(0), F.size("x") - 1)

        def swapped(place: range) -> Column:
            mixed = lambda v, i: F.when((i >= place.start) & (i < place.stop), v["d"]).otherwise(v["x"])
            return F.zip_with(both, index, mixed)

        moved = [F.struct(_group(F.lit(columns.index(c)), repeats), swapped(places[c]).alias("_x")) for c in used]
        base = fitted.transform(own.select("y_true", array_to_vector("x").alias("features"))).select("y_true", probability)
        vectors = paired.select("y_true", F.inline(F.array(*moved))) if used else None
        shuffled = fitted.transform(vectors.withColumn("features", array_to_vector("_x"))).select("_group", "y_true", probability) if used else None
    areas = _areas_by_feature(shuffled, columns, repeats) if used else df.sparkSession.createDataFrame([], "feature string, repeat int, roc_auc double")
    return roc_auc(base), areas


def permutation_importance(
    model: PipelineModel, df: DataFrame, columns: Sequence[str], repeats: int = 10,
    seed: int = fv.SEED, key: str = "customer_id",
) -> DataFrame:
    """Mean and population deviation of the ROC-AUC lost when a feature is shuffled; 0 for one the model does not use."""
    base, areas = _areas(model, df, columns, repeats, seed, key)
    baseline = materialized(base).scalar()
    lost = baseline - F.col("roc_auc")
    found = areas.groupBy("feature").agg(F.avg(lost).alias("importance_mean"), F.stddev_pop(lost).alias("importance_std"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return every.join(found, "feature", "left").select(
        "feature", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("importance_mean", "importance_std")]
    ).orderBy(F.desc("importance_mean"), "feature")


def rescored_importance(
    model: PipelineModel, df: DataFrame, columns: Sequence[str], repeats: int, seed: int = fv.SEED, key: str = "customer_id"
) -> DataFrame:
    """The mean importances by scoring every changed row with the whole model: slow, to compare with."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("feature")) - 1
    scored = score(model, permuted(df, columns, repeats, seed, key)).select(_group(place, repeats), "y_true", "y_prob")
    areas = _areas_by_feature(scored, columns, repeats)
    baseline = materialized(roc_auc(score(model, df).select("y_true", "y_prob"))).scalar()
    return areas.groupBy("feature").agg(F.avg(baseline - F.col("roc_auc")).alias("importance_mean"))


def retention_recommendations(
    importance: DataFrame, correlation: DataFrame, actions: Mapping[str, str], default: str, top: int = 6
) -> DataFrame:
    """The strongest drivers, the end of each that goes with churn, and the caller's treatment of it."""
    leading = importance.orderBy(F.desc("importance_mean"), "feature").limit(top)
    risky = F.when(F.col("correlation") > 0, "higher").otherwise("lower")
    return (
        leading.join(correlation, "feature", "left")
        .orderBy(F.desc("importance_mean"), "feature")
        .select(
            F.col("feature").alias("driver"),
            F.concat(risky, F.lit(" "), F.col("feature"), F.lit(" -> more likely to churn")).alias("risk_signal"),
            map_labels(F.col("feature"), actions, default).alias("recommended_action"),
        )
    )
