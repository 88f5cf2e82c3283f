"""Repeatable stratified splits and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.operators.ordering import ranked
from ebbtide.runtime import one_row


def _shuffled(df: DataFrame, label: str, key: str, seed: int, name: str) -> DataFrame:
    """Rank rows by label, then by a hash of their key: a fixed random order per class."""
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    return ranked(hashed, [label, "_hash", key], name).drop("_hash")


def class_quotas(df: DataFrame, label: str, fraction: float) -> DataFrame:
    """Training rows per class for a held-out ``fraction``, by largest remainder."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows = classes.agg(F.sum("n").alias("n")).scalar()
    training = rows - F.ceil(rows * fraction)
    everything = Window.partitionBy(F.lit(0))
    by_remainder = Window.partitionBy(F.lit(0)).orderBy(F.desc("_left_over"), label)
    # one row per class from here on
    return (
        classes.withColumn("_exact", F.col("n") * training / rows)
        .withColumn("_whole", F.floor("_exact"))
        .withColumn("_left_over", F.col("_exact") - F.col("_whole"))
        .withColumn("_missing", training - F.sum("_whole").over(everything))
        .withColumn("_turn", F.row_number().over(by_remainder))
        .withColumn("train_rows", F.col("_whole") + F.when(F.col("_turn") <= F.col("_missing"), 1).otherwise(0))
        .withColumn("_before", F.coalesce(
            F.sum("n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(label, "n", "train_rows", "_before")
    )


def with_split(
    df: DataFrame, label: str = fv.LABEL, fraction: float = 0.2, seed: int = fv.SEED,
    key: str = "customer_id",
) -> DataFrame:
    """Mark rows ``train`` or ``test``: exact sizes per class, the same rows every time."""
    placed = _shuffled(df, label, key, seed, "_place")
    quotas = class_quotas(df.select(label), label, fraction)
    inside = F.col("_place") - F.col("_before")
    return (
        placed.join(F.broadcast(quotas), label)
        .withColumn("split", F.when(inside <= F.col("train_rows"), "train").otherwise("test"))
        .select(*df.columns, "split")
    )


def stratified_split(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, **options)
    part = lambda name: marked.filter(F.col("split") == name).drop("split")
    return part("train"), part("test")


def with_folds(
    df: DataFrame, label: str = fv.LABEL, k: int = 5, seed: int = fv.SEED, key: str = "customer_id"
) -> DataFrame:
    """Add ``fold`` 0..k-1; class counts and sizes of any two folds differ by at most one."""
    placed = _shuffled(df, label, key, seed + 1, "_place")
    return placed.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(k)).cast("int")).drop("_place")


def class_weights(df: DataFrame, label: str = fv.LABEL) -> DataFrame:
    """Weight per class that gives every class the same total: rows / (classes x class rows)."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    facts = one_row(classes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")))
    return classes.withColumn("class_weight", facts["rows"] / facts["classes"] / F.col("n"))


def with_class_weight(df: DataFrame, label: str = fv.LABEL) -> DataFrame:
    weights = class_weights(df.select(label), label).drop("n")
    return df.join(F.broadcast(weights), label)


def positive_weight(df: DataFrame, label: str = fv.LABEL) -> DataFrame:
    """Negatives per positive."""
    positive = F.col(label) == 1
    return df.agg(
        F.try_divide(F.count_if(~positive), F.count_if(positive)).alias("scale_pos_weight")
    )
