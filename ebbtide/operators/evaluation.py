"""Metrics, curves and operating points from scores: columns ``y_true`` (0/1) and ``y_prob``.

Scores are collapsed to distinct values first; running counts along the score order then
give every rank-based result without a one-task sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.operators.ordering import running_sums
from ebbtide.runtime import one_row


def score(model: PipelineModel, df: DataFrame, label: str = fv.LABEL, threshold: float = 0.5) -> DataFrame:
    """Add the churn probability, the truth and the prediction at a threshold (``>=``)."""
    probability = vector_to_array(F.col("probability"))[1]
    return model.transform(df).withColumns({
        "y_true": F.col(label).cast("int"),
        "y_prob": probability,
        "y_pred": (probability >= threshold).cast("int"),
    })


def _ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from ``tp``, ``fp`` and ``fn``; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": _ratio_or_zero(tp, tp + fp),
        "recall": _ratio_or_zero(tp, tp + fn),
        "f1": _ratio_or_zero(2 * tp, 2 * tp + fp + fn),
    })


def confusion(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives and negatives at a threshold, and rows flagged."""
    flagged, churned = F.col("y_prob") >= threshold, F.col("y_true") == 1
    return scored.groupBy(*by).agg(
        F.count_if(~flagged & ~churned).alias("tn"),
        F.count_if(flagged & ~churned).alias("fp"),
        F.count_if(~flagged & churned).alias("fn"),
        F.count_if(flagged & churned).alias("tp"),
        F.count_if(flagged).alias("flagged"),
    )


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same as rows ``(actual, predicted, count)``."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    stacked = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("count"))
        for a, p, c in cells
    ])
    return confusion(scored, threshold).select(F.inline(stacked))


def _by_score(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by, "y_prob").agg(
        F.sum("y_true").cast("bigint").alias("pos"),
        F.sum(1 - F.col("y_true")).cast("bigint").alias("neg"),
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL where a class is missing.

    One order over (group, score) serves all groups: a group's own running count is the common
    one less what came before the group.
    """
    rows = scored.withColumn("neg", 1 - F.col("y_true"))
    placed = running_sums(_by_score(scored, by), [*by, "y_prob"], ["neg"], rows)
    pos, neg, cum = F.col("pos"), F.col("neg"), F.col("cum_neg")
    sums = placed.groupBy(*by).agg(
        F.sum(pos * (cum - neg / 2)).alias("_won"),
        F.min(cum - neg).alias("_before"),
        F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg"),
    )
    wins = F.col("_won") - F.col("_before") * F.col("_pos")
    return sums.select(
        *by, F.try_divide(wins, (F.col("_pos") * F.col("_neg")).cast("double")).alias("roc_auc")
    )


def binary_metrics(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and ROC-AUC, per group where ``by`` is given."""
    rates = with_rates(confusion(scored, threshold, by)).select(
        *by, "precision", "recall", F.col("f1").alias("f1_score")
    )
    area = roc_auc(scored, by)
    if by:
        return rates.join(area, list(by))
    return rates.withColumn("roc_auc", area.scalar())


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    c = {name: F.col(name) for name in ("tp", "fp", "fn", "tn")}
    counts = confusion(scored, threshold).withColumn("n", c["tp"] + c["fp"] + c["fn"] + c["tn"])

    def rates(hit: Column, wrong: Column, missed: Column) -> list[Column]:
        return [
            _ratio_or_zero(hit, hit + wrong), _ratio_or_zero(hit, hit + missed),
            _ratio_or_zero(2 * hit, 2 * hit + wrong + missed),
        ]

    stay, churn = rates(c["tn"], c["fn"], c["fp"]), rates(c["tp"], c["fp"], c["fn"])
    n_stay, n_churn = c["tn"] + c["fp"], c["tp"] + c["fn"]
    accuracy = _ratio_or_zero(c["tp"] + c["tn"], F.col("n"))
    macro = [(a + b) / 2 for a, b in zip(stay, churn)]
    weighted = [_ratio_or_zero(a * n_stay + b * n_churn, F.col("n")) for a, b in zip(stay, churn)]
    lines = [
        ("0", stay, n_stay), ("1", churn, n_churn), ("accuracy", [accuracy] * 3, F.col("n")),
        ("macro avg", macro, F.col("n")), ("weighted avg", weighted, F.col("n")),
    ]
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
            f.alias("f1_score"), support.alias("support"),
        )
        for name, (p, r, f), support in lines
    ])))


def _descending(scored: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Distinct scores from the top, with rows and positives at or above each, and the totals."""
    stepped = _by_score(scored).withColumns({"_down": -F.col("y_prob"), "step": F.lit(1)})
    totals = one_row(stepped.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("step").alias("steps")))
    return running_sums(stepped, ["_down"], ["pos", "neg", "step"]), {c: totals[c] for c in ("pos", "neg", "steps")}


def roc_curve(scored: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """ROC points from (0, 0) on. A point halfway on a straight run can be left out."""
    steps, totals = _descending(scored)
    total_pos, total_neg, last = totals["pos"], totals["neg"], totals["steps"]
    kept = steps
    if drop_collinear:
        following = steps.select(
            (F.col("cum_step") - 1).alias("cum_step"),
            F.col("pos").alias("_next_pos"), F.col("neg").alias("_next_neg"),
        )
        straight = (F.col("pos") == F.col("_next_pos")) & (F.col("neg") == F.col("_next_neg"))
        kept = steps.join(following, "cum_step", "left").filter(
            ~F.coalesce(straight, F.lit(False)) | (F.col("cum_step") == last)
        )
    points = kept.select(
        F.col("y_prob").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), total_neg.cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), total_pos.cast("double")).alias("tpr"),
    )
    start = scored.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return start.unionByName(points)


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, and the closing point (1, 0)."""
    steps, totals = _descending(scored)
    total_pos = totals["pos"]
    points = steps.select(
        F.col("y_prob").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.coalesce(
            F.try_divide(F.col("cum_pos").cast("double"), total_pos.cast("double")), F.lit(1.0)
        ).alias("recall"),
    )
    end = scored.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "threshold double, precision double, recall double"
    )
    return points.unionByName(end)


def threshold_sweep(scored: DataFrame, lo: float = 0.1, hi: float = 0.9, n: int = 81) -> DataFrame:
    """Precision, recall and F1 at ``n`` even cut-offs.

    Each row counts once, at the highest cut-off it passes; sums from the top over the few
    cut-offs give the rest.
    """
    step = (hi - lo) / (n - 1)
    # a score within rounding of a cut-off passes it
    passed = F.least(F.floor((F.col("y_prob") - lo) / step + 1e-9), F.lit(n - 1))
    counted = (
        scored.groupBy(F.greatest(passed, F.lit(-1)).alias("cell"))
        .agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    )
    positives = counted.agg(F.sum("pos").alias("pos")).scalar()
    grid = scored.sparkSession.range(0, n, numPartitions=1).withColumnRenamed("id", "cell")
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    sums = grid.join(counted, "cell", "left").select(
        F.round(F.lit(lo) + F.col("cell") * step, 10).alias("threshold"),
        total("pos").alias("tp"), total("neg").alias("fp"),
    )
    return (
        with_rates(sums.withColumn("fn", positives - F.col("tp")))
        .select("threshold", "precision", "recall", "f1")
        .orderBy("threshold")
    )


def choose_threshold(sweep: DataFrame, precision_floor: float = 0.25) -> DataFrame:
    """The cut-off with most recall among those precise enough, else the one with the best F1.

    On equal recall the better F1 wins, then the lower cut-off.
    """
    row = F.struct("threshold", "precision", "recall", "f1")
    precise = F.col("precision") >= precision_floor
    lower = -F.col("threshold")
    best = sweep.agg(
        F.max_by(F.when(precise, row), F.when(precise, F.struct("recall", "f1", lower))).alias("precise"),
        F.max_by(row, F.struct("f1", lower)).alias("fallback"),
    )
    chosen = F.coalesce("precise", "fallback")
    return best.select(
        *[chosen[c].alias(c) for c in ("threshold", "precision", "recall", "f1")],
        F.col("precise").isNotNull().alias("meets_floor"),
    )


def at_threshold(sweep: DataFrame, threshold: float) -> DataFrame:
    return sweep.filter(F.round("threshold", 6) == round(threshold, 6))
