import numpy as np
import pandas as pd
import pytest

from ebbtide.operators import evaluation as ev


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.4).astype(int)
    return pd.DataFrame({"y_true": y, "y_prob": np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)})


@pytest.fixture
def scored(spark, scores):
    return spark.createDataFrame(scores)


def rates(y, flagged):
    tp, fp, fn = (y & flagged).sum(), (~y & flagged).sum(), (y & ~flagged).sum()
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def pairwise_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos])


def test_metrics(scored, scores):
    row = ev.binary_metrics(scored, 0.45).first()
    y, flagged = scores.y_true.to_numpy() == 1, scores.y_prob.to_numpy() >= 0.45
    assert (row["precision"], row["recall"], row["f1_score"]) == pytest.approx(rates(y, flagged))
    assert row["roc_auc"] == pytest.approx(pairwise_auc(scores.y_true, scores.y_prob))


def test_metrics_per_group(spark, scores):
    parts = scores.assign(part=np.arange(400) % 3)
    got = ev.binary_metrics(spark.createDataFrame(parts), by=["part"]).collect()
    assert len(got) == 3
    for row in got:
        part = parts[parts.part == row["part"]]
        assert row["roc_auc"] == pytest.approx(pairwise_auc(part.y_true, part.y_prob))


def test_all_scores_tied_and_one_class(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y_true int, y_prob double")
    assert ev.roc_auc(tied).first()[0] == 0.5
    only = spark.createDataFrame([(1, 0.5), (1, 0.2)], "y_true int, y_prob double")
    assert ev.roc_auc(only).first()[0] is None


def test_nothing_flagged(scored):
    row = ev.binary_metrics(scored, 2.0).first()
    assert (row["precision"], row["recall"], row["f1_score"]) == (0.0, 0.0, 0.0)


def test_confusion_adds_up_and_threshold_is_inclusive(scored, scores):
    cells = {(r["actual"], r["predicted"]): r["count"] for r in ev.confusion_matrix(scored, 0.5).collect()}
    assert sum(cells.values()) == 400
    assert cells[1, 1] + cells[0, 1] == (scores.y_prob >= 0.5).sum() == ev.confusion(scored, 0.5).first()["flagged"]


def test_report(scored, scores):
    rows = {r["class"]: r for r in ev.classification_report(scored).collect()}
    y, flagged = scores.y_true.to_numpy() == 1, scores.y_prob.to_numpy() >= 0.5
    for name, want in (("1", rates(y, flagged)), ("0", rates(~y, ~flagged))):
        assert (rows[name]["precision"], rows[name]["recall"], rows[name]["f1_score"]) == pytest.approx(want)
    assert rows["accuracy"]["precision"] == pytest.approx((y == flagged).mean())
    weighted = ((~y).sum() * rows["0"]["f1_score"] + y.sum() * rows["1"]["f1_score"]) / 400
    assert rows["weighted avg"]["f1_score"] == pytest.approx(weighted)


def test_sweep_equals_counting_per_cut_off(scored, scores):
    y, p = scores.y_true.to_numpy() == 1, scores.y_prob.to_numpy()
    sweep = ev.threshold_sweep(scored).collect()
    assert len(sweep) == 81
    for row in sweep:
        want = rates(y, p >= round(row["threshold"], 2))
        assert (row["precision"], row["recall"], row["f1"]) == pytest.approx(want), row["threshold"]


def test_operating_point(spark):
    sweep = spark.createDataFrame(
        [(0.1, 0.2, 1.0, 0.3), (0.2, 0.3, 0.9, 0.45), (0.3, 0.4, 0.9, 0.55), (0.4, 0.8, 0.2, 0.32)],
        "threshold double, precision double, recall double, f1 double")
    pick = lambda floor: tuple(ev.choose_threshold(sweep, floor).select("threshold", "meets_floor").first())
    assert pick(0.25) == (0.3, True)
    assert pick(0.9) == (0.3, False)
    assert ev.at_threshold(sweep, 0.2).first()["recall"] == 0.9


def test_curves(scored, scores):
    roc = ev.roc_curve(scored, drop_collinear=False).toPandas().sort_values(["fpr", "tpr"])
    area = ((roc.tpr.to_numpy()[1:] + roc.tpr.to_numpy()[:-1]) / 2 * np.diff(roc.fpr)).sum()
    assert area == pytest.approx(pairwise_auc(scores.y_true, scores.y_prob))
    assert len(roc) == scores.y_prob.nunique() + 1
    pr = ev.pr_curve(scored).toPandas()
    y, p = scores.y_true.to_numpy() == 1, scores.y_prob.to_numpy()
    for row in pr.dropna().itertuples():
        assert (row.precision, row.recall) == pytest.approx(rates(y, p >= row.threshold)[:2])
    assert len(pr) == scores.y_prob.nunique() + 1


def test_points_on_a_straight_run_are_left_out(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    roc = ev.roc_curve(spark.createDataFrame(rows, "y_true int, y_prob double"))
    got = sorted((r["fpr"], r["tpr"]) for r in roc.collect())
    assert got == [(0.0, 0.0), (0.0, 0.75), (1.0, 0.75), (1.0, 1.0)]
