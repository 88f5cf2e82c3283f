from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from ebbtide.operators import drivers, modelling, ordering, splitting
from ebbtide.operators.evaluation import roc_auc, score
from ebbtide.runtime import checkpointed
from ebbtide.sources import sinks
from ebbtide.sources.transactions import load_model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 20, 300]
    y = (x[:, 0] + x[:, 1] / 20 + rng.logistic(size=300) > 0.6).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b", "noise"]).assign(churn_label=y, customer_id=[f"c{i}" for i in range(300)])
    return spark.createDataFrame(pdf)


def test_split_sizes_are_exact_disjoint_and_repeatable(table):
    train, test = splitting.stratified_split(table)
    ids = lambda f: {r["customer_id"] for r in f.collect()}
    assert len(ids(test)) == 60 and len(ids(train)) == 240 and not ids(train) & ids(test)
    assert ids(splitting.stratified_split(table.repartition(7))[1]) == ids(test)
    assert ids(splitting.stratified_split(table, seed=1)[1]) != ids(test)
    positives = table.filter("churn_label = 1").count()
    assert abs(train.filter("churn_label = 1").count() - positives * 0.8) < 1
    assert train.columns == table.columns


@pytest.mark.parametrize("n0, n1, want", [(7, 4, {0: 5, 1: 3}), (10, 1, {0: 7, 1: 1}), (5, 5, {0: 4, 1: 4})])
def test_quotas_by_largest_remainder(spark, n0, n1, want):
    frame = spark.createDataFrame([(0,)] * n0 + [(1,)] * n1, "churn_label int")
    got = {r["churn_label"]: r["train_rows"] for r in splitting.class_quotas(frame, "churn_label", 0.2).collect()}
    assert got == want


def test_folds_differ_by_at_most_one(table):
    sizes = splitting.with_folds(table).groupBy("fold").pivot("churn_label", [0, 1]).count().toPandas()
    assert len(sizes) == 5
    for c in ("0", "1"):
        assert sizes[c].max() - sizes[c].min() <= 1
    assert (sizes["0"] + sizes["1"]).tolist() == [60] * 5


def test_class_weights_balance(table):
    weighted = splitting.with_class_weight(table)
    totals = [r["w"] for r in weighted.groupBy("churn_label").agg(F.sum("class_weight").alias("w")).collect()]
    assert totals == pytest.approx([150.0, 150.0])


def test_preparation_uses_exact_medians_and_population_deviation(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (7.0, 5.0), (None, 5.0)], "x double, flat double")
    ready = modelling.preprocessor(frame, ["x", "flat"]).fit(frame).transform(frame)
    got = np.array([r[0] for r in ready.select(vector_to_array("features")).collect()])
    filled = np.array([1.0, 2.0, 4.0, 7.0, 3.0])
    assert sorted(got[:, 0]) == pytest.approx(sorted((filled - filled.mean()) / filled.std()))
    assert set(got[:, 1]) == {0.0}


def test_unknown_category_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "kind string")
    fitted = modelling.preprocessor(train, [], ["kind"]).fit(train)
    new = spark.createDataFrame([("a",), ("b",), (None,), ("zz",)], "kind string")
    got = [r[0] for r in fitted.transform(new).select(vector_to_array("features")).collect()]
    assert len(got[0]) == 2 and got[1] == got[2] and got[3] == [0.0, 0.0] and got[0] != got[1]


def newton(x, y, w, c):
    """Penalised weighted logistic regression with a free intercept."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = c * design.T @ (w * (p - y)) + penalty @ beta
        hessian = c * (design * (w * p * (1 - p))[:, None]).T @ design + penalty
        beta -= np.linalg.solve(hessian, gradient)
    return beta


@pytest.mark.parametrize("c", [0.01, 1.0])
def test_logistic_regression_solves_the_penalised_problem(table, c):
    fitted = modelling.fit(table, "logistic_regression", C=c, tol=1e-10)
    pdf = table.toPandas()
    x = pdf[["a", "b", "noise"]].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = pdf.churn_label.to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = newton(x, y, w, c)
    model = fitted.stages[-1]
    assert list(model.coefficients) + [model.intercept] == pytest.approx(want.tolist(), abs=1e-4)


def test_search_spaces():
    assert len(modelling.param_grid("logistic_regression")) == 5
    assert len(modelling.search_trials("logistic_regression")) == 5
    drawn = [t.label for t in modelling.search_trials("random_forest")]
    assert len(set(drawn)) == 25 and drawn == [t.label for t in modelling.search_trials("random_forest")]
    with pytest.raises(ValueError):
        modelling.candidate("unknown", 1.0)


def test_cross_validation_ranks_by_area(table):
    trials = [
        modelling.Trial("logistic", "logistic_regression"),
        modelling.Trial("forest", "random_forest", (("numTrees", 10), ("maxDepth", 3))),
        modelling.Trial("boosted", "gradient_boosting", (("maxIter", 3),)),
        modelling.Trial("histogram", "hist_gradient_boosting", (("maxIter", 3),)),
    ]
    rows = modelling.cross_validate(table, trials, k=3).collect()
    areas = [r["cv_roc_auc_mean"] for r in rows]
    assert len(rows) == 4 and areas == sorted(areas, reverse=True) and areas[0] > 0.7
    spark = table.sparkSession
    assert modelling.best_name(spark.createDataFrame(rows)) == rows[0]["model"]


def test_search_save_reload_and_hold_out(table, tmp_path):
    train, test = splitting.stratified_split(table)
    ranked, best = modelling.randomized_search(train, "logistic_regression", n_iter=2, k=3)
    assert ranked.count() == 2 and best.label == ranked.orderBy(F.desc("cv_roc_auc_mean"), "params").first()["params"]
    model = modelling.fit(train, best.model, **dict(best.params))
    path = str(tmp_path / "model")
    sinks.save_model(model, path)
    first = modelling.evaluate(model, test).first()
    assert modelling.evaluate(load_model(path), test).first() == first
    assert first["roc_auc"] > 0.7
    sinks.write_split(train, test, str(tmp_path / "split"))
    assert table.sparkSession.read.parquet(str(tmp_path / "split" / "test_split")).count() == 60


def test_importance_finds_what_matters(table):
    model = modelling.fit(table, "logistic_regression")
    rows = drivers.permutation_importance(model, table, ["a", "b", "noise"], repeats=3).collect()
    assert {rows[0]["feature"], rows[1]["feature"]} == {"a", "b"}
    assert abs(rows[2]["importance_mean"]) < 0.02 < rows[1]["importance_mean"]


def test_permutation_moves_one_feature_and_keeps_its_values(table):
    shuffled = drivers.permuted(table, ["a", "b"], 2, 42, "customer_id").toPandas()
    original = table.toPandas()
    assert len(shuffled) == 300 * 2 * 2
    one = shuffled[(shuffled.feature == "a") & (shuffled.repeat == 1)]
    assert sorted(one.a) == pytest.approx(sorted(original.a))
    pairs = set(zip(original.a, original.b))
    assert sum((a, b) in pairs for a, b in zip(one.a, one.b)) < 30
    assert sorted(zip(one.b, one.churn_label)) == sorted(zip(original.b, original.churn_label))


def test_recommendations(spark):
    importance = spark.createDataFrame(
        [("recency_days", 0.3, 0.0), ("active_months", 0.2, 0.0), ("other", 0.1, 0.0), ("tail", 0.01, 0.0)],
        "feature string, importance_mean double, importance_std double")
    correlation = spark.createDataFrame([("recency_days", 0.4), ("active_months", -0.2), ("other", None)], "feature string, correlation double")
    rows = drivers.retention_recommendations(importance, correlation, {"recency_days": "call"}, "review", top=3).collect()
    assert [r["risk_signal"] for r in rows] == [
        "higher recency_days -> more likely to churn", "lower active_months -> more likely to churn",
        "lower other -> more likely to churn"]
    assert [r["recommended_action"] for r in rows] == ["call", "review", "review"]


def test_scores_flag_at_the_threshold(table):
    model = modelling.fit(table, "logistic_regression")
    out = score(model, table, threshold=0.3)
    assert out.filter((F.col("y_prob") >= 0.3) != (F.col("y_pred") == 1)).count() == 0


def test_the_gradient_vanishes_at_the_fit_alone(table):
    model = modelling.fit(table, "logistic_regression")
    assert modelling.logistic_gradient(model, table).first()["largest_gradient"] < 1e-4
    early = modelling.fit(table, "logistic_regression", maxIter=1)
    assert modelling.logistic_gradient(early, table).first()["largest_gradient"] > 1e-3


def test_folds_are_prepared_by_their_training_rows(spark, table):
    folds = modelling.prepared_folds(table, k=3)
    numeric, _ = modelling.feature_columns(table)
    for fold in range(3):
        rows = folds.filter((F.col("fold") == fold) & ~F.col("held_out")).select("features", "class_weight").toPandas()
        x = np.array([f.toArray() for f in rows["features"]])[:, :len(numeric)]
        assert x.mean(axis=0) == pytest.approx(0, abs=1e-9)
        assert all(s == pytest.approx(1) or s == pytest.approx(0) for s in x.std(axis=0)) and rows["class_weight"].notna().all()
    held = folds.filter("held_out")
    assert held.count() == table.count() and held.filter("class_weight IS NOT NULL").count() == 0


@pytest.mark.parametrize("name, params", [("logistic_regression", {}), ("random_forest", {"numTrees": 4, "maxDepth": 3}), ("gradient_boosting", {"maxIter": 2})])
def test_importance_equals_scoring_all_changed_rows(spark, table, name, params):
    numeric, categorical = modelling.feature_columns(table)
    columns = [*numeric, *categorical]
    model = modelling.fit(table, name, **params)
    found = {r["feature"]: r["importance_mean"] for r in drivers.permutation_importance(model, table, columns, repeats=2).collect()}
    again = {r["feature"]: r["importance_mean"] for r in drivers.rescored_importance(model, table, columns, repeats=2).collect()}
    assert set(found) == set(columns) and found == pytest.approx(again, abs=1e-9)


def test_places_of_columns_in_the_vector(spark):
    frame = spark.createDataFrame([(str(i), i % 2, float(i), "abc"[i % 3], float(i * i)) for i in range(12)], "customer_id string, churn_label int, a double, kind string, b double")
    model = modelling.fit(frame, "logistic_regression")
    assert drivers.feature_places(model) == {"a": range(0, 1), "b": range(1, 2), "kind": range(2, 5)}
    found = drivers.permutation_importance(model, frame, ["a", "b", "kind"], repeats=2).collect()
    again = {r["feature"]: r["importance_mean"] for r in drivers.rescored_importance(model, frame, ["a", "b", "kind"], repeats=2).collect()}
    assert {r["feature"]: r["importance_mean"] for r in found} == pytest.approx(again, abs=1e-9)


def test_a_forest_keeps_the_place_of_each_row(table):
    ready = modelling.preprocessor(table, ["a", "b", "noise"]).fit(table).transform(splitting.with_class_weight(table)).cache()
    text = lambda **p: modelling.candidate("random_forest", 300.0, numTrees=3, maxDepth=8, **p).fit(ready).toDebugString.split("\n", 1)[1]
    assert modelling.candidate("random_forest", 1.0).getCacheNodeIds()
    assert text() == text(cacheNodeIds=False)


def test_a_model_scores_its_rows_before_the_next_is_fitted(table, monkeypatch):
    seen, fitted, written = [], modelling.Trial.build, DataFrameWriter.parquet
    monkeypatch.setattr(modelling.Trial, "build", lambda *a: seen.append("fit") or fitted(*a))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: seen.append("write") or written(*a, **k))
    scores = modelling.out_of_fold_scores(table, [modelling.Trial(f"C={c}", "logistic_regression", (("C", c),)) for c in (1, 2)], k=2, parallelism=1)
    assert seen[seen.index("fit"):] == ["fit", "write"] * 4
    assert {(r["model"], r["count"]) for r in scores.groupBy("model").count().collect()} == {("C=1", 300), ("C=2", 300)}


def test_a_session_without_a_checkpoint_folder_gets_one():
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=(found := []).append, master="local[1]")
    checkpointed(SimpleNamespace(sparkContext=context, conf={"spark.sql.warehouse.dir": "/w"}))
    assert len(found) == 1 and found[0].startswith("/w/ebbtide/")


def test_changed_rows_are_scored_once(spark, table):
    model, scored = modelling.fit(table, "logistic_regression"), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        scored.add(1)
        return value

    rows = table.withColumn("_group", F.lit(0)).withColumn("y_true", F.col("churn_label").cast("int"))
    areas = drivers._areas_by_feature(rows.select("_group", "y_true", counted("a").alias("y_prob")), ["a"], 1).collect()
    assert scored.value == 300 and len(areas) == 1 and areas[0]["feature"] == "a" and areas[0]["repeat"] == 0
    again = {r["feature"]: r["importance_mean"] for r in drivers.rescored_importance(model, table, ["a", "b", "noise"], repeats=2).collect()}
    assert again["a"] > 0.1 > abs(again["noise"])


@pytest.mark.parametrize("ties", [1, 50])
def test_an_area_takes_its_cuts_and_totals_from_the_scored_rows(spark, ties, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 900), "y_true": rng.integers(0, 2, 900), "y_prob": rng.integers(-900, 900, 900) // ties / 1.0})
    seen, cuts = [], ordering._cuts
    monkeypatch.setattr(ordering, "_cuts", lambda df, keys: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or cuts(df, keys))
    got = {r["g"]: r["roc_auc"] for r in roc_auc(spark.createDataFrame(pdf), ["g"]).collect()}
    for g, of in pdf.groupby("g"):
        pos, neg = of.y_prob[of.y_true == 1].to_numpy()[:, None], of.y_prob[of.y_true == 0].to_numpy()[None, :]
        assert got[g] == pytest.approx(((pos > neg) + (pos == neg) / 2).mean(), abs=1e-12)
    assert len(seen) == 1 and "Aggregate" not in seen[0]
