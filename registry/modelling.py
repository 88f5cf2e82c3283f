"""Splits, models, evaluation and drivers."""

from pyspark.sql import functions as F

from ebbtide.operators import drivers, evaluation, modelling, splitting, statistics
from ebbtide.operators.quality import column_profile
from ebbtide.runtime import materialized
from ebbtide.sources.sinks import export_predictions, metrics_long
from registry.analysis import MODEL_FEATURES
from registry.churn import stored_model_table
from registry.core import r, register, stable

# ---------------------------------------------------------------- splits and weights


@register("stratified_split", """
  WITH c AS (SELECT churn_label, count(*) AS n FROM model GROUP BY 1),
  q AS (SELECT *, n * (t - ceil(t * 0.2)) / t AS e, t - ceil(t * 0.2) AS train
        FROM c, (SELECT sum(n) AS t FROM c)),
  a AS (SELECT *, floor(e) + CAST(row_number() OVER (ORDER BY e - floor(e) DESC, churn_label)
          <= train - sum(floor(e)) OVER () AS INTEGER) AS train_n FROM q)
  SELECT churn_label, split, CAST(CASE split WHEN 'train' THEN train_n ELSE n - train_n END AS BIGINT) AS rows
  FROM a, (SELECT unnest(['train', 'test']) AS split)""")
def _(spark, folder):
    marked = splitting.with_split(stored_model_table(spark, folder))
    return marked.groupBy("churn_label", "split").agg(F.count(F.lit(1)).alias("rows"))


@register("fold_sizes", """
  WITH p AS (SELECT row_number() OVER (ORDER BY churn_label, customer_id) - 1 AS i, churn_label FROM model)
  SELECT CAST(i % 5 AS INTEGER) AS fold, churn_label, count(*) AS rows FROM p GROUP BY ALL""")
def _(spark, folder):
    folded = splitting.with_folds(stored_model_table(spark, folder))
    return folded.groupBy("fold", "churn_label").agg(F.count(F.lit(1)).alias("rows"))


@register("class_weights", f"""
  SELECT churn_label, n, {r('t / (2 * n)', 6)} AS class_weight
  FROM (SELECT churn_label, count(*) AS n FROM model GROUP BY 1), (SELECT count(*) AS t FROM model)""")
def _(spark, folder):
    return stable(splitting.class_weights(stored_model_table(spark, folder)), 6)


@register("positive_weight", f"""
  SELECT {r('count(*) FILTER (churn_label = 0) / count(*) FILTER (churn_label = 1)', 6)} AS scale_pos_weight FROM model""")
def _(spark, folder):
    return stable(splitting.positive_weight(stored_model_table(spark, folder)), 6)


@register("feature_columns", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'numeric' AS kind, count({c}) AS non_null FROM model" for c in MODEL_FEATURES) + ")")
def _(spark, folder):
    table = stored_model_table(spark, folder)
    numeric, other = modelling.feature_columns(table)
    kind = F.when(F.col("column").isin(numeric), "numeric").otherwise("categorical")
    return column_profile(table.select(*numeric, *other)).select("column", kind.alias("kind"), "non_null")


# ---------------------------------------------------------------- scores from a fixed rule

def scored(spark, folder):
    """Share of the relationship spent silent, in thousandths, as the churn score."""
    silent = F.col("recency_days") * 1000 / F.greatest("tenure_since_first", F.lit(1))
    return materialized(
        stored_model_table(spark, folder).select(
            "customer_id", F.col("churn_label").alias("y_true"),
            (F.floor(silent).cast("double") / 1000).alias("y_prob"),
        )
    )


CONFUSION = """SELECT count(*) FILTER (y_prob < {t} AND y_true = 0) AS tn,
  count(*) FILTER (y_prob >= {t} AND y_true = 0) AS fp, count(*) FILTER (y_prob < {t} AND y_true = 1) AS fn,
  count(*) FILTER (y_prob >= {t} AND y_true = 1) AS tp, count(*) FILTER (y_prob >= {t}) AS flagged FROM scored"""

AUC = """(SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps))"""


def _ratio(top: str, bottom: str) -> str:
    return f"coalesce(({top}) / nullif({bottom}, 0), 0.0)"


PRECISION, RECALL = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
F1 = _ratio("2.0 * tp", "2 * tp + fp + fn")


@register("scored_customers", "SELECT customer_id, y_true, y_prob FROM scored")
def _(spark, folder):
    return scored(spark, folder)


@register("predictions_export", "SELECT y_true, round(y_prob, 4) AS y_prob FROM scored")
def _(spark, folder):
    return export_predictions(scored(spark, folder))


@register("confusion_counts", CONFUSION.format(t=0.3))
def _(spark, folder):
    return evaluation.confusion(scored(spark, folder), 0.3)


@register("confusion_matrix", f"""
  SELECT unnest([0, 0, 1, 1]) AS actual, unnest([0, 1, 0, 1]) AS predicted, unnest([tn, fp, fn, tp]) AS count
  FROM ({CONFUSION.format(t=0.5)})""")
def _(spark, folder):
    return evaluation.confusion_matrix(scored(spark, folder))


@register("roc_auc", f"SELECT {r(AUC, 6)} AS roc_auc")
def _(spark, folder):
    return stable(evaluation.roc_auc(scored(spark, folder)), 6)


METRICS = f"""SELECT {r(PRECISION, 6)} AS "precision", {r(RECALL, 6)} AS recall, {r(F1, 6)} AS f1_score,
  {r(AUC, 6)} AS roc_auc FROM ({CONFUSION.format(t=0.5)})"""


@register("binary_metrics", METRICS)
def _(spark, folder):
    return stable(evaluation.binary_metrics(scored(spark, folder)), 6)


@register("headline_metrics", f"UNPIVOT ({METRICS}) ON COLUMNS(*) INTO NAME metric VALUE value")
def _(spark, folder):
    return metrics_long(stable(evaluation.binary_metrics(scored(spark, folder)), 6))


@register("classification_report", f"""
  WITH c AS ({CONFUSION.format(t=0.5)}),
  k AS (SELECT {_ratio('tn', 'tn + fn')} AS p0, {_ratio('tn', 'tn + fp')} AS r0, {_ratio('2.0 * tn', '2 * tn + fp + fn')} AS f0,
    {PRECISION} AS p1, {RECALL} AS r1, {F1} AS f1, tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS n,
    (tp + tn) / (tn + fp + fn + tp) AS acc FROM c)
  SELECT class, {r('p', 6)} AS "precision", {r('q', 6)} AS recall, {r('f', 6)} AS f1_score, support FROM (
    SELECT unnest(['0', '1', 'accuracy', 'macro avg', 'weighted avg']) AS class,
      unnest([p0, p1, acc, (p0 + p1) / 2, (p0 * s0 + p1 * s1) / n]) AS p,
      unnest([r0, r1, acc, (r0 + r1) / 2, (r0 * s0 + r1 * s1) / n]) AS q,
      unnest([f0, f1, acc, (f0 + f1) / 2, (f0 * s0 + f1 * s1) / n]) AS f,
      unnest([s0, s1, n, n, n]) AS support FROM k)""")
def _(spark, folder):
    return stable(evaluation.classification_report(scored(spark, folder)), 6)


@register("roc_curve", f"""
  SELECT threshold, {r('fpr', 6)} AS fpr, {r('tpr', 6)} AS tpr FROM (
    SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL
    SELECT y_prob, fp / n, tp / p FROM (
      SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
        lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
      FROM steps WINDOW w AS (ORDER BY y_prob DESC))
    WHERE next_pos IS NULL OR pos <> next_pos OR neg <> next_neg)""")
def _(spark, folder):
    return stable(evaluation.roc_curve(scored(spark, folder)), 6)


@register("pr_curve", f"""
  SELECT threshold, {r('p', 6)} AS "precision", {r('q', 6)} AS recall FROM (
    SELECT CAST(NULL AS DOUBLE) AS threshold, 1.0 AS p, 0.0 AS q UNION ALL
    SELECT y_prob, sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w), sum(pos) OVER w / sum(pos) OVER ()
    FROM steps WINDOW w AS (ORDER BY y_prob DESC))""")
def _(spark, folder):
    return stable(evaluation.pr_curve(scored(spark, folder)), 6)


SWEEP = f"""(SELECT threshold, {PRECISION} AS p, {RECALL} AS q, {F1} AS f FROM (
  SELECT t AS threshold, count(*) FILTER (y_prob >= t AND y_true = 1) AS tp,
    count(*) FILTER (y_prob >= t AND y_true = 0) AS fp, count(*) FILTER (y_prob < t AND y_true = 1) AS fn
  FROM scored, (SELECT round(0.1 + 0.01 * i, 2) AS t FROM range(81) g(i)) GROUP BY t))"""


@register("threshold_sweep", f"""
  SELECT {r('threshold', 6)} AS threshold, {r('p', 6)} AS "precision", {r('q', 6)} AS recall, {r('f', 6)} AS f1 FROM {SWEEP}""")
def _(spark, folder):
    return stable(evaluation.threshold_sweep(scored(spark, folder)), 6)


def _operating_point(floor: float) -> str:
    return f"""SELECT {r('threshold', 6)} AS threshold, {r('p', 6)} AS "precision", {r('q', 6)} AS recall,
      {r('f', 6)} AS f1, p >= {floor} AS meets_floor FROM {SWEEP}
      ORDER BY p >= {floor} DESC, CASE WHEN p >= {floor} THEN q ELSE f END DESC, f DESC, threshold LIMIT 1"""


@register("operating_point", _operating_point(0.25))
def _(spark, folder):
    return stable(evaluation.choose_threshold(evaluation.threshold_sweep(scored(spark, folder))), 6)


@register("operating_point_fallback", _operating_point(0.999))
def _(spark, folder):
    sweep = evaluation.threshold_sweep(scored(spark, folder))
    return stable(evaluation.choose_threshold(sweep, 0.999), 6)


@register("sweep_at_half", f"""
  SELECT {r('threshold', 6)} AS threshold, {r('p', 6)} AS "precision", {r('q', 6)} AS recall, {r('f', 6)} AS f1
  FROM {SWEEP} WHERE threshold = 0.5""")
def _(spark, folder):
    sweep = evaluation.threshold_sweep(scored(spark, folder))
    return stable(evaluation.at_threshold(sweep, 0.5), 6)


# ---------------------------------------------------------------- fitted models (no SQL counterpart)

@register("cv_comparison")
def _(spark, folder):
    train, _test = splitting.stratified_split(stored_model_table(spark, folder))
    return modelling.cross_validate(train, modelling.baseline_trials())


# rows scored per setting and fold, each row once and by a model that did not see it
@register("cv_scored_rows", """
  WITH p AS (SELECT row_number() OVER (ORDER BY churn_label, customer_id) - 1 AS i, churn_label FROM model)
  SELECT s.model, CAST(i % 5 AS INTEGER) AS fold, churn_label AS y_true, count(*) AS rows
  FROM p, (SELECT unnest(['C=0.1', 'C=1']) AS model) s GROUP BY ALL""")
def _(spark, folder):
    trials = [modelling.Trial(f"C={c:g}", "logistic_regression", (("C", c),)) for c in (0.1, 1.0)]
    scores = modelling.out_of_fold_scores(stored_model_table(spark, folder), trials)
    return scores.groupBy("model", "fold", "y_true").agg(F.count(F.lit(1)).alias("rows"))


# at the least of a convex objective every derivative is 0
@register("logistic_gradient", f"""SELECT {len(MODEL_FEATURES) + 1} AS weights, round(0.0 * count(*), 3) AS largest_gradient FROM model""")
def _(spark, folder):
    table = stored_model_table(spark, folder)
    found = modelling.logistic_gradient(modelling.fit(table, "logistic_regression"), table)
    return found.withColumn("largest_gradient", F.round("largest_gradient", 3))


@register("randomized_search")
def _(spark, folder):
    train, _test = splitting.stratified_split(stored_model_table(spark, folder))
    return modelling.randomized_search(train, "logistic_regression")[0]


@register("holdout_metrics")
def _(spark, folder):
    train, test = splitting.stratified_split(stored_model_table(spark, folder))
    return modelling.evaluate(modelling.fit(train, "logistic_regression"), test)


def _importance(spark, folder):
    train, test = splitting.stratified_split(stored_model_table(spark, folder))
    model = modelling.fit(train, "logistic_regression")
    return test, drivers.permutation_importance(model, test, MODEL_FEATURES)


@register("permutation_importance")
def _(spark, folder):
    return _importance(spark, folder)[1]


# margins moved by weight x (donor - own) rank the rows as scoring all changed rows again does
@register("importance_recomputed", f"""
  SELECT feature, 0.0 AS difference FROM (SELECT unnest([{', '.join(f"'{c}'" for c in MODEL_FEATURES)}]) AS feature), (SELECT count(*) AS n FROM model) WHERE n > 0""")
def _(spark, folder):
    table = stored_model_table(spark, folder)
    model = modelling.fit(table, "logistic_regression")
    found = drivers.permutation_importance(model, table, MODEL_FEATURES, repeats=2).withColumnRenamed("importance_mean", "by_margin")
    again = drivers.rescored_importance(model, table, MODEL_FEATURES, repeats=2)
    return materialized(found).join(materialized(again), "feature").select("feature", (F.round(F.abs(F.col("by_margin") - F.col("importance_mean")), 6) + 0.0).alias("difference"))


# a permutation keeps a feature's values
@register("permuted_values", f"""
  SELECT feature, CAST(repeat AS INTEGER) AS repeat, n, {r('total', 2)} AS total, least, most FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, count({c}) AS n, sum({c}) AS total, {r(f'CAST(min({c}) AS DOUBLE)', 2)} AS least, {r(f'CAST(max({c}) AS DOUBLE)', 2)} AS most FROM model" for c in ("recency_days", "avg_gap_days", "net_spend"))}),
    (SELECT unnest([0, 1]) AS repeat)""")
def _(spark, folder):
    columns = ["recency_days", "avg_gap_days", "net_spend"]
    rows = drivers.permuted(stored_model_table(spark, folder), columns, 2, 7, "customer_id")
    value = F.coalesce(*[F.when(F.col("feature") == c, F.col(c).cast("double")) for c in columns])
    return stable(rows.groupBy("feature", "repeat").agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")), 2)


# what a feature's name says it measures
FAMILIES = {"recency": "recency", "frequency": "frequency", "unique": "breadth", "gap": "gaps", "return": "returns", "spend": "spend"}


@register("retention_recommendations")
def _(spark, folder):
    test, importance = _importance(spark, folder)
    correlation = statistics.corr_with_label(test, MODEL_FEATURES, "churn_label")
    actions = {f: f"review {family}" for f in MODEL_FEATURES for part, family in FAMILIES.items() if part in f}
    return drivers.retention_recommendations(importance, correlation, actions, "review")
