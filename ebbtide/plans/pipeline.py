"""The whole run: raw transactions to customer base, labelled table, model and reports.

Each step takes and returns DataFrames; ``run`` writes them under one folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ebbtide import fixed_values as fv
from ebbtide.functions.scalars import canonical_id
from ebbtide.operators import (
    churn, customers, drivers, evaluation, features, modelling, quality, splitting, statistics, trends,
)
from ebbtide.plans.reporting import DESCRIPTIONS, run_metadata
from ebbtide.runtime import materialized
from ebbtide.sources import sinks
from ebbtide.sources.transactions import resolve_observation_date, typed_transactions


@dataclass(frozen=True)
class Prepared:
    """Typed raw lines, clean lines under both price names, and the customer base."""

    tx: DataFrame
    clean: DataFrame
    unit_priced: DataFrame
    base: DataFrame


def prepare(raw: DataFrame) -> Prepared:
    tx = materialized(typed_transactions(raw))
    clean = materialized(quality.clean_transactions(tx))
    unit_priced = clean.withColumnRenamed("price", "unit_price")
    return Prepared(tx, clean, unit_priced, customers.stored_customer_base(clean))


def describe_customers(prepared: Prepared, metadata: DataFrame | None = None) -> DataFrame:
    """Full-history features as of the day after the observation date."""
    # this step alone takes ids as numbers; the churn steps keep them as text
    lines = prepared.unit_priced.withColumn("customer_id", canonical_id(prepared.unit_priced["customer_id"], "numeric"))
    bought = quality.purchases(lines, "positive", features.PRICE)
    snapshot = features.descriptive_snapshot(resolve_observation_date(bought, metadata))
    return features.customer_features(lines, snapshot)


def label(prepared: Prepared) -> DataFrame:
    windows = churn.derived_windows(prepared.unit_priced)
    return materialized(churn.modeling_dataset(prepared.unit_priced, windows))


@dataclass(frozen=True)
class Selected:
    """The comparison of the candidates, the tuned front-runner, and the split it saw."""

    comparison: DataFrame
    model: PipelineModel
    train: DataFrame
    test: DataFrame


def select_model(
    table: DataFrame, models: Sequence[str] = modelling.BASELINES, n_iter: int = 25, k: int = 5
) -> Selected:
    """Compare the candidates on the training rows, then tune the best."""
    train, test = splitting.stratified_split(table)
    comparison = materialized(modelling.cross_validate(train, modelling.baseline_trials(models), k))
    model = modelling.tune(train, modelling.best_name(comparison), n_iter=n_iter, k=k)
    return Selected(comparison, model, train, test)


def interpret(
    selected: Selected, repeats: int = 10, actions: Mapping[str, str] | None = None, default: str = ""
) -> dict[str, DataFrame]:
    """Everything said about the tuned model, from the held-out rows.

    ``actions`` names a treatment by feature; the others get ``default``.
    """
    columns, _ = modelling.feature_columns(selected.test)
    scored = materialized(evaluation.score(selected.model, selected.test).select("y_true", "y_prob"))
    sweep = evaluation.threshold_sweep(scored)
    importance = materialized(
        drivers.permutation_importance(selected.model, selected.test, columns, repeats)
    )
    correlation = statistics.corr_with_label(selected.test, columns, fv.LABEL)
    return {
        "final_metrics": evaluation.binary_metrics(scored),
        "classification_report": evaluation.classification_report(scored),
        "roc_curve": evaluation.roc_curve(scored),
        "pr_curve": evaluation.pr_curve(scored),
        "threshold_sweep": sweep,
        "operating_point": evaluation.choose_threshold(sweep),
        "feature_importance": importance,
        "recommendations": drivers.retention_recommendations(importance, correlation, actions or {}, default),
        "predictions": sinks.export_predictions(scored),
    }


def run(
    raw: DataFrame, folder: str, fmt: str = "parquet", models: Sequence[str] = modelling.BASELINES,
    n_iter: int = 25, k: int = 5, repeats: int = 10, actions: Mapping[str, str] | None = None, default: str = "",
) -> None:
    """Write every result table, the split and the tuned model under ``folder``."""
    prepared = prepare(raw)
    metadata = materialized(run_metadata(prepared.tx, prepared.base))
    described = materialized(describe_customers(prepared, metadata))
    table = label(prepared)
    selected = select_model(table, models, n_iter, k)
    sold = quality.purchases(prepared.unit_priced, "not_return", features.PRICE)
    results = {
        "clean_transactions": prepared.unit_priced.drop("line_amount"),
        "customer_base": prepared.base,
        "customer_base_dictionary": sinks.data_dictionary(prepared.base, DESCRIPTIONS),
        "metadata": metadata,
        "customer_features": described,
        "customer_features_dictionary": sinks.data_dictionary(described, DESCRIPTIONS),
        "modeling_dataset": table,
        "modeling_dataset_dictionary": sinks.data_dictionary(table, DESCRIPTIONS),
        "churn_rate_by_threshold": churn.churn_rate_curve(sold),
        "monthly_revenue": trends.monthly_net_revenue(prepared.unit_priced, sold),
        "rfm_segments": customers.rfm_net_summary(prepared.base),
        "model_comparison": selected.comparison,
        **interpret(selected, repeats, actions, default),
    }
    for name, result in results.items():
        sinks.write_table(result, f"{folder}/{name}", fmt)
    metrics = raw.sparkSession.read.format(fmt)
    if fmt == "csv":
        metrics = metrics.option("header", True).option("inferSchema", True)
    headline = metrics.load(f"{folder}/final_metrics")
    sinks.write_table(sinks.metrics_long(headline), f"{folder}/headline_metrics", fmt)
    sinks.write_metrics(headline, f"{folder}/final_metrics_json")
    sinks.write_split(selected.train, selected.test, folder, fmt)
    sinks.save_model(selected.model, f"{folder}/model")
