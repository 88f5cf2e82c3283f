"""Registered queries against their SQL on the smallest test tables, where they are present."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
# one or two per module; `check.py` runs all of them
SAMPLE = [
    "normalized_transactions", "cleaning_waterfall", "customer_base", "return_reconciliation", "purchase_gaps_invoice",
    "customer_features", "modeling_dataset", "churn_rate_curve", "monthly_net_revenue", "cohort_retention",
    "tail_summary", "gini_customers", "corr_matrix", "stratified_split", "roc_curve", "threshold_sweep",
]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for name in check.TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert check.compare(got, tables.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_whole_run(spark, tables, tmp_path):
    from ebbtide.plans.pipeline import run
    from ebbtide.sources.fixtures import raw_transactions
    from ebbtide.sources.transactions import load_model

    out = str(tmp_path)
    run(raw_transactions(spark, FOLDER), out, models=["logistic_regression"], n_iter=2, k=2, repeats=2)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert read("customer_base").count() == read("modeling_dataset").count() == 150
    assert read("train_split").count() == 120 and read("test_split").count() == 30
    assert read("threshold_sweep").count() == 81 and read("recommendations").count() == 6
    assert read("churn_rate_by_threshold").count() == 31 and read("headline_metrics").count() == 4
    scored = load_model(f"{out}/model").transform(read("test_split"))
    assert scored.select("probability").count() == 30


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, tables):
    assert entry.entry(spark).count() == 150
