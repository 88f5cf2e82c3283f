"""Plans of operators on row-grain input: what must not be in them."""

import io
from contextlib import redirect_stdout

import pytest

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from ebbtide.operators import churn, concentration, customers, distributions, evaluation, features, gaps, ordering, quality, returns, statistics, summaries, trends
from ebbtide.runtime import materialized


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def clean(lines):
    return materialized(quality.clean_transactions(lines([
        (str(i), f"S{i % 3}", "d", 1 + i % 4, f"2020-01-{1 + i % 28:02d} 10:00:00", 2.0, f"c{i % 9}", "X") for i in range(60)
    ])))


CASES = {
    "purchase_totals": lambda c: customers.customer_totals(c),
    "gaps_invoice": lambda c: gaps.purchase_gaps(c, "invoice"),
    "gaps_day": lambda c: gaps.purchase_gaps(c, "day"),
    "reconcile": lambda c: returns.reconcile_returns(quality.returns(c), quality.purchases(c)),
    "cohorts": lambda c: trends.with_cohort(c),
    "months": lambda c: trends.monthly_trend(c).orderBy("order_month"),
    "ecdf": lambda c: distributions.ecdf(c, "quantity"),
    "lorenz": lambda c: concentration.lorenz(c, "line_amount"),
    "labels": lambda c: churn.class_balance(c, "country"),
}


@pytest.mark.parametrize("name", CASES)
def test_no_python_and_no_product(clean, name):
    text = plan(CASES[name](clean))
    for unwanted in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text, unwanted


@pytest.mark.parametrize("name", ["purchase_totals", "gaps_invoice", "gaps_day", "cohorts"])
def test_rows_are_never_gathered_in_one_partition(clean, name):
    nodes = plan(CASES[name](clean)).split("\n\n")
    gathered = [node for node in nodes if "SinglePartition" in node]
    # only the totals of the range partitions, one row for each, may be
    assert all("_part#" in node.split("Arguments")[0] for node in gathered), gathered


ONE_ORDER = {
    "purchase_gaps_invoice": lambda c: gaps.purchase_gaps(c, "invoice"),
    "gini": lambda c: concentration.gini(c, "line_amount"),
    "roc_auc": lambda c: evaluation.roc_auc(c.select(F.col("quantity").alias("y_prob"), (F.col("price") > 1).cast("int").alias("y_true"))),
    "ranked": lambda c: ordering.ranked(c, ["line_amount", "invoice_no"]),
}


@pytest.mark.parametrize("name", ONE_ORDER)
def test_an_order_shuffles_its_rows_once_and_writes_nothing(clean, monkeypatch, name):
    monkeypatch.setattr(DataFrameWriter, "parquet", None)
    nodes = plan(ONE_ORDER[name](clean)).split("\n\n")
    exchanges = [n for n in nodes if " Exchange\n" in n.split("Arguments")[0]]
    windows = [n for n in nodes if n.startswith("(") and " Window\n" in n]
    # by part: the rows for their window, and the totals of the parts, one row each per task
    by_part = [n for n in exchanges if "hashpartitioning(_part#" in n]
    assert not any("rangepartitioning" in n for n in exchanges)
    assert len(by_part) <= 2 and windows, exchanges
    rows = [n for n in by_part if not any(w in n for w in ("sum#", "count#", "extremumOrdering"))]
    assert len(rows) <= 1, rows


def test_filters_and_columns_reach_the_scan(clean):
    text = plan(quality.purchases(clean).select("customer_id", "line_amount"))
    pushed = text.split("PushedFilters:")[1].split("\n")[0]
    assert "GreaterThan(quantity,0)" in pushed and "GreaterThan(price,0.0)" in pushed
    assert "description" not in text.split("ReadSchema:")[1]


def test_window_literals_reach_the_scan(clean):
    windows = churn.derived_windows(clean.withColumnRenamed("price", "unit_price"))
    text = plan(clean.filter(clean.invoice_date <= windows.snapshot))
    assert "LessThanOrEqual(invoice_date,2019-" in text


def test_cleaning_filters_run_before_the_shuffle(lines):
    tx = materialized(lines([("1", "A", "d", 1, "2020-01-01 10:00:00", 2.0, "c", "X")]))
    text = plan(quality.clean_transactions(tx))
    assert "IsNotNull(customer_id)" in text
    assert text.count("hashpartitioning") == 1


def test_summaries_neither_sort_nor_multiply_rows(clean):
    columns = ["quantity", "price", "line_amount"]
    rank = summaries._Rank(0, 30, 1.0, 3.0)
    rank.rows = 40
    passes = [
        summaries.sketched(clean, columns, [0.25, 0.5]), summaries.bounds_counted(clean, columns, {0: [1.0, 2.0], 2: [5.0]}),
        summaries.gathered(clean, columns, {(0, 1.0, 3.0): [2], (1, None, None): [0, 7]}), summaries.narrowed(clean, columns, [rank]),
    ]
    for df in passes:
        text = plan(df)
        assert "Generate" not in text and "Sort\n" not in text and "hashpartitioning" not in text and "rangepartitioning" not in text


@pytest.mark.parametrize("of", [
    lambda c, cols: distributions.describe_numeric(c, cols), lambda c, cols: distributions.tail_summary(c, cols),
    lambda c, cols: distributions.box_stats(c, cols), lambda c, cols: statistics.correlations(c, cols),
    lambda c, cols: statistics.skew_rank(c, cols), lambda c, cols: statistics.corr_with_label(c, cols, "quantity"),
])
def test_rows_are_multiplied_after_aggregation_alone(clean, of):
    nodes = plan(of(clean, ["quantity", "price", "line_amount"])).split("\n\n")
    scans = [n for n in nodes if "Scan parquet" in n]
    generated = [n for n in nodes if "Generate\n" in n.split("Input")[0]]
    assert all("quantity#" not in n.split("Arguments")[0] for n in generated), generated
    assert not any("hashpartitioning(column" in n for n in nodes) or not scans


@pytest.mark.parametrize("of", [
    customers.customer_totals, customers.customer_purchases,
    lambda c: features.customer_features(c.withColumnRenamed("price", "unit_price"), F.lit("2020-03-01").cast("timestamp_ntz")),
    lambda c: churn.modeling_dataset(c.withColumnRenamed("price", "unit_price"), churn.derived_windows(c.withColumnRenamed("price", "unit_price"))),
])
def test_distinct_counts_do_not_multiply_rows(clean, of):
    text = plan(of(clean))
    assert "Expand" not in text and "partial_count(distinct" not in text
