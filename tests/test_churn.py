import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import churn, features, gaps
from ebbtide.operators.quality import purchases
from ebbtide.sources.transactions import resolve_observation_date

PRICE = features.PRICE


def sale(invoice, at, customer, quantity=1, price=2.0, stock="A", description="a"):
    return (invoice, stock, description, quantity, at, price, customer, "X")


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("p90, expected", [(75, 60), (76, 90), (105, 120), (20, 60), (400, 120), (45, 60)])
def test_threshold_rounds_half_to_even_then_clamps(spark, p90, expected):
    found = spark.createDataFrame([(p90,)] * 3, "gap_days int")
    assert churn.churn_threshold(found).first()["threshold_days"] == expected


def test_windows_and_empty_label_window(lines):
    pur = lines([sale("1", "2020-01-01 09:00:00", "1"), sale("2", "2020-06-30 15:00:00", "1")], PRICE)
    row = churn.window_table(pur, F.lit(60)).first()
    assert [str(row[c]) for c in ("obs_start", "snapshot", "label_end")] == [
        "2020-01-01 00:00:00", "2020-05-01 00:00:00", "2020-06-30 15:00:00"]
    midnight = lines([sale("1", "2020-01-01 00:00:00", "1")], PRICE)
    with pytest.raises(Exception, match="label window is empty"):
        churn.window_table(midnight, F.lit(0)).collect()


HISTORY = [
    sale("1", "2020-01-05 09:00:00", "one"),                                     # a single order, gone quiet
    sale("2", "2020-02-01 09:00:00", "back"), sale("3", "2020-06-20 09:00:00", "back"),
    sale("4", "2020-03-01 09:00:00", "day"), sale("5", "2020-03-01 17:00:00", "day"),   # two orders, one day
    sale("6", "2020-05-01 00:00:00", "edge"),                                    # exactly at the snapshot
    sale("7", "2020-05-01 00:00:01", "late"),                                    # just after it
    sale("C8", "2020-04-01 09:00:00", "one", quantity=-3),
    sale("C9", "2020-06-01 09:00:00", "one", quantity=-3),                       # after the snapshot
    sale("10", "2020-01-06 09:00:00", "one", quantity=0),                        # counts as a purchase line
    sale("11", "2020-06-30 15:00:00", "day", price=0.0),                         # no price: no purchase
    sale("12", "2020-06-30 15:00:00", "edge"),
]


@pytest.fixture
def windows():
    return churn.Windows(at("2020-01-01"), at("2020-05-01"), at("2020-06-30 15:00:00"))


def test_labels_and_bounds(lines, windows):
    table = churn.modeling_dataset(lines(HISTORY, PRICE), windows)
    rows = {r["customer_id"]: r for r in table.collect()}
    assert sorted(rows) == ["back", "day", "edge", "one"]
    assert {c: r["churn_label"] for c, r in rows.items()} == {"back": 0, "day": 1, "edge": 0, "one": 1}
    assert rows["edge"]["recency_days"] == 0 and rows["edge"]["future_orders"] == 1
    assert rows["one"]["return_lines"] == 1 and rows["one"]["returned_quantity"] == 3.0
    assert rows["one"]["frequency_orders"] == 2 and rows["one"]["total_quantity"] == 1
    assert len(table.columns) == 34


def test_repeat_buyer_of_one_day_gets_the_age_as_gap(lines, windows):
    row = features.window_features(lines(HISTORY, PRICE), windows.obs_start, windows.snapshot).filter(
        "customer_id = 'day'").first()
    assert row["is_one_time_buyer"] == 0
    assert row["avg_gap_days"] == row["max_gap_days"] == row["tenure_since_first"] == 61


def test_both_ways_to_label_agree(lines, windows):
    clean = lines(HISTORY, PRICE)
    known = features.window_features(clean, windows.obs_start, windows.snapshot)
    two_pass = churn.label_churn(known, purchases(clean, "not_return", PRICE), windows)
    one_pass = churn.modeling_dataset(clean, windows)
    pick = lambda t: sorted(tuple(r) for r in t.select("customer_id", "future_orders", "churn_label").collect())
    assert pick(two_pass) == pick(one_pass)


def test_nothing_after_the_snapshot_changes_a_feature(lines, windows):
    future = [sale("90", "2020-06-01 09:00:00", "one"), sale("C91", "2020-06-02 09:00:00", "back", quantity=-9)]
    table = lambda rows: sorted(
        tuple(r) for r in features.window_features(lines(rows, PRICE), windows.obs_start, windows.snapshot).collect())
    assert table(HISTORY) == table(HISTORY + future)


def test_churn_curve_equals_counting_per_threshold(lines, spark):
    rows = [sale(str(i), str(pd.Timestamp("2020-01-01") + pd.Timedelta(hours=37 * i % 8000)), f"c{i * 7 % 60}") for i in range(200)]
    pur = lines(rows, PRICE)
    pdf = pur.toPandas().groupby("customer_id").invoice_date.agg(["min", "max"])
    latest = pdf["max"].max()
    for row in churn.churn_rate_curve(pur).collect():
        snapshot = (latest - pd.Timedelta(days=row["threshold_days"])).normalize()
        eligible = pdf[pdf["min"] <= snapshot]
        assert row["n_eligible"] == len(eligible)
        assert row["n_churned"] == int((eligible["max"] <= snapshot).sum())
        assert row["churn_rate"] == round(row["n_churned"] / row["n_eligible"], 4)


def test_churn_curve_without_eligible_customers(lines):
    pur = lines([sale("1", "2020-01-01 09:00:00", "1")], PRICE)
    row = churn.at_value(churn.churn_rate_curve(pur), "threshold_days", 30).first()
    assert (row["n_eligible"], row["churn_rate"]) == (0, None)


def test_descriptive_features(lines):
    clean = lines([
        sale("1", "2020-01-01 23:00:00", "a"), sale("2", "2020-01-03 01:00:00", "a", stock="B"),
        sale("C3", "2020-01-04 01:00:00", "a", quantity=-5), sale("C4", "2020-01-05 01:00:00", "a", quantity=2),
        sale("5", "2020-01-05 02:00:00", "b"),
    ], PRICE)
    pur = purchases(clean, "positive", PRICE)
    snapshot = features.descriptive_snapshot(resolve_observation_date(pur))
    rows = {r["customer_id"]: r for r in features.customer_features(clean, snapshot).collect()}
    a, b = rows["a"], rows["b"]
    assert str(a["snapshot_date"]) == "2020-01-06 00:00:00"
    assert (a["recency_days"], b["recency_days"]) == (1, 1)
    # the cancelled line with a positive quantity is a purchase and a return line, without value
    assert (a["frequency_orders"], a["return_lines"], a["returned_quantity"], a["return_value"]) == (3, 2, 5.0, 10.0)
    assert a["return_value_ratio"] == 10.0 / 8.0  # above 1, not capped
    assert (a["avg_gap_days"], a["max_gap_days"]) == (1.5, 2.0)
    assert b["avg_gap_days"] == b["tenure_since_first"] == 1
    assert list(rows["a"].asDict()) == features.FEATURE_COLUMNS


def test_recorded_observation_date_wins(lines, spark):
    pur = lines([sale("1", "2020-01-01 09:00:00", "1")], PRICE)
    meta = spark.createDataFrame([("Observation Date (for churn window)", "2020-02-02"), ("Other", "x")], "Metric string, Value string")
    pick = lambda m: str(spark.range(1).select(resolve_observation_date(pur, m)).first()[0])
    assert pick(meta) == "2020-02-02 00:00:00"
    assert pick(meta.filter("Metric = 'Other'")) == pick(None) == "2020-01-01 09:00:00"


def test_balance_and_recency_buckets(spark):
    table = spark.createDataFrame([(0, 0), (30, 1), (31, 1), (181, 1)], "recency_days int, churn_label int")
    assert [tuple(r) for r in churn.class_balance(table).collect()] == [(1, 3), (0, 1)]
    rates = {r[0]: r[1] for r in churn.churn_by_recency(table).collect()}
    assert rates == {"0-30": 0.5, "31-60": 1.0, "180+": 1.0}


def test_gap_summary(spark):
    found = spark.createDataFrame([("a", 1), ("a", 3), ("b", 8)], "customer_id string, gap_days int")
    row = gaps.gap_summary(found).first()
    assert (row["gaps"], row["repeat_customers"], row["p50"], row["max"]) == (3, 2, 3.0, 8)


def test_text_ids_and_missing_ids(spark, lines):
    """Ids that are no numbers stay customers; rows without an id are nobody's."""
    rows = [
        ("1", "A", "a", 1, "2020-01-01 10:00:00", 1.0, "AB12", "X"), ("2", "A", "a", 1, "2020-06-01 10:00:00", 1.0, "AB12", "X"),
        ("3", "A", "a", 1, "2020-02-01 10:00:00", 1.0, None, "X"), ("4", "A", "a", 1, "2020-03-01 10:00:00", 1.0, "7", "X"),
    ]
    bought = lines(rows, "unit_price")
    first = churn.churn_rate_curve(bought).orderBy("threshold_days").first()
    assert first["n_eligible"] == 2
    assert {r["customer_id"] for r in features.mix_features(bought).collect()} == {"AB12", "7"}
