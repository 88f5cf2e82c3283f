import pytest
from pyspark.sql import functions as F

from ebbtide.operators import quality, returns

DAY = "2020-01-0{} 10:00:00"


@pytest.fixture
def messy(lines):
    return lines([
        ("1", "A", "pen", 2, DAY.format(1), 3.0, "7.0", "X"),
        ("1", "A", "pen", 2, DAY.format(1), 3.0, "7.0", "X"),       # a copy
        ("2", "A", "pen", 2, DAY.format(1), 3.0, None, "X"),        # no customer
        ("2", "A", "pen", 2, DAY.format(1), 3.0, None, "X"),        # and its copy
        ("3", "POST", "post", 1, DAY.format(2), 3.0, "7", "X"),     # special
        ("4", "post", "odd", 1, DAY.format(2), 3.0, "7", "X"),      # not special
        ("C5", "A", "pen", 1, DAY.format(3), 3.0, "7", "X"),        # cancelled, quantity above 0
        ("C6", "A", "pen", -1, DAY.format(3), 3.0, "7", "X"),
        ("7", "A", None, 0, DAY.format(3), 3.0, "7", "X"),          # nothing sold
        ("8", "A", "pen", -1, DAY.format(3), 0.0, "7", "X"),        # return without a price
        ("9", "A", "pen", 1, None, 3.0, "7", "X"),                  # no date
        ("10", "A", "pen", 1, DAY.format(3), -5.0, "7", "X"),       # negative price
    ])


def test_flags_count_every_rule(messy):
    got = {r["flag"]: r["count"] for r in quality.quality_flags(messy).collect()}
    assert got == {
        "cancel_invoice_rows": 2, "negative_qty_rows": 2, "negative_price_rows": 1, "missing_customer_rows": 2,
        "missing_date_rows": 1, "special_stock_code_rows": 1, "zero_price_rows": 1,
    }


def test_split_rules_differ(messy):
    clean = quality.clean_transactions(messy)
    ids = lambda frame: sorted(r["invoice_no"] for r in frame.collect())
    assert ids(quality.purchases(clean, "positive")) == ["1", "4", "C5"]
    assert ids(quality.purchases(clean, "not_return")) == ["1", "4", "7"]
    assert ids(quality.returns(clean, "priced")) == ["C5", "C6"]
    assert ids(quality.returns(clean, "any_price")) == ["8", "C5", "C6"]
    assert ids(quality.returns(clean, "or_negative_price")) == ["10", "8", "C5", "C6"]
    assert {r["customer_id"] for r in clean.collect()} == {"7"}


def test_waterfall_counts_what_is_left(messy):
    steps = quality.cleaning_waterfall(messy).collect()
    assert [r["rows"] for r in steps] == [12, 10, 8, 7, 3]
    # taking the raw missing counts off the distinct rows removes the copied row twice
    assert [r["rows_by_subtraction"] for r in steps] == [12, 10, 7, 7, 3]
    assert [r["pct_of_raw"] for r in steps][1] == 83.3
    report = {r["check"]: r["count"] for r in quality.validation_report(messy).collect()}
    assert report["Exact duplicates removed"] == 2
    assert report["Special / non-product stock codes removed"] == 1
    assert quality.duplicate_count(messy).first()[0] == 2


def test_waterfall_never_rises(messy):
    rows = [r["rows"] for r in quality.cleaning_waterfall(messy).collect()]
    assert rows == sorted(rows, reverse=True)


def test_empty_input(messy):
    nothing = messy.filter(F.lit(False))
    assert quality.duplicate_count(nothing).first()[0] == 0
    assert [r["rows"] for r in quality.cleaning_waterfall(nothing).collect()] == [0] * 5


def test_special_profile_has_a_sample(lines):
    tx = lines([
        ("1", "POST", None, 1, DAY.format(1), 2.0, "1", "X"),
        ("2", "POST", "z", 1, DAY.format(1), 2.0, "1", "X"),
        ("3", "M", None, 1, DAY.format(1), 2.0, "1", "X"),
    ])
    got = [tuple(r) for r in quality.special_code_profile(tx).collect()]
    assert got == [("POST", 2, 4.0, "z"), ("M", 1, 2.0, "")]
    assert [tuple(r) for r in quality.special_code_profile(tx, 1).collect()] == [("POST", 2, 4.0, "z")]


def test_missing_share_and_profile(messy):
    table = quality.missing_pct(messy).collect()
    assert table[0]["column"] == "customer_id" and table[0]["missing_pct"] == 16.67
    kept = {r["column"] for r in quality.missing_pct(messy, above_zero=True).collect()}
    assert kept == {"customer_id", "invoice_date", "description"}
    profile = {r["column"]: (r["non_null"], r["dtype"]) for r in quality.column_profile(messy).collect()}
    assert profile["quantity"] == (12, "int") and profile["description"] == (11, "string")


def test_window_bounds(messy):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    lo, hi = at(DAY.format(1)), at(DAY.format(3))
    assert quality.in_window(messy, "invoice_date", lo, hi).count() == 11
    assert quality.in_window(messy, "invoice_date", lo, hi, closed=False).count() == 7


def test_returns_match_only_earlier_purchases(lines):
    clean = lines([
        ("1", "A", "a", 1, DAY.format(2), 3.0, "7", "X"),
        ("C2", "A", "a", -1, DAY.format(1), 3.0, "7", "X"),   # before the purchase
        ("C3", "A", "a", -1, DAY.format(2), 3.0, "7", "X"),   # at the same time
        ("C4", "B", "b", -1, DAY.format(3), 3.0, "7", "X"),   # never bought
        ("C5", "A", "a", -1, DAY.format(3), 3.0, "8", "X"),   # by someone else
    ])
    ret, pur = quality.returns(clean), quality.purchases(clean)
    got = {r["invoice_no"]: r["matched_to_purchase"] for r in returns.reconcile_returns(ret, pur).collect()}
    assert got == {"C2": False, "C3": True, "C4": False, "C5": False}
    summary = returns.reconciliation_summary(ret, pur).first()
    assert (summary["return_lines"], summary["matched_lines"], summary["net_value"]) == (4, 1, 3.0 - 12.0)
    report = [r["value"] for r in returns.reconciliation_report(returns.reconciliation_summary(ret, pur)).collect()]
    assert report[:3] == ["4", "1 (25.0%)", "3"] and report[-1] == "400.00%"


def test_no_returns(lines):
    clean = lines([("1", "A", "a", 1, DAY.format(2), 3.0, "7", "X")])
    summary = returns.reconciliation_summary(quality.returns(clean), quality.purchases(clean)).first()
    assert summary["return_lines"] == 0 and summary["matched_pct"] == 0.0 and summary["net_value"] == 3.0


def test_join_by_pair_keeps_every_row_of_a_hot_or_null_key(spark):
    key = F.when(F.col("id") < 1000, 0).when(F.col("id") % 3 > 0, F.col("id"))
    left = spark.range(3000).select(key.alias("k"), "id")
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = returns.joined_by_pair(left, right, ["k"]).orderBy("id").toPandas()
    expected = left.toPandas().merge(right.toPandas(), on="k", how="left").sort_values("id")
    assert got["id"].tolist() == expected["id"].tolist()
    assert got["w"].fillna(-1).tolist() == expected["w"].fillna(-1).tolist()
