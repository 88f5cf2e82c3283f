import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions import calendar as cal
from ebbtide.functions import scalars as sc


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("start, end, elapsed, dates", [
    ("2020-01-01 23:00:00", "2020-01-02 01:00:00", 0, 1),
    ("2020-01-01 01:00:00", "2020-01-03 01:00:00", 2, 2),
    ("2020-01-02 01:00:00", "2020-01-01 23:00:00", -1, -1),
    ("2020-03-07 12:00:00", "2020-03-09 11:59:59.999999", 1, 2),  # over a clock change
    ("2020-03-07 12:00:00", "2020-03-09 12:00:00", 2, 2),
])
def test_elapsed_days_round_down(spark, start, end, elapsed, dates):
    assert value(spark, cal.elapsed_days(ts(start), ts(end))) == elapsed
    assert value(spark, cal.calendar_days(ts(start), ts(end))) == dates


def test_weeks_end_on_sunday(spark):
    for day, sunday in [("2020-06-01 10:00:00", "2020-06-07"), ("2020-06-07 23:59:00", "2020-06-07")]:
        assert str(value(spark, cal.week_end(ts(day)))) == f"{sunday} 00:00:00"


def test_month_parts(spark):
    at = ts("2020-12-31 23:30:00")
    assert value(spark, cal.month_text(at)) == "2020-12"
    assert str(value(spark, cal.month_start(at))) == "2020-12-01 00:00:00"
    assert value(spark, cal.month_index(ts("2019-11-15 00:00:00"), at)) == 13


def test_bad_timestamp_is_missing(spark):
    assert value(spark, cal.parse_ts(F.lit("not a date"))) is None


@pytest.mark.parametrize("how, given, expected", [
    ("strip", "12346.0", "12346"), ("strip", "10.05", "10.05"), ("strip", "1.0.0", "1.0"),
    ("numeric", "12346.0", "12346"), ("numeric", "9007199254740993", "9007199254740993"),
    ("numeric", "9007199254740992.0", "9007199254740992"), ("numeric", "abc", None), ("text", "12346.0", "12346.0"),
])
def test_customer_ids(spark, how, given, expected):
    assert value(spark, sc.canonical_id(F.lit(given), how)) == expected


@pytest.mark.parametrize("code, special", [
    ("POST", True), (" POST ", True), ("post", False), ("M", True), ("m", False), ("test001", True),
    ("Gift_1", True), ("BANK CHARGES", True), ("bankers box", True), ("85123A", False), (None, False),
])
def test_special_codes_exact_by_case_prefix_in_any_case(spark, code, special):
    assert value(spark, sc.is_special_stock(F.lit(code).cast("string"))) is special


def test_clip_keeps_missing(spark):
    assert value(spark, sc.clip(F.lit(None).cast("int"), lo=1)) is None
    assert value(spark, sc.clip(F.lit(0), lo=1, hi=5)) == 1
    assert value(spark, sc.clip(F.lit(9), lo=1, hi=5)) == 5


@pytest.mark.parametrize("rule, expected", [
    ("one", 6.0), ("null_to_zero", 0.0), ("null", None), ("tiny", 6e9),
])
def test_ratio_with_zero_denominator(spark, rule, expected):
    got = value(spark, sc.safe_ratio(F.lit(6.0), F.lit(0), rule))
    assert got == pytest.approx(expected) if expected is not None else got is None


def test_cut_is_closed_on_the_right(spark):
    values = [0, 1, 2, 3, 4, 10, 11]
    frame = spark.createDataFrame([(v,) for v in values], "v int")
    got = [r[0] for r in frame.select(sc.cut(F.col("v"), fv.FREQUENCY_EDGES, fv.FREQUENCY_SEGMENTS)).collect()]
    expected = pd.cut(pd.Series(values), [0, 1, 3, 10, float("inf")], labels=fv.FREQUENCY_SEGMENTS)
    assert got == [None if pd.isna(v) else v for v in expected]


def test_quantile_bin_collapsed_edges(spark):
    edges = [1.0, 1.0, 1.0, 2.0, 9.0]
    frame = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "v double")
    assert [r[0] for r in frame.select(sc.quantile_bin(F.col("v"), edges)).collect()] == [1, 3, 4, None]
    with pytest.raises(ValueError):
        sc.quantile_bin(F.col("v"), edges, strict=True)


@pytest.mark.parametrize("n", [1, 5, 6, 7, 100])
def test_rank_bin_is_a_quartile_of_the_rank(spark, n):
    got = [r[0] for r in spark.range(1, n + 1).orderBy("id").select(sc.rank_bin(F.col("id"), F.lit(n))).collect()]
    if n > 1:
        ranks = pd.Series(range(1, n + 1), dtype=float)
        assert got == pd.qcut(ranks, 4, labels=[1, 2, 3, 4]).astype(int).tolist()
    if n == 6:
        assert got == [1, 1, 2, 3, 4, 4]


def test_segment_ladder(spark):
    cases = [
        ((3, 3, 3, 0), "Champions"), ((4, 3, 1, 0), "Loyal Customers"), ((3, 1, 3, 0), "Potential Loyalists"),
        ((3, 2, 2, 0), "Recent Customers"), ((2, 3, 3, 999), "High Value"), ((1, 4, 1, 999), "Frequent Buyers"),
        ((1, 1, 4, 181), "At Risk"), ((1, 1, 4, 180), "Moderate"),
    ]
    for scores, name in cases:
        assert value(spark, sc.rfm_segment(*map(F.lit, scores))) == name


def test_names_of_both_layouts(spark):
    for header in (["Invoice", "StockCode", "Price", "Customer ID"], ["InvoiceNo", " Stock-Code ", "UnitPrice", "CustomerID"]):
        frame = spark.createDataFrame([("a", "b", "c", "d")], header)
        assert sc.normalize_columns(frame).columns == ["invoice_no", "stock_code", "price", "customer_id"]


def test_labels_with_default(spark):
    assert value(spark, sc.map_labels(F.lit("a"), {"a": "x"}, "none")) == "x"
    assert value(spark, sc.map_labels(F.lit("b"), {"a": "x"}, "none")) == "none"
    assert value(spark, sc.country_group(F.lit("EIRE"))) == "EU"
    assert value(spark, sc.country_group(F.lit(None).cast("string"))) == "Other"


def test_fill_and_types(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, 5.0, None)], "age int, gap double, name string")
    filled = sc.fill(sc.fill(frame, ["gap"], F.col("age")), ["name"], "none")
    assert [tuple(r) for r in filled.collect()] == [(1, 1.0, "a"), (2, 5.0, "none")]
    assert sc.split_by_type(frame) == (["age", "gap"], ["name"])
    rounded = sc.round_columns(spark.createDataFrame([(1.239, 7)], "a double, b int"), 2)
    assert tuple(rounded.first()) == (1.24, 7)
