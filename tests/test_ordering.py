import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.operators import summaries
from ebbtide.operators.ordering import _parted, ranked, running_sums, with_previous
from ebbtide.operators.summaries import quantile_values, quantiles


@pytest.fixture(scope="module")
def tied(spark):
    """5,000 rows of which a third share one value."""
    rng = np.random.default_rng(7)
    value = np.where(rng.random(5000) < 0.34, 1, rng.integers(1, 400, 5000))
    return pd.DataFrame({"id": rng.permutation(5000), "value": value.astype(float)})


def test_rank_equals_a_sort(spark, tied):
    frame = spark.createDataFrame(tied).repartition(6)
    got = ranked(frame, ["value", "id"]).toPandas().set_index("id")["global_rank"]
    ordered = tied.sort_values(["value", "id"]).reset_index(drop=True)
    assert got.loc[ordered["id"]].tolist() == list(range(1, 5001))


def test_a_shared_value_spans_several_parts(spark, tied):
    frame = spark.createDataFrame(tied).withColumn("value", F.lit(1.0)).repartition(6)
    placed = _parted(frame, ["value", "id"]).groupBy("_part").count().collect()
    assert len(placed) > 4 and max(r["count"] for r in placed) < 5000 / 3


@pytest.mark.parametrize("order", [["value", "id"], ["name", "at", "id"], ["at", "id"]])
def test_parts_follow_the_order(spark, tied, order):
    frame = spark.createDataFrame(tied).select(
        "id", F.when(F.col("id") % 11 != 0, F.col("value")).alias("value"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("é"), F.col("value"))).alias("name"),
        F.timestamp_seconds(F.col("value") * 1000).cast("timestamp_ntz").alias("at"),
    )
    rows = _parted(frame, order).orderBy(*order).select("_part").collect()
    parts = [r["_part"] for r in rows]
    assert parts == sorted(parts) and len(set(parts)) > 2


def test_an_empty_frame_stays_empty(spark, tied):
    frame = spark.createDataFrame(tied).limit(0)
    assert ranked(frame, ["value", "id"]).count() == 0
    assert with_previous(frame, ["value"], ["id"], "id", "before").count() == 0


def test_running_sums_equal_cumsum(spark, tied):
    counted = spark.createDataFrame(tied).groupBy("value").agg(F.count("*").alias("n"))
    got = running_sums(counted, ["value"], ["n"]).orderBy("value").toPandas()
    expected = tied.groupby("value").size().cumsum()
    assert got["cum_n"].tolist() == expected.tolist()


def test_look_back_equals_a_shift_over_partition_borders(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(900) < 0.5, 3, rng.integers(0, 6, 900)), "at": rng.permutation(900)})
    got = with_previous(spark.createDataFrame(pdf).repartition(5), ["k"], ["at"], "at", "before").toPandas()
    want = pdf.sort_values(["k", "at"]).assign(before=lambda d: d.groupby("k")["at"].shift(1))
    merged = got.merge(want, on=["k", "at"])
    assert len(merged) == 900
    assert merged["before_x"].fillna(-1).tolist() == merged["before_y"].fillna(-1).tolist()
    assert merged["before_x"].isna().sum() == pdf.k.nunique()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40))
def test_quantiles_interpolate_like_numpy(spark, values):
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert quantile_values(frame, "x", points) == pytest.approx(list(np.quantile(values, points)))


@pytest.mark.parametrize("gathered, accuracy", [(20_000, 5_000), (60, 100), (5, 20)])
def test_brackets_narrow_to_the_exact_value(spark, monkeypatch, gathered, accuracy):
    """Hot values, gaps and long tails, with little room for a bracket."""
    monkeypatch.setattr(summaries, "GATHERED", gathered)
    monkeypatch.setattr(summaries, "ACCURACY", accuracy)
    rng = np.random.default_rng(accuracy)
    data = pd.DataFrame({
        "hot": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(7, 3, 4000)), "tail": rng.lognormal(0, 3, 4000),
        "few": rng.integers(0, 3, 4000).astype(float), "one": 2.5,
    })
    points = [0.0, 0.001, 0.25, 0.5, 0.61, 0.9, 0.999, 1.0]
    found = summaries.exact_quantiles(spark.createDataFrame(data).repartition(4), list(data), points)
    for c, values in zip(data, found):
        assert values == pytest.approx(np.quantile(data[c], points).tolist(), rel=1e-12), c


def test_a_bracket_that_misses_its_rank_moves():
    rank = summaries._Rank(0, 10, 5.0, 6.0)
    assert not rank.counted({5.0: 20, 6.0: 25}, {5.0: 21, 6.0: 26}, -1.0, 9.0) and (rank.low, rank.high) == (-1.0, 5.0)
    rank = summaries._Rank(0, 30, 5.0, 6.0)
    assert not rank.counted({5.0: 20, 6.0: 25}, {5.0: 21, 6.0: 26}, -1.0, 9.0) and (rank.low, rank.high) == (6.0, 9.0)


def test_quantiles_of_several_columns_skip_missing(spark):
    data = pd.DataFrame({"a": [1.0, 2.0, None, 10.0], "b": [5.0, 5.0, 5.0, 6.0]})
    frame = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), "a double, b double")
    got = {(r["column"], r["point"]): r["quantile"] for r in quantiles(frame, ["a", "b"], [0.5, 0.75]).collect()}
    assert got == {("a", 0.5): 2.0, ("a", 0.75): 6.0, ("b", 0.5): 5.0, ("b", 0.75): 5.25}


def test_a_hot_key_spans_parts(spark):
    """A third of the rows share a key; no part holds anywhere near a third."""
    rows = spark.range(30_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("k"), "id"
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = _parted(rows, ["k", "id"]).groupBy("_part").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(r["count"] for r in placed) < 30_000 / 6
