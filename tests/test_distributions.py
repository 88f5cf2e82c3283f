import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import concentration, distributions, statistics


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    return pd.DataFrame({
        "amount": np.round(rng.lognormal(3, 1.2, 700), 2), "days": rng.integers(0, 40, 700).astype(float),
        "signed": rng.normal(0, 5, 700), "flat": 1.0, "group": rng.random(700) < 0.3, "name": rng.choice(list("abc"), 700),
    })


@pytest.fixture
def frame(spark, data):
    return spark.createDataFrame(data)


def test_full_histogram_equals_numpy(frame, data):
    got = distributions.histogram(frame, "days", 13).collect()
    counts, edges = np.histogram(data.days, 13)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["lower"] for r in got] == pytest.approx(edges[:-1])


def test_views(frame, data):
    counts = lambda view, column="signed", bins=20, **o: [r["count"] for r in distributions.histogram(frame, column, bins, view, **o).collect()]
    positive = data.signed[data.signed > 0]
    assert counts("log1p") == np.histogram(np.log1p(positive), 20)[0].tolist()
    p95, p99 = data.amount.quantile([0.95, 0.99])
    assert counts("p95", "amount") == np.histogram(data.amount, 20, (0, p95))[0].tolist()
    assert sum(counts("below_p95", "amount")) == (data.amount <= p95).sum()
    assert counts("p99", "amount") == np.histogram(data.amount.clip(upper=p99), 20)[0].tolist()
    assert counts("cap", "days", 10, cap=20) == np.histogram(data.days.clip(upper=20), 10)[0].tolist()
    assert counts("log1p_all", "amount") == np.histogram(np.log1p(data.amount), 20)[0].tolist()


def test_histogram_of_one_value(frame):
    assert [r["count"] for r in distributions.histogram(frame, "flat", 3).collect()] == [700, 0, 0]


def test_ecdf_holds_the_last_position(spark):
    table = spark.createDataFrame([(1,), (1,), (2,), (5,)], "v int")
    got = [tuple(r) for r in distributions.ecdf(table, "v").orderBy("value").collect()]
    assert got == [(1, 2, 0.5), (2, 1, 0.75), (5, 1, 1.0)]


def test_describe_equals_pandas(frame, data):
    got = {r["column"]: r for r in distributions.describe(frame.select("amount", "signed", "name")).collect()}
    want = data[["amount", "signed"]].describe()
    for c in want:
        assert [got[c][k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(want[c].tolist())
    text = data["name"].describe()
    assert (got["name"]["unique"], got["name"]["freq"], got["name"]["top"]) == (text["unique"], text["freq"], text["top"])


def test_tails(frame, data):
    row = distributions.tail_summary(frame, ["signed"]).first()
    assert row["p99.9"] == pytest.approx(data.signed.quantile(0.999))
    assert row["negative_pct"] == pytest.approx((data.signed < 0).mean() * 100)
    near = distributions.quantile_table(frame, ["signed"], [0.5], approximate=True).first()["p50"]
    assert near == pytest.approx(data.signed.median(), abs=0.2)


def test_box_whiskers(frame, data):
    row = distributions.box_stats(frame, ["amount"]).first()
    logs = np.log1p(data.amount)
    q1, q3 = logs.quantile([0.25, 0.75])
    inside = logs[(logs >= q1 - 1.5 * (q3 - q1)) & (logs <= q3 + 1.5 * (q3 - q1))]
    assert (row["whisker_low"], row["whisker_high"]) == pytest.approx((inside.min(), inside.max()))
    assert row["outliers"] == len(logs) - len(inside)


def test_density_equals_a_sum_of_kernels(frame, data):
    got = distributions.density(frame, "days", 50, cap=30).collect()
    x = data.days.clip(upper=30).to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    want = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi)) for g in grid]
    assert [r["grid_value"] for r in got] == pytest.approx(grid)
    assert [r["density"] for r in got] == pytest.approx(want)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 37.7])
def test_density_off_the_grid_is_within_its_bound(spark, scale):
    values = np.random.default_rng(4).gamma(2.0, scale, 3000)
    got = distributions.density(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 64).collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    at = np.linspace(values.min(), values.max(), 64)
    want = np.exp(-((at[:, None] - values) / h) ** 2 / 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    bound = distributions.density_error(distributions.density_step(values.min(), values.max(), h), h)
    off = np.abs(np.array([r["density"] for r in got]) - want).max()
    assert off <= bound + 1e-12 / scale and bound < 1e-4 * want.max()


def test_density_of_little(spark):
    of = lambda rows: distributions.density(spark.createDataFrame(rows, "v double"), "v", 5).collect()
    assert of([]) == [] and [r["density"] for r in of([(2.0,), (2.0,)])] == [None] * 5


@pytest.mark.parametrize("a, b, x, want", [(0.5, 0.5, 0.25, 1 / 3), (2.0, 3.0, 0.4, 0.5248), (1.0, 1.0, 0.7, 0.7), (5.0, 1.0, 0.5, 0.03125)])
def test_regularised_beta_has_its_known_values(a, b, x, want):
    assert statistics.regularised_beta(a, b, x) == pytest.approx(want, rel=1e-12)
    assert statistics.regularised_beta(b, a, 1 - x) == pytest.approx(1 - want, rel=1e-12)


def trapezoid_gini(values):
    x = np.sort(values)
    share, place = np.cumsum(x) / x.sum(), np.arange(1, len(x) + 1) / len(x)
    return 1 - 2 * ((share[1:] + share[:-1]) / 2 * np.diff(place)).sum()


@pytest.mark.parametrize("column", ["amount", "days"])
def test_gini_starts_at_the_first_point(frame, data, column):
    got = concentration.gini(frame, column).first()["gini"]
    assert got == pytest.approx(trapezoid_gini(data[column].to_numpy()))
    assert 0 <= got < 1


def test_negative_totals_count_as_zero(spark):
    table = spark.createDataFrame([(-5.0,), (1.0,), (3.0,)], "v double")
    assert concentration.gini(table, "v").first()["gini"] == pytest.approx(trapezoid_gini(np.array([0.0, 1.0, 3.0])))


def test_lorenz(spark):
    table = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double")
    assert [tuple(r) for r in concentration.lorenz(table, "v").orderBy("value").collect()] == [
        (1.0, pytest.approx(2 / 3), 0.5), (2.0, 1.0, 1.0)]


@pytest.mark.parametrize("n, fraction, rounding, taken", [(11, 0.2, "floor", 2), (11, 0.1, "ceil", 2), (3, 0.1, "ceil", 1), (3, 0.2, "floor", 0)])
def test_top_share_rounding(spark, n, fraction, rounding, taken):
    values = [float(max(i, 4)) for i in range(n)]  # ties reach over the cut
    table = spark.createDataFrame([(v,) for v in values], "v double")
    row = concentration.top_share(table, "v", fraction, rounding).first()
    assert row["top_entities"] == taken
    assert row["top_share_pct"] == pytest.approx(sum(sorted(values)[::-1][:taken]) / sum(values) * 100)


def test_correlations_are_pairwise_complete_and_drop_constants(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, np.nan], "b": [2.0, 1.0, np.nan, 5.0, 9.0], "c": [1.0] * 5})
    table = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double")
    got = statistics.correlations(table, ["a", "b", "c"]).collect()
    assert [(r["var1"], r["var2"]) for r in got] == [("a", "b")]
    assert got[0]["correlation"] == pytest.approx(pdf["a"].corr(pdf["b"]))


def test_strongest_pairs_and_label(frame, data):
    top = statistics.corr_pairs(frame, ["amount", "days", "signed"], top=2).collect()
    want = data[["amount", "days", "signed"]].corr().abs()
    assert top[0]["abs_correlation"] == pytest.approx(max(want.iloc[0, 1], want.iloc[0, 2], want.iloc[1, 2]))
    assert len(top) == 2 and statistics.corr_pairs(frame, ["amount", "days"], None, 0.9).count() == 0
    labelled = frame.withColumn("label", F.col("group").cast("int"))
    got = {r["feature"]: r["correlation"] for r in statistics.corr_with_label(labelled, ["amount", "flat"], "label").collect()}
    assert got["amount"] == pytest.approx(data["amount"].corr(data["group"].astype(float))) and got["flat"] is None


def test_skew_equals_pandas(frame, data):
    got = {r["column"]: r["skew"] for r in statistics.skew_rank(frame, ["amount", "days", "signed", "flat"]).collect()}
    for c in got:
        assert got[c] == pytest.approx(data[c].skew(), abs=1e-9)


@pytest.mark.parametrize("t, freedom, p", [
    (0.0, 5, 1.0), (2.0, 10, 0.07338803), (2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e6, 0.05),
    (1.0, 2, 0.42264973),
])
def test_p_values(t, freedom, p):
    assert statistics.t_two_sided(t, freedom) == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize("t, freedom", [(-3.0, 4.5), (0.3, 17.2), (2.5, 812.4)])
def test_p_values_between_table_entries(t, freedom):
    scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi)
    x = np.linspace(0, abs(t), 200_001)
    density = scale * (1 + x * x / freedom) ** (-(freedom + 1) / 2)
    inside = ((density[1:] + density[:-1]) / 2 * np.diff(x)).sum()
    assert statistics.t_two_sided(t, freedom) == pytest.approx(1 - 2 * inside, abs=1e-6)


def test_welch(frame, data):
    row = {r["metric"]: r for r in statistics.welch_ttest(frame, "group", ["amount", "flat"]).collect()}
    a, b = data.amount[data.group], data.amount[~data.group]
    ea, eb = a.var() / len(a), b.var() / len(b)
    assert row["amount"]["t_statistic"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(ea + eb))
    assert row["amount"]["degrees_of_freedom"] == pytest.approx((ea + eb) ** 2 / (ea**2 / (len(a) - 1) + eb**2 / (len(b) - 1)))
    assert row["flat"]["p_value"] is None and row["flat"]["significant"] == "No"
