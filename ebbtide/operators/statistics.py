"""Correlation, skewness and the two-sample test."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.summaries import per_column


#: Pairs of columns whose sums are taken in one aggregation.
PAIRS = 120


class _Sums:
    """Sums over all rows, each asked for once however many pairs need it."""

    def __init__(self):
        self.asked: dict[tuple, Column] = {}

    def ask(self, key: tuple, value: Column) -> tuple:
        self.asked.setdefault(key, value)
        return key


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, over the rows that have both; constant columns drop out.

    Mergeable co-moments: count, x, y, xx, yy and xy of each pair, about the columns' means so that
    they stay small. No row is multiplied. A sum that a column's missing values do not touch is shared by all
    its pairs, and ``PAIRS`` pairs go into one aggregation, of one row.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    facts = df.agg(F.count(F.lit(1)), *[f for c in columns for f in (F.count(value[c]), F.avg(value[c]))]).first()
    rows, full = facts[0], {c: facts[2 * i + 1] == facts[0] for i, c in enumerate(columns)}
    about = {c: value[c] - F.lit(facts[2 * i + 2]) for i, c in enumerate(columns)}
    usable = [c for i, c in enumerate(columns) if facts[2 * i + 1]]
    pairs = [(a, b) for i, a in enumerate(usable) for b in usable[i + 1:]]
    found = []
    for at in range(0, len(pairs), PAIRS):
        sums, needs = _Sums(), []
        for a, b in pairs[at:at + PAIRS]:
            x, y = about[a], about[b]
            def one(c: str, other: str, power: int) -> tuple:
                term = about[c] if power == 1 else about[c] * about[c]
                if full[other]:
                    return sums.ask((c, power), F.sum(term))
                return sums.ask((c, other, power), F.sum(F.when(value[other].isNotNull(), term)))
            count = sums.ask(("n", a, b), F.count(x * y)) if not (full[a] and full[b]) else None
            needs.append((a, b, count, one(a, b, 1), one(b, a, 1), one(a, b, 2), one(b, a, 2), sums.ask((a, b), F.sum(x * y))))
        result = dict(zip(sums.asked, df.agg(*[s.alias(str(i)) for i, s in enumerate(sums.asked.values())]).first()))
        found += [(a, b, _pearson(rows if count is None else result[count], *[result[k] for k in keys])) for a, b, count, *keys in needs]
    return df.sparkSession.createDataFrame(
        [pair for pair in found if pair[2] is not None], "var1 string, var2 string, correlation double")


def _pearson(n: int, *sums: float | None) -> float | None:
    """From the sums of a pair; None without rows or where a side is constant."""
    if not n or None in sums:
        return None
    x, y, xx, yy, xy = sums
    left, right = xx - x * x / n, yy - y * y / n
    # what rounding leaves of a constant
    if left <= 1e-12 * xx or right <= 1e-12 * yy or left * right <= 0:
        return None
    return max(-1.0, min(1.0, (xy - x * y / n) / math.sqrt(left) / math.sqrt(right)))


def corr_pairs(
    df: DataFrame, columns: Sequence[str], top: int | None = 10, cutoff: float | None = None
) -> DataFrame:
    """The strongest pairs by absolute correlation: the first ``top``, or all at ``cutoff``."""
    strength = F.abs("correlation")
    pairs = correlations(df, columns).withColumn("abs_correlation", strength)
    if cutoff is not None:
        pairs = pairs.filter(F.col("abs_correlation") >= cutoff)
    ordered = pairs.orderBy(F.desc("abs_correlation"), "var1", "var2")
    return ordered if top is None else ordered.limit(top)


def corr_with_label(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Correlation of each column with the label; NULL for a constant column."""
    truth = F.col(label).cast("double")
    both = lambda c: F.when(truth.isNotNull(), c)
    labels = lambda c: F.when(c.isNotNull(), truth)
    found = per_column(df, columns, {
        "n": F.count,
        # NULL where a side is constant; the built-in ``corr`` would divide by zero
        "correlation": lambda c: F.try_divide(F.covar_pop(c, truth), F.stddev_pop(both(c)) * F.stddev_pop(labels(c))),
    })
    return found.filter("n > 0").select(F.col("column").alias("feature"), "correlation")


def skew_rank(df: DataFrame, columns: Sequence[str], top: int = 8) -> DataFrame:
    """The most right-skewed columns, by the sample-size adjusted coefficient."""
    n = F.col("n")
    adjusted = F.col("skewness") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return (
        per_column(df, columns, {"skewness": F.skewness, "n": F.count, "sd": F.stddev_pop})
        .filter("n > 0")
        # a constant column has skewness 0
        .select("column", F.when(F.col("sd") == 0, 0.0).otherwise(adjusted).alias("skew"))
        .orderBy(F.desc("skew"), "column")
        .limit(top)
    )


def welch_statistics(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Means, t statistic and degrees of freedom of a two-sample test with unequal variances.

    ``group`` is boolean; the rows where it holds are the first sample.
    """
    stats = per_column(df, columns, {
        f"{name}_{tag}": (lambda c, of=of, flag=flag: of(F.when(F.col(group) == flag, c)))
        for tag, flag in (("a", True), ("b", False)) for name, of in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))
    }).filter("n_a + n_b > 0")
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    return stats.select(
        F.col("column").alias("metric"), "mean_a", "mean_b",
        F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(ea + eb)).alias("t_statistic"),
        F.try_divide(
            (ea + eb) * (ea + eb),
            F.try_divide(ea * ea, F.col("n_a") - 1) + F.try_divide(eb * eb, F.col("n_b") - 1),
        ).alias("degrees_of_freedom"),
    )


def _continued_fraction(a: float, b: float, x: float) -> float:
    """The fraction of the incomplete beta function, by Lentz's method; it converges for x below the mean."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1.0 + term * d, 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def regularised_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):  # beyond the mean the other tail converges
        return 1.0 - regularised_beta(b, a, 1 - x)
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / a * _continued_fraction(a, b, x)


def t_two_sided(t: float, freedom: float) -> float:
    """Two-sided p-value of Student's t: I_x(f / 2, 1 / 2) at x = f / (f + t squared)."""
    return regularised_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def welch_ttest(df: DataFrame, group: str, columns: Sequence[str], level: float = 0.05, places: int = 4) -> DataFrame:
    """The test with p-value, rounded, and verdict. One row per metric comes to the driver, no more."""
    stats = welch_statistics(df, group, columns)
    rows = []
    for s in stats.collect():
        usable = s.t_statistic is not None and s.degrees_of_freedom
        p = t_two_sided(s.t_statistic, s.degrees_of_freedom) if usable else None
        rows.append((
            s.metric, s.mean_a, s.mean_b, s.t_statistic, s.degrees_of_freedom,
            None if p is None else round(p, places),
            "Yes" if p is not None and p < level else "No",
        ))
    return df.sparkSession.createDataFrame(
        rows,
        "metric string, mean_a double, mean_b double, t_statistic double, "
        "degrees_of_freedom double, p_value double, significant string",
    )
