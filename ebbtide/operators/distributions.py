"""Quantile tables, descriptions, histograms, cumulative distributions and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions.scalars import clip, split_by_type
from ebbtide.operators.ordering import running_sums
from ebbtide.operators.summaries import exact_quantiles, per_column, quantile_values
from ebbtide.runtime import resolved_row


def quantile_table(
    df: DataFrame, columns: Sequence[str], points: Sequence[float] = fv.SUMMARY_POINTS,
    approximate: bool = False,
) -> DataFrame:
    """Quantiles, one row per column with values and one output column ``p<percent>`` per point.

    Exact by default; ``approximate`` gives actual values near them from one small sketch each.
    """
    names = [f"p{p * 100:g}" for p in points]
    if approximate:
        stats = per_column(df, columns, {"q": lambda c: F.percentile_approx(c, list(points))})
        return stats.filter("q IS NOT NULL").select("column", *[F.col("q")[i].alias(name) for i, name in enumerate(names)])
    found = exact_quantiles(df, columns, points)
    rows = [(c, *values) for c, values in zip(columns, found) if values[0] is not None]
    return df.sparkSession.createDataFrame(rows, ", ".join(["column string", *(f"`{name}` double" for name in names)]))


def tail_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quantiles far into the tails, minimum, maximum and percent of negative values."""
    extremes = per_column(df, columns, {
        "min": F.min, "max": F.max,
        # missing values count as not negative, over all rows
        "negative_pct": lambda c: F.count_if(c < 0) * 100.0 / F.count(F.lit(1)),
    })
    return quantile_table(df, columns, fv.TAIL_POINTS).join(extremes, "column")


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per column."""
    moments = per_column(df, columns, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    return moments.join(quantile_table(df, columns, [0.25, 0.5, 0.75]), "column").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, the most common one (smallest on ties) and its frequency."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    counted = (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    top = F.min(F.struct(-F.col("n"), F.col("value")))
    return counted.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        top.getField("value").alias("top"),
        F.max("n").alias("freq"),
    )


def describe(df: DataFrame) -> DataFrame:
    """Numeric and categorical description of every column, what does not apply being NULL."""
    numeric, other = split_by_type(df)
    both = describe_numeric(df, numeric).unionByName(
        describe_categorical(df, other), allowMissingColumns=True
    )
    return both.withColumns({c: F.col(c).cast("double") for c in ("count", "unique", "freq")})


def _binned(values: DataFrame, lo: Column, hi: Column, bins: int) -> DataFrame:
    """Counts of ``value`` in equal bins over ``lo..hi``; the last bin includes ``hi``."""
    width = (hi - lo) / bins
    position = F.floor(F.try_divide(F.col("value") - lo, width)).cast("int")
    counted = (
        values.filter((F.col("value") >= lo) & (F.col("value") <= hi))
        .select(F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    )
    grid = values.sparkSession.range(0, bins, numPartitions=1).select(F.col("id").cast("int").alias("bin"))
    return (
        grid.join(counted, "bin", "left")
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("lower"),
            (lo + (F.col("bin") + 1) * width).alias("upper"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def histogram(
    df: DataFrame, column: str, bins: int, view: str = "full", cap: float | None = None
) -> DataFrame:
    """Equal-width histogram of a column.

    ``full`` spans the values; ``log1p`` the logarithms of the positive ones; ``log1p_all`` of
    all; ``p95`` spans 0 to the 95th percentile and leaves the rest out; ``below_p95`` spans the
    values up to it; ``p99`` moves the values above the 99th percentile to it; ``cap`` those
    above a given one.
    """
    values = df.select(F.col(column).cast("double").alias("value")).filter(F.col("value").isNotNull())
    if view in ("log1p", "log1p_all"):
        if view == "log1p":
            values = values.filter(F.col("value") > 0)
        values = values.select(F.log1p("value").alias("value"))
    elif view in ("p95", "below_p95"):
        top = F.lit(quantile_values(values, "value", [0.95])[0]).cast("double")
        if view == "p95":
            return _binned(values, F.lit(0.0), top, bins)
        values = values.filter(F.col("value") <= top)
    elif view == "p99":
        top = F.lit(quantile_values(values, "value", [0.99])[0]).cast("double")
        values = values.select(clip(F.col("value"), hi=top).alias("value"))
    elif view == "cap":
        values = values.select(clip(F.col("value"), hi=float(cap)).alias("value"))
    elif view != "full":
        raise ValueError(f"unknown view: {view}")
    ends = resolved_row(values.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    return _binned(values, ends["lo"], ends["hi"], bins)


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with the share of rows at or below them."""
    counted = (
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_sums(counted, ["value"], ["n"])
    rows = counted.agg(F.sum("n").alias("n")).scalar()
    return placed.select("value", "n", (F.col("cum_n") / rows).alias("cumulative_share"))


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Box-plot numbers of log1p: quartiles, whiskers at 1.5 times their distance, outliers."""
    logs = df.select(*[F.log1p(c).alias(c) for c in columns])
    found = {c: q for c, q in zip(columns, exact_quantiles(logs, columns, [0.25, 0.5, 0.75])) if q[0] is not None}
    parts = []
    for c, (p25, p50, p75) in found.items():
        reach = 1.5 * (p75 - p25)
        inside = F.col(c).between(p25 - reach, p75 + reach)
        parts.append(F.struct(
            F.lit(c).alias("column"), F.lit(p25).alias("p25"), F.lit(p50).alias("p50"), F.lit(p75).alias("p75"),
            F.min(F.when(inside, F.col(c))).alias("whisker_low"), F.max(F.when(inside, F.col(c))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        ))
    if not parts:
        return quantile_table(logs, columns, [0.25, 0.5, 0.75]).selectExpr(
            "*", "p25 AS whisker_low", "p25 AS whisker_high", "0L AS outliers")
    return logs.agg(F.array(*parts).alias("boxes")).select(F.inline("boxes"))


#: Cells of the grid per bandwidth and over the whole range at most, and reach of a kernel in bandwidths.
_CELLS, _MOST_CELLS, _REACH = 64, 1 << 16, 9


def density_error(step: float, bandwidth: float) -> float:
    """What linear binning can add to or take from a density at most: an eighth of the squared step
    times the largest second derivative of the kernel."""
    return step * step / 8 / (bandwidth ** 3 * math.sqrt(2 * math.pi))


def density_step(lo: float, hi: float, bandwidth: float) -> float:
    """Width of a cell: a power of two, so that whole numbers and their halves lie on the grid and are binned exactly."""
    return 2.0 ** math.floor(math.log2(max(bandwidth / _CELLS, (hi - lo) / _MOST_CELLS)))


def density(df: DataFrame, column: str, points: int = 200, cap: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid over the values, Scott's bandwidth.

    Linear binning: a row divides its weight between the two cells beside it, so that the kernels are those of
    the cells, ``2 ** 17`` at most, whatever the number of rows and distinct values. A cell
    adds to the points within its reach. ``density_error`` bounds the difference from the exact sum.
    """
    value = F.col(column).cast("double")
    values = df.filter(value.isNotNull()).select(
        (value if cap is None else clip(value, hi=float(cap))).alias("value")
    )
    facts = values.agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_samp("value").alias("std"),
    ).first()
    n, lo, hi, std = facts
    if not std:  # no spread, no bandwidth
        return df.sparkSession.range(0, points if n else 0, numPartitions=1).select(
            F.col("id").cast("int").alias("point"), F.lit(lo).alias("grid_value"), F.lit(None).cast("double").alias("density"))
    bandwidth = std * n ** -0.2
    step, gap = density_step(lo, hi, bandwidth), (hi - lo) / (points - 1)
    at = F.col("value") / step
    left = F.floor(at)
    share = at - left
    cells = values.groupBy(left.alias("cell")).agg(F.sum(1 - share).alias("here"), F.sum(share).alias("next"))
    # one row per cell from here on
    near = lambda centre, side: F.floor((centre + side * _REACH * bandwidth - lo) / gap).cast("int")
    weights = cells.select(F.inline(F.array(
        F.struct((F.col("cell") * step).alias("centre"), F.col("here").alias("weight")),
        F.struct(((F.col("cell") + 1) * step).alias("centre"), F.col("next").alias("weight"))))).filter("weight > 0")
    reached = weights.select("*", F.explode(F.sequence(
        F.greatest(near(F.col("centre"), -1), F.lit(0)), F.least(near(F.col("centre"), 1) + 1, F.lit(points - 1)))).alias("point"))
    z = (lo + F.col("point") * gap - F.col("centre")) / bandwidth
    kernels = reached.groupBy("point").agg(F.sum(F.col("weight") * F.exp(-z * z / 2)).alias("_kernel"))
    grid = df.sparkSession.range(0, points, numPartitions=1).select(F.col("id").cast("int").alias("point"))
    return grid.join(kernels, "point", "left").select(
        "point", (F.lit(lo) + F.col("point") * gap).alias("grid_value"),
        (F.coalesce("_kernel", F.lit(0.0)) / (n * bandwidth * math.sqrt(2 * math.pi))).alias("density"),
    ).orderBy("point")
