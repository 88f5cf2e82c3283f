"""How unevenly a total is spread: Lorenz curve, Gini coefficient, share of the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.ordering import running_sums
from ebbtide.runtime import one_row


def _collapsed(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """Distinct values, ascending, with running counts and running sums, and the totals ``n`` and
    ``amount`` of all rows; negatives count as 0."""
    value = F.greatest(F.col(column).cast("double"), F.lit(0.0))
    counted = (
        df.filter(F.col(column).isNotNull()).groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("amount", F.col("value") * F.col("n"))
    )
    totals = one_row(counted.agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")))
    return running_sums(counted, ["value"], ["n", "amount"]), totals


def lorenz(df: DataFrame, column: str) -> DataFrame:
    """The Lorenz curve at the last row of each distinct value."""
    placed, totals = _collapsed(df, column)
    return placed.select(
        "value",
        (F.col("cum_n") / totals["n"]).alias("population_share"),
        F.try_divide(F.col("cum_amount"), totals["amount"]).alias("cumulative_share"),
    )


def gini(df: DataFrame, column: str) -> DataFrame:
    """Gini coefficient by trapezoids over the Lorenz points, from the first point on.

    With values in ascending order the trapezoids add up to
    ``1 - (2 / n) * (sum((n - i + 1) * x_i) / S - (x_1 / S + 1) / 2)``. A value shared by ``n``
    rows holds consecutive places i, whose sum has a closed form; the weighted sum is that of
    ``i * x_i``, so no row needs the total.
    """
    placed, _ = _collapsed(df, column)
    first, last = F.col("cum_n") - F.col("n") + 1, F.col("cum_n")
    rows = F.col("n")
    return placed.agg(
        F.sum("n").alias("n"), F.sum("amount").alias("total"), F.min("value").alias("lowest"),
        F.sum(F.col("amount") * (first + last) / 2).alias("by_place"),
    ).select(
        rows.alias("entities"),
        (
            1 - (2 / rows) * (
                F.try_divide((rows + 1) * F.col("total") - F.col("by_place"), F.col("total"))
                - (F.try_divide(F.col("lowest"), F.col("total")) + 1) / 2
            )
        ).alias("gini"),
    )


def top_share(df: DataFrame, column: str, fraction: float, rounding: str = "floor") -> DataFrame:
    """Percent of the total held by the largest ``fraction`` of rows.

    ``floor`` rounds the number of rows down, ``ceil`` up and to at least one.
    """
    placed, totals = _collapsed(df, column)
    rows = totals["n"]
    exact = rows * fraction
    taken = F.greatest(F.ceil(exact), F.lit(1)) if rounding == "ceil" else F.floor(exact)
    # how many of a shared value's rows are among the top ones
    inside = F.least(F.greatest(F.col("cum_n") - (rows - taken), F.lit(0)), F.col("n"))
    return placed.agg(
        F.sum("n").alias("entities"),
        F.sum(inside).alias("top_entities"),
        F.try_divide(F.sum(inside * F.col("value")) * 100, F.sum("amount")).alias("top_share_pct"),
    )
