"""Totals and exact distinct counts per key from a few grains, without multiplying rows.

Several distinct counts in one aggregation make Spark copy every row once per count (Expand). Here the
lines are summed to one fine grain first, such as (customer, invoice), with partial totals carried
along, and each distinct count comes from a narrow table of its own pairs, reduced on the map side. All of
them meet in one aggregation per key. No task holds the values of a key, and a hot key's
lines are spread over its fine grain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Total:
    """An aggregate over lines, and how partial results of it merge."""

    of: Column
    merge: Callable[[str], Column] = F.sum


@dataclass(frozen=True)
class Distinct:
    """An exact distinct count of a value, NULL left out; ``coarser`` adds the distinct count of what
    the value determines, such as the months of days, from the same table."""

    value: Column
    coarser: tuple[str, Callable[[Column], Column]] | None = None


def holds(where: Column) -> Total:
    """How many groups of the fine grain have a line with this condition."""
    return Total(F.max(F.when(where, F.lit(1))), F.count)


def by_grains(
    lines: DataFrame, key: str, fine: str, totals: dict[str, Total], distinct: dict[str, Distinct]
) -> DataFrame:
    """One row per key: the totals, and the distinct counts."""
    parts = [lines.groupBy(key, fine).agg(*[t.of.alias(name) for name, t in totals.items()]).drop(fine)]
    counts = list(distinct)
    for name, d in distinct.items():
        pairs = lines.select(key, d.value.alias("_value")).filter("_value IS NOT NULL").distinct()
        if d.coarser is None:
            parts.append(pairs.select(key, F.lit(1).cast("long").alias(name)))
        else:
            other, of = d.coarser
            counts.append(other)
            parts.append(pairs.groupBy(key, of(F.col("_value")).alias("_coarse")).agg(F.count(F.lit(1)).alias(name)).select(
                key, name, F.lit(1).cast("long").alias(other)))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.groupBy(key).agg(
        *[t.merge(name).alias(name) for name, t in totals.items()],
        *[F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name) for name in counts],
    )
