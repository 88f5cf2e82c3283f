"""Statistics per column from global aggregates: no row is multiplied, sorted or shuffled.

Exact quantiles by bracket refinement. A sketch per column, mergeable and of fixed size, puts an
upper and a lower bound around every wanted rank. Exact counts below and at the bounds then tell
whether the rank is at a bound, or how far inside. A bracket that still holds many rows is narrowed by a sketch
of its inside alone; one that holds few gives up its values at the wanted ranks. Every pass is one
aggregation over the rows for all columns together, and two passes do for most tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a bracket that one aggregate may gather; inverse of a sketch's error in ranks.
GATHERED, ACCURACY = 20_000, 5_000


def per_column(df: DataFrame, columns: Sequence[str], stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per column: ``column`` and each statistic of its values as doubles.

    One aggregation; only its single row of results is turned into rows.
    """
    everything = df.agg(*[
        of(F.col(c).cast("double")).alias(f"{i}_{name}") for i, c in enumerate(columns) for name, of in stats.items()
    ])
    return everything.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{name}").alias(name) for name in stats]) for i, c in enumerate(columns)
    ])))


def _around(fraction: float) -> list[float]:
    """Twice the sketch's error below and above."""
    return [max(0.0, fraction - 2 / ACCURACY), min(1.0, fraction + 2 / ACCURACY)]


class _Rank:
    """A wanted place in the order of a column's values, and the bracket it is known to be in."""

    def __init__(self, column: int, place: int, low: float, high: float):
        self.column, self.place, self.low, self.high = column, place, low, high
        self.before = self.rows = 0  # rows at or below ``low``, and strictly inside
        self.value: float | None = None

    def counted(self, below: dict[float, int], upto: dict[float, int], least: float, most: float) -> bool:
        """Place the rank by exact counts at its bounds; False where the bracket missed it and has moved."""
        if self.place < below[self.low]:
            self.low, self.high = least, self.low
            return False
        if self.place >= upto[self.high]:
            self.low, self.high = self.high, most
            return False
        if self.place < upto[self.low]:
            self.value = self.low
        elif self.place >= below[self.high]:
            self.value = self.high
        self.before, self.rows = upto[self.low], below[self.high] - upto[self.low]
        return True


def sketched(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Rows, least, greatest and the bounds of all points, per column, in one row."""
    fractions = [f for p in points for f in _around(p)]
    value = [F.col(c).cast("double") for c in columns]
    return df.agg(*[
        expression.alias(f"{i}_{name}") for i, v in enumerate(value) for name, expression in (
            ("n", F.count(v)), ("min", F.min(v)), ("max", F.max(v)), ("near", F.percentile_approx(v, fractions, ACCURACY)))
    ])


def bounds_counted(df: DataFrame, columns: Sequence[str], bounds: dict[int, list[float]]) -> DataFrame:
    """Values below, and at or below, every bound, in one row."""
    return df.agg(*[
        F.count_if(side).alias(f"{i}_{k}_{name}") for i, found in bounds.items() for k, bound in enumerate(found)
        for name, side in (("below", F.col(columns[i]).cast("double") < bound), ("upto", F.col(columns[i]).cast("double") <= bound))
    ])


def _inside(columns: Sequence[str], i: int, low: float, high: float) -> Column:
    value = F.col(columns[i]).cast("double")
    return F.when((value > low) & (value < high), value)


def gathered(df: DataFrame, columns: Sequence[str], places: dict[tuple, list[int]]) -> DataFrame:
    """The values at the wanted places inside each bracket, or of the whole column where it has none, in one row."""
    def at(i: int, low: float | None, high: float | None, wanted: list[int]) -> Column:
        values = F.col(columns[i]).cast("double") if low is None else _inside(columns, i, low, high)
        ordered = F.sort_array(F.collect_list(values))
        return F.transform(F.array(*map(F.lit, wanted)), lambda place: F.get(ordered, place))
    return df.agg(*[at(*bracket, wanted).alias(str(k)) for k, (bracket, wanted) in enumerate(places.items())])


def narrowed(df: DataFrame, columns: Sequence[str], ranks: Sequence[_Rank]) -> DataFrame:
    """New bounds from a sketch of the inside of each rank's bracket, in one row."""
    return df.agg(*[
        F.percentile_approx(_inside(columns, r.column, r.low, r.high), _around((r.place - r.before) / max(r.rows - 1, 1)), ACCURACY).alias(str(k))
        for k, r in enumerate(ranks)
    ])


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> list[list[float | None]]:
    """Linearly interpolated quantiles, one list per column; None where a column has no values.

    The driver receives a few numbers per column and point, whatever the number of rows.
    """
    facts = sketched(df, columns, points).first()
    ranks: dict[tuple[int, int], _Rank] = {}
    for i in range(len(columns)):
        n, near = facts[f"{i}_n"], facts[f"{i}_near"]
        for k, point in enumerate(points if n else ()):
            for place in {math.floor((n - 1) * point), math.ceil((n - 1) * point)}:
                ranks.setdefault((i, place), _Rank(i, place, near[2 * k], near[2 * k + 1]))
    small = {i for i in range(len(columns)) if facts[f"{i}_n"] <= GATHERED}
    few = [r for r in ranks.values() if r.column in small]
    open_ranks = [r for r in ranks.values() if r.column not in small]

    while few or open_ranks:
        if open_ranks:
            bounds: dict[int, list[float]] = {}
            for r in open_ranks:
                bounds.setdefault(r.column, []).extend((r.low, r.high))
            bounds = {i: list(dict.fromkeys(found)) for i, found in bounds.items()}
            counts = bounds_counted(df, columns, bounds).first()
            told = {name: {i: {b: counts[f"{i}_{k}_{name}"] for k, b in enumerate(found)} for i, found in bounds.items()} for name in ("below", "upto")}
            placed = [r for r in open_ranks if r.counted(
                told["below"][r.column], told["upto"][r.column], facts[f"{r.column}_min"], facts[f"{r.column}_max"])]
            missed = [r for r in open_ranks if r not in placed]
            inside = [r for r in placed if r.value is None]
            few += [r for r in inside if r.rows <= GATHERED]
            many = [r for r in inside if r.rows > GATHERED]
            if many:
                found = narrowed(df, columns, many).first()
                for k, r in enumerate(many):
                    r.low, r.high = found[k]
            open_ranks = missed + many
        if few:
            places: dict[tuple, list[int]] = {}
            for r in few:
                bracket = (r.column, None, None) if r.column in small else (r.column, r.low, r.high)
                places.setdefault(bracket, []).append(r.place - r.before)
            found = gathered(df, columns, places).first()
            values = {(bracket, place): v for k, (bracket, wanted) in enumerate(places.items()) for place, v in zip(wanted, found[k])}
            for r in few:
                bracket = (r.column, None, None) if r.column in small else (r.column, r.low, r.high)
                r.value = values[bracket, r.place - r.before]
            few = []

    def between(i: int, point: float) -> float | None:
        n = facts[f"{i}_n"]
        if not n:
            return None
        exact = (n - 1) * point
        low, high = ranks[i, math.floor(exact)].value, ranks[i, math.ceil(exact)].value
        return low if low == high else low + (high - low) * (exact - math.floor(exact))
    return [[between(i, p) for p in points] for i in range(len(columns))]


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Exact quantiles as rows ``(column, point, quantile)``; a column without values has none."""
    found = exact_quantiles(df, columns, points)
    rows = [(c, float(p), q) for c, values in zip(columns, found) for p, q in zip(points, values) if q is not None]
    return df.sparkSession.createDataFrame(rows, "column string, point double, quantile double")


def quantile_values(df: DataFrame, column: str, points: Sequence[float]) -> list[float | None]:
    """The quantiles of one column as numbers, one per point; None where there are no rows."""
    return exact_quantiles(df, [column], points)[0]
