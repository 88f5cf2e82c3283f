"""Global order without a one-task window, and without writing: rank, running sums, look-back.

``Window.orderBy`` without a partition moves every row to one task. Here the order is cut into parts at
keys that are drawn once and become literals, and a row finds its part by a binary search within the
expression: the same part wherever it is computed. So the totals of the parts are one map-side
aggregation, and rows are shuffled once, by part, for the window that does the rest. A key that many
rows share spans several parts where the order goes on after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys drawn per part, and parts per shuffle partition: several small parts even out their differences.
_DRAWN, _PARTS = 16, 2


def _cuts(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """Ascending keys as literals, about as many distinct keys between any two.

    The draw takes one key of each of a fixed number of hash buckets, so it is bounded whatever the
    number of rows, needs no count first, and a key's copies do not add to its chance.
    """
    parts = _PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*order_by), F.lit(_DRAWN * parts))
    # by column, not as a struct, which would sort all rows by bucket: columns of numbers are drawn by hashing
    drawn = df.groupBy(bucket.alias("_bucket")).agg(*[F.min_by(c, F.xxhash64(F.lit(1), *order_by)).alias(c) for c in order_by]).drop("_bucket")
    rows = drawn.repartition(1).sortWithinPartitions(*order_by).collect()
    fields = drawn.schema.fields
    return [_key([_literal(v, f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows[_DRAWN::_DRAWN]]


def _key(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def _literal(value, kind: T.DataType) -> Column:
    plain = value is None or isinstance(value, (bool, int, float, str, bytes))
    return F.lit(value if plain else str(value)).cast(kind)


def _parted(df: DataFrame, order_by: Sequence[str], cuts: Sequence[Column] | None = None) -> DataFrame:
    """Add ``_part``, the number of cuts that are not above the row's key."""
    cuts = _cuts(df, order_by) if cuts is None else cuts
    key, bounds = _key([F.col(c) for c in order_by]), F.array(*cuts)
    # zero, but not a constant: without cuts the optimizer would make joins by part products
    found = df.withColumn("_part", F.lit(0) if cuts else F.pmod(F.xxhash64(*order_by), F.lit(1)).cast("int"))
    for bit in reversed(range(len(cuts).bit_length())):
        reached = F.get(bounds, F.col("_part") + (1 << bit) - 1) <= key
        found = found.withColumn("_part", F.col("_part") + F.when(reached, 1 << bit).otherwise(0))
    return found


def _offsets(parted: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Totals of all parts before each. One row per part, which bounds the broadcast."""
    per_part = parted.groupBy("_part").agg(*[total.alias(name) for name, total in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per_part.select("_part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in totals]))


def ranked(df: DataFrame, order_by: Sequence[str], name: str = "global_rank") -> DataFrame:
    """Add the 1-based position of each row in the ascending order of ``order_by``.

    End ``order_by`` with a unique column to make ties repeatable; that also lets a value shared by
    many rows span several parts.
    """
    parted = _parted(df, order_by)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return (
        parted.withColumn(name, place)
        .join(_offsets(parted, {"_rows": F.count(F.lit(1))}), "_part")
        .withColumn(name, F.col("_rows") + F.col(name))
        .drop("_part", "_rows")
    )


def running_sums(df: DataFrame, order_by: Sequence[str], sums: Sequence[str], rows: DataFrame | None = None) -> DataFrame:
    """Add ``cum_<c>`` for each ``c`` in ``sums``: the sum up to and including the row.

    ``order_by`` must be unique; collapse equal values with a ``groupBy`` first. ``rows`` can be the rows before that,
    with the same keys and columns to sum: copies of a key change neither the draw of the cuts nor the totals of the
    parts, and taken from ``rows`` both need no shuffle of the keys.
    """
    rows = df if rows is None else rows
    cuts = _cuts(rows, order_by)
    parted = _parted(df, order_by, cuts)
    offsets = _offsets(_parted(rows, order_by, cuts), {f"_offset_{c}": F.sum(c) for c in sums})
    within = Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        parted.withColumns({f"cum_{c}": F.sum(c).over(within) for c in sums})
        .join(offsets, "_part")
        .withColumns({f"cum_{c}": F.col(f"_offset_{c}") + F.col(f"cum_{c}") for c in sums})
        .drop("_part", *[f"_offset_{c}" for c in sums])
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add the ``value`` of the row before, in ``order_by`` within equal ``keys``.

    A window per key would put all rows of a key into one task. Here a key with many rows spans
    several parts; the first row of a part looks back at the last row of the part before it.
    """
    order = [*keys, *order_by]
    parted = _parted(df, order)
    row = F.struct(*keys, value)
    last_rows = parted.groupBy("_part").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carried = last_rows.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    part = Window.partitionBy("_part").orderBy(*order)
    looked_back = parted.withColumns({f"_before_{c}": F.lag(c).over(part) for c in (*keys, value)} | {"_place": F.row_number().over(part)})
    before = {c: F.when(F.col("_place") == 1, F.col("_carried")[c]).otherwise(F.col(f"_before_{c}")) for c in (*keys, value)}
    # no row is before the very first one
    same_key = (F.col("_place") > 1) | F.col("_carried").isNotNull()
    for key in keys:
        same_key = same_key & before[key].eqNullSafe(F.col(key))
    return (
        looked_back.join(F.broadcast(carried), "_part")
        .withColumn(name, F.when(same_key, before[value]))
        .drop("_part", "_carried", "_place", *[f"_before_{c}" for c in (*keys, value)])
    )
