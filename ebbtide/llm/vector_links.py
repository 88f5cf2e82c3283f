"""Near-duplicate vectors of equal label, by iterative quantisation and multi-index Hamming tables.

A rotation that brings the principal axes of a sample as near to balanced binary codes as it can is
learned by alternating between codes and rotation. The signs of a rotated vector are bits of its code; several
rotations, from different starts, give as many bits as the tables need. A table takes ``s`` bits of
the code of its own. Vectors that agree in the bits of a table meet in a bucket, where their whole
codes are compared; near ones are joined by a spanning forest, never by all pairs. What is so
connected is a cell, and its original vectors are compared in doubles, every pair of a cell once.

How many bits: ``s`` is the logarithm of the largest label's rows, 16 at least, so that buckets of
unlike vectors stay small. A pair at the limit differs in a share f of its bits; there are as many tables as leave
it unmet with a chance of ``MISS``, and whole codes may differ in the expected bits and four deviations
more. The sample, ``SAMPLE`` vectors at most, decides on the rotations and f alone: every vector is
indexed. Buckets and cells of more than ``BLOCK`` rows are dealt to pairs of blocks, so no task holds
more than two blocks, and links of hot groups are counted there, not emitted.

Vectors that are null, empty or zero, hold null or non-finite components, or have a null label or a null
``vec_id`` link with nothing. Vectors of different lengths do not link. Equal vectors of a label are
one class with a multiplicity, and link with each other. Rows that share a ``vec_id`` are vectors of
their own with links of their own, but one node of the components. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.ngram_join import components
from ebbtide.llm.shared import over_batches, slices
from ebbtide.runtime import materialized

COSINE, MISS, SAMPLE, TURNS, BLOCK, LEAST_BITS = 0.98, 0.005, 4096, 50, 1024, 16


def unit(values: list[float | None] | None) -> np.ndarray | None:
    """The vector at length one in doubles, or None if it links with nothing."""
    if not values or None in values:
        return None
    x = np.asarray(values, np.float64)
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most  # squares of very large and very small components stay finite
    return x / np.sqrt(x @ x)


def _start(size: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([size, number]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def learned_rotation(sample: np.ndarray, number: int) -> np.ndarray:
    """Iterative quantisation: principal axes, then alternating codes and rotation."""
    size = sample.shape[1]
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    projected, rotation = sample @ axes, _start(size, number)
    for _ in range(TURNS):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ codes)
        rotation = left @ right
    return axes @ rotation


class Quantiser:
    """Centre and rotations of one vector length, and the share of bits in which a pair at the limit differs."""

    def __init__(self, sample: np.ndarray | None, size: int, cosine: float):
        self.size, self.sample = size, sample
        self.centre, spread = np.zeros(size), 1.0
        if sample is not None:
            mean = sample.mean(axis=0)
            for part in (1.0, 0.5):  # as much of the mean as leaves 95 of 100 vectors half of their squared length
                left = float(np.quantile(((sample - part * mean) ** 2).sum(axis=1), 0.05))
                if left >= 0.5:
                    self.centre, spread = part * mean, left
                    break
        self.differ = max(math.acos(max(-1.0, 1 - (1 - cosine) / spread)) / math.pi, 1e-3)

    def rotations(self, bits: int) -> np.ndarray:
        """Columns that each give a bit."""
        made = [_start(self.size, k) if self.sample is None else learned_rotation(self.sample - self.centre, k) for k in range(-(-bits // self.size))]
        return np.concatenate(made, axis=1)[:, :bits]


def tables_needed(differ: float, bits: int, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-((1 - differ) ** bits))))


def _label() -> Column:
    return F.col("label").cast("string")


class Plan:
    """Bits per table, and per vector length the centre, rotations, tables and allowed difference."""

    def __init__(self, vectors: DataFrame, cosine: float):
        sizes = vectors.groupBy(_label().alias("label"), F.size("embedding").alias("size")).count()
        rows, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(1))).first()
        self.bits = max(LEAST_BITS, math.ceil(math.log2(largest)))
        self.cosine = cosine
        # a share by hash first, so that a task sends the driver its share of the sample and no more
        share = min(1.0, 4 * SAMPLE / max(rows, 1))
        by = F.xxhash64("vec_id", "embedding")
        drawn = vectors.filter(F.pmod(by, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(by, "vec_id").limit(SAMPLE)
        found: dict[int, list[np.ndarray]] = {}
        for row in drawn.select("embedding").collect():
            x = unit(row.embedding)
            if x is not None:
                found.setdefault(len(x), []).append(x)
        self.made = {size: self._make(Quantiser(np.array(rows), size, cosine)) for size, rows in found.items()}

    def _make(self, quantiser: Quantiser) -> tuple[np.ndarray, np.ndarray, int, int]:
        tables = tables_needed(quantiser.differ, self.bits)
        total, f = tables * self.bits, quantiser.differ
        return quantiser.centre, quantiser.rotations(total), tables, math.ceil(total * f + 4 * math.sqrt(total * f * (1 - f)))

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """A length that the sample has not met takes random rotations about the origin."""
        if size not in self.made:
            self.made[size] = self._make(Quantiser(None, size, self.cosine))
        return self.made[size]

    def code(self, x: np.ndarray) -> bytes:
        centre, rotations, _, _ = self.of(len(x))
        return np.packbits((x - centre) @ rotations >= 0).tobytes()

    def keys(self, label: str, size: int, code: bytes) -> list[int]:
        """A bucket per table: a hash of its number and bits within the label. Buckets that share one by chance are one,
        which costs comparisons alone."""
        _, _, tables, _ = self.of(size)
        bits = np.unpackbits(np.frombuffer(code, np.uint8), count=tables * self.bits).reshape(tables, self.bits)
        named = label.encode()
        return [xxhash.xxh3_64_intdigest(t.to_bytes(4, "big") + row.tobytes() + named) - (1 << 63) for t, row in enumerate(np.packbits(bits, axis=1))]


def described(vectors: DataFrame, plan: Plan) -> DataFrame:
    """vec_id, label, size, and digest and code of the vectors that can link."""
    shared = vectors.sparkSession.sparkContext.broadcast(plan)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for vec_id, label, values in zip(*batch.columns):
            x = unit(values.as_py()) if vec_id.is_valid and label.is_valid else None
            if x is None:
                rows.append((None, None, None))
            else:
                rows.append((len(x), digest(label.as_py(), values.as_py()), shared.value.code(x)))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["vec_id", "label", "size", "digest", "code"])
    return over_batches(vectors.select("vec_id", _label().alias("label"), "embedding"), describe, "vec_id long, label string, size int, digest binary, code binary")


def digest(label: str, values: list[float]) -> bytes:
    """Names a class: equal vectors of one label. Minus zero equals zero."""
    named = label.encode()
    return hashlib.blake2b(len(named).to_bytes(8, "big") + named + (np.asarray(values, np.float64) + 0.0).tobytes(), digest_size=16).digest()


def dealt(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows of groups of two or more, each with the pairs of blocks (_i <= _j) of its group that hold it, and its block."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    blocks = F.ceil(F.col("_rows") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64(by), blocks).cast("int")
    placed = rows.join(groups, keys).withColumn("_blocks", blocks).withColumn("_block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return placed.withColumn("_other", other).select(
        *rows.columns, "_block", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that come sorted by keys, each whole: at most two blocks are held, and a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        at = 0
        for i in range(len(values) + 1):
            if i < len(values) and values[i] == last:
                continue
            if i > at:
                held.append(batch.slice(at, i - at))
            if i < len(values):
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, values[i]
    if held:
        yield pa.Table.from_batches(held)


def grouped(rows: DataFrame, keys: list[str], function: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """Rows (a, b, digest, n) of a function of every group's table."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["a", "b", "digest", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for table in runs(batches, keys):
            found += function(table)
            if len(found) >= 10_000:
                yield batch(found)
                found = []
        if found:
            yield batch(found)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, "a long, b long, digest binary, n long")


def forest(count: int, near) -> list[tuple[int, int]]:
    """A spanning forest of the graph of ``count`` nodes; ``near(i, others)`` tells which others node i meets."""
    edges, left = [], np.arange(count)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            edges += [(i, int(j)) for j in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return edges


def near_codes(classes: DataFrame, plan: Plan) -> DataFrame:
    """a, b: forests of the codes that meet in a table and differ in few enough bits."""
    shared = classes.sparkSession.sparkContext.broadcast(plan)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys = [shared.value.keys(*row) for row in zip(*(part.column(k).to_pylist() for k in ("label", "size", "code")))]
            take = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k).take(take) for k in ("node", "size", "code")), pa.array([k for own in keys for k in own], pa.int64())],
                names=["node", "size", "code", "key"])

    def compare(table: pa.Table) -> list[tuple]:
        nodes, size = table.column("node").to_pylist(), table.column("size")[0].as_py()
        allowed = shared.value.of(size)[3]
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(nodes), -1)
        near = lambda i, others: np.bitwise_count(codes[others] ^ codes[i]).sum(axis=1, dtype=np.int64) <= allowed
        return [(nodes[i], nodes[j], None, None) for i, j in forest(len(nodes), near) if nodes[i] != nodes[j]]

    rows = classes.select("node", "label", "size", "code").mapInArrow(index, "node long, size int, code binary, key long")
    return grouped(dealt(rows, ["key", "size"], "node"), ["key", "size", "_i", "_j"], compare).select("a", "b")


def verified(members: DataFrame, cosine: float) -> DataFrame:
    """Of cells of vectors: rows (a, b, null, null), forests of the links, and (null, null, digest, n), links of a class counted.

    Every pair of a cell is compared in one pair of blocks.
    """
    def compare(table: pa.Table) -> list[tuple]:
        own = table.column("digest").to_pylist()
        nodes, rows = table.column("node").to_pylist(), np.array(table.column("rows").to_pylist(), np.int64)
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(nodes), -1)
        first, second = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        block = np.array(table.column("_block").to_pylist())
        one = np.flatnonzero(block == first)
        other = one if first == second else np.flatnonzero(block == second)
        linked = np.zeros((len(nodes), len(nodes)), bool)
        linked[np.ix_(one, other)] = x[one] @ x[other].T >= cosine
        linked |= linked.T
        np.fill_diagonal(linked, False)
        counts = linked @ rows
        edges = [(nodes[i], nodes[j], None, None) for i, j in forest(len(nodes), lambda i, others: linked[i, others]) if nodes[i] != nodes[j]]
        return edges + [(None, None, own[i], int(counts[i])) for i in np.flatnonzero(counts)]

    return grouped(dealt(members, ["cell", "label", "size"], "digest"), ["cell", "label", "size", "_i", "_j"], compare)


def units(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """The columns of classes and the vector, at length one, of each."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for label, values in zip(batch.column(1), batch.column(2)):
            x = unit(values.as_py()) if label.is_valid else None
            rows.append((None, None) if x is None else (digest(label.as_py(), values.as_py()), x.tobytes()))
        columns = [pa.array(c, pa.binary()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["node", "label", "digest", "unit"]).drop_columns(["label"])
    wanted = vectors.join(classes.select("node").distinct(), F.col("vec_id") == F.col("node"), "left_semi")
    made = over_batches(wanted.select("vec_id", _label().alias("label"), "embedding"), make, "node long, digest binary, unit binary")
    return classes.join(made.dropDuplicates(["node", "digest"]), ["node", "digest"])


def vector_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vectors = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    plan = Plan(vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0"), cosine)
    rows = materialized(described(vectors, plan))
    classes = materialized(rows.filter("code IS NOT NULL").groupBy("label", "size", "digest").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("rows"), F.first("code").alias("code")))
    edges = materialized(near_codes(classes, plan))
    joined = materialized(components(edges).select("node", F.col("component").alias("_cell")))  # the smallest of each has no row
    cells = joined.unionAll(joined.select(F.col("_cell").alias("node"), "_cell").distinct())
    cellmates = classes.join(cells, "node").select("node", "label", "size", "digest", "rows", F.col("_cell").alias("cell"))
    compared = materialized(verified(units(vectors, cellmates), cosine))
    links = components(compared.filter("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "_node", "component": "_component"})
    counts = compared.filter("n IS NOT NULL").groupBy("digest").agg(F.sum("n").alias("_others"))
    named = (
        classes.join(counts, "digest", "left").join(links, F.col("node") == F.col("_node"), "left")
        .withColumn("_links", F.coalesce("_others", F.lit(0)) + F.col("rows") - 1)
        .filter("_links > 0 OR _component IS NOT NULL")
        .select("digest", "_links", F.coalesce("_component", "node").alias("_component"))
    )
    component = F.coalesce("_component", "vec_id")
    return rows.join(materialized(named), "digest", "left").select(
        "vec_id", F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
