"""What each of five filters removes in every order, by a Gray-code walk over their subsets.

A document is known by its mask: one bit per filter that it fails. Documents are counted per part and
mask, 32 cells at most, and everything asked about 120 orders is answered from those. The walk visits
the 32 sets of active filters so that each differs from the one before by one filter. A cell has a
counter of the active filters it fails, and its documents leave the running survivors when the
counter leaves zero, and return when it is zero again. The survivors of the 32 sets are stored; a step
of an order is the difference between the states before and after it.

Filters: A under 200 words; B fewer than half of the words distinct; C more than two in 100 code points
in A-Z; D one of ``#$%&*|``; E equal to the text of a smaller ``doc_id`` of the whole table. Texts are
equal when their SHA-256 is.

Null text is the empty text. A null source is the part of the empty string. A row without a ``doc_id``
never fails E, nor does any other because of it, and has no labels. Rows that share a ``doc_id`` are
counted each; of equal texts all rows of the smallest id stay. Of several labels of one id, one suffices.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.shared import over_batches, whole_text

FILTERS = "ABCDE"
COPY = 16  # the bit of E
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
STEP = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def mask(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text),
        any(s in data for s in SYMBOLS),
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and digest of every whole text."""
    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks, digests = [], []
        for value in batch.column(2):  # one text at a time
            text = value.as_py()
            masks.append(mask(text))
            digests.append(hashlib.sha256(text.encode()).digest())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return over_batches(docs.select(F.col("doc_id").cast("long"), part, whole_text()), describe, "doc_id long, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five bits), n, good, toxic: documents counted, at most 32 rows a part.

    Only ids, parts and digests are shuffled. Copies are counted before they meet, so a group that
    holds a third of all rows is a few rows per task when its smallest id is looked for.
    """
    holds = lambda column: F.max(F.coalesce(F.col(column) == 1, F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality", "toxic").filter("_id IS NOT NULL").groupBy("_id").agg(
        holds("quality").alias("good"), holds("toxic").alias("toxic"))
    # rows without an id match nothing, and are spread by their digest
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    rows = marked(docs).withColumn("_apart", apart).join(known.withColumn("_none", F.lit(0)), (F.col("doc_id") == F.col("_id")) & (F.col("_apart") == F.col("_none")), "left")
    same = ["digest", "part", "mask", "good", "toxic"]
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")}
    ids = rows.withColumns(flags).groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = ids.groupBy(*same).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first.alias("first"))
    # a digest has a row per part and label here, however many copies
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    stay = F.col("unnamed") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    split = copies.withColumn("_stay", F.coalesce(stay, F.col("n"))).select(
        "part", "good", "toxic", F.inline(F.array(
            F.struct(F.col("mask"), F.col("_stay").alias("n")),
            F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("_stay")).alias("n")))))
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return split.filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def survivors(masks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of the 32 sets of active filters, what is left of the counted columns."""
    states = np.empty((1 << len(FILTERS), counts.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)
    running, active = counts.sum(axis=0), 0
    states[0] = running
    for turn in range(1, len(states)):
        toggled = turn & -turn  # the one bit in which neighbours of the reflected Gray code differ
        active ^= toggled
        hit = np.flatnonzero(masks & toggled)
        if active & toggled:
            running = running - counts[hit[failing[hit] == 0]].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + counts[hit[failing[hit] == 0]].sum(axis=0)
        states[active] = running
    return states


def steps(states: np.ndarray) -> list[tuple]:
    """filter_order, step and the figures of STEP, for all orders, from the stored states."""
    everything = len(states) - 1
    bits = {letter: 1 << k for k, letter in enumerate(FILTERS)}
    fails = {f: states[0] - states[b] for f, b in bits.items()}
    alone = {f: states[everything ^ b] - states[everything] for f, b in bits.items()}
    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for place, letter in enumerate(order, 1):
            after = before | bits[letter]
            removed, good, toxic = (states[before] - states[after]).tolist()
            shapley[letter] += removed
            rows.append(("".join(order), place, letter, int(states[after][0]), removed, int(fails[letter][0]) - removed, int(alone[letter][0]), good, toxic))
            before = after
    return [(order, place, *figures, shapley[letter]) for order, place, letter, *figures in rows]


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, with the counts of STEP."""
    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, rows = [], []
        for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table = np.array([(c["mask"], c["n"], c["good"], c["toxic"]) for c in found], np.int64)
            mine = steps(survivors(table[:, 0], table[:, 1:]))
            parts += [part] * len(mine)
            rows += mine
        kinds = (pa.string(), pa.int32(), *[pa.int64()] * len(STEP))
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.string()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["part", "filter_order", "step", *STEP])
    per_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return over_batches(per_part, walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in STEP))
