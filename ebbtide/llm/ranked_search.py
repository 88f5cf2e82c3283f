"""Ranked lexical search over a document FP-tree, by branch and bound.

A first pass cuts every whole text into terms and keeps its length and the frequencies of the terms
that some item asks for: the document's restricted vector. These are written once. Document
frequencies come out of them, and order the terms, commonest first; a vector in that order is a path.

Each task makes trees of its vectors, sorted by path, so that a shared beginning of paths is a
node over neighbouring documents. A child that holds most of its parent's documents is opened in its
place, and neighbouring small children are one, so a tree of d documents is log2(d) deep. A node
knows for every term the largest frequency below it, and the smallest m, the length norm. Together
they bound the score of every document below, since the score grows with tf and falls with m. Each item walks the tree depth
first, largest bound first, and leaves out what cannot reach its ten best so far, which are carried
from tree to tree of a task. Every document is in a tree; the tasks' best are merged by Spark.

An item is a pair of ``item_id`` and text; equal rows are one item, and one without terms has no rows. Null
text has no terms, and a document without terms does not count. Rows that share a ``doc_id`` are
documents of their own; null is the smallest id. Empty tables give an empty result. Other columns
are not read. Items are handled in blocks of ``BLOCK`` bytes of text, which bounds what is broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.shared import over_batches, whole_text
from ebbtide.runtime import materialized

BEST, BLOCK = 10, 16 << 20
#: Vectors of a tree: at most so many entries, or one vector. Documents of a leaf, unless their paths are equal.
TREE, LEAF = 1 << 20, 64
SCALE, TF_PART, M_PART, B = 1_000_000_000, 1000, 8, 75

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)) + _SEPARATORS, bytes(range(ord("a"), ord("z") + 1)) + b" " * len(_SEPARATORS))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and whatever is not ASCII, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def norm(length: int, documents: int, all_terms: int) -> int:
    """m, in exact integers."""
    return 100 - B + B * length * documents // all_terms


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight one adds. Grows with tf, falls with m, rounding included."""
    return SCALE * tf // (TF_PART * tf + M_PART * m)


class Tree:
    """Documents in the order of their paths, and nodes over runs of them with their bounds."""

    def __init__(self, ids: list[int | None], norms: np.ndarray, sizes: np.ndarray, found: np.ndarray, tf: np.ndarray, rank: np.ndarray):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((rank[found], owner))  # every vector commonest term first
        found, tf = found[by], tf[by]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        path = rank[found].astype(">u4")
        paths = [path[a:b].tobytes() for a, b in zip(starts, starts[1:])]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order])
        self.ids = [ids[i] for i in order]
        self.found, self.tf = found[take], tf[take]
        self.starts = np.concatenate([[0], np.cumsum(sizes[order])])
        self.norms = norms[order]
        self.gains = gain(self.tf, np.repeat(self.norms, sizes[order]))
        self._paths = [paths[i] for i in order]
        self.root = self._node(0, len(order), 0)
        del self._paths

    def _split(self, low: int, high: int, depth: int) -> list[tuple[int, int]]:
        """Runs of documents low to high, equal down to depth, that agree one term further."""
        at, runs = low, []
        for i in range(low + 1, high + 1):
            if i == high or self._paths[i][4 * depth:4 * depth + 4] != self._paths[at][4 * depth:4 * depth + 4]:
                runs.append((at, i))
                at = i
        return runs

    def _opened(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """Children as (low, high, depth): none has more than half of the documents, unless its paths are equal."""
        done, todo = [], [(low, high, depth)]
        while todo:
            a, b, d = todo.pop()
            if 2 * (b - a) <= high - low or self._paths[a] == self._paths[b - 1]:
                done.append((a, b, d))
                continue
            first, last = self._paths[a], self._paths[b - 1]
            while first[4 * d:4 * d + 4] == last[4 * d:4 * d + 4]:
                d += 1
            todo += [(x, y, d + 1) for x, y in self._split(a, b, d)]
        small, children = None, []
        for a, b, d in sorted(done):  # neighbours that fit into a leaf together are one
            if small is not None and b - small[0] <= LEAF:
                small = (small[0], b, depth)
            else:
                if small is not None:
                    children.append(small)
                small = (a, b, d)
        return [*children, small]

    def _node(self, low: int, high: int, depth: int):
        """None for a leaf, or the children: their documents, and their bounding entries, by child."""
        if high - low <= LEAF or self._paths[low] == self._paths[high - 1]:
            return None
        children = self._opened(low, high, depth)
        found, bounds, sizes = [], [], []
        for a, b, _ in children:
            span = slice(self.starts[a], self.starts[b])
            below, where = np.unique(self.found[span], return_inverse=True)
            most = np.zeros(len(below), np.int64)
            np.maximum.at(most, where, self.tf[span])
            found.append(below)
            bounds.append(gain(most, self.norms[a:b].min()))
            sizes.append(len(below))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        return [(a, b, self._node(a, b, d)) for a, b, d in children], np.concatenate(found), np.concatenate(bounds), starts

    def search(self, weights: np.ndarray, best: list[tuple[int, int, int]]) -> None:
        """Bring the ten best of an item up to date; ``weights`` are its own, zero for other terms."""
        todo = [(np.iinfo(np.int64).max, 0, len(self.ids), self.root)]
        while todo:
            bound, low, high, node = todo.pop()
            if len(best) == BEST and bound < best[0][0]:  # an equal score can still win by its id
                continue
            if node is None:
                span = slice(self.starts[low], self.starts[high])
                scores = np.add.reduceat(weights[self.found[span]] * self.gains[span], self.starts[low:high] - self.starts[low])
                for i in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == BEST else 1)).tolist():
                    key = -1 << 63 if self.ids[low + i] is None else self.ids[low + i]
                    entry = (int(scores[i]), -key, self.ids[low + i] is None)
                    if len(best) < BEST:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                continue
            children, found, bounds, starts = node
            above = np.add.reduceat(weights[found] * bounds, starts)
            least = max(1, best[0][0] if len(best) == BEST else 1)
            for i in np.argsort(above, kind="stable").tolist():  # the largest comes off first
                if above[i] >= least:
                    todo.append((int(above[i]), *children[i]))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms and tf: length and restricted vector of every document with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def restrict(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        lengths, found, counts = [], [], []
        for value in batch.column(1):  # one text at a time
            words = terms(value.as_py())
            mine = [(known[t], c) for t, c in Counter(words).items() if t in known]
            lengths.append(len(words))
            found.append([t for t, _ in mine])
            counts.append([c for _, c in mine])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
            names=["doc_id", "n", "terms", "tf"])
    texts = docs.select(F.col("doc_id").cast("long"), whole_text())
    return over_batches(texts, restrict, "doc_id long, n long, terms array<int>, tf array<long>").filter("n > 0")


def trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, documents: int, all_terms: int) -> Iterator[Tree]:
    """Trees of ``TREE`` entries each, over all vectors of the batches."""
    held: list[pa.RecordBatch] = []
    entries = 0

    def planted() -> Tree:
        table = pa.Table.from_batches(held).combine_chunks()
        found, tf = table.column(2).combine_chunks(), table.column(3).combine_chunks()
        sizes = np.diff(found.offsets.to_numpy())
        norms = np.array([norm(n, documents, all_terms) for n in table.column(1).to_pylist()], np.int64)
        return Tree(table.column(0).to_pylist(), norms, sizes, found.flatten().to_numpy(), tf.flatten().to_numpy(), rank)

    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            rows = max(int(np.searchsorted(ends, before + TREE - entries, "right")) - at, 0 if held else 1)
            if rows:
                held.append(batch.slice(at, rows))
                entries += int(ends[at + rows - 1] - before)
                at += rows
            if at < batch.num_rows:
                yield planted()
                held, entries = [], 0
    if held:
        yield planted()


def ranked_block(docs: DataFrame, items: list[tuple]) -> DataFrame:
    """item (its place in the list), doc_id, score: the ten best of every task and item."""
    asked = [Counter(terms(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    stored = materialized(vectors(docs, vocabulary))
    documents, all_terms = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(max(len(vocabulary), 1), np.int64)
    for term, count in stored.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # of the block's terms
        df[term] = count
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    wanted = []
    for counted in asked:
        own = [(vocabulary[t], c * weight(documents, df[vocabulary[t]])) for t, c in counted.items() if df[vocabulary[t]]]
        wanted.append((np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast((rank, wanted))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, wanted = shared.value
        best: list[list] = [[] for _ in wanted]
        weights = np.zeros(len(rank), np.int64)
        for tree in trees(batches, rank, documents, all_terms):
            for (own, by), found in zip(wanted, best):
                weights[own] = by
                tree.search(weights, found)
                weights[own] = 0
        rows = [(i, None if unnamed else -key, score) for i, found in enumerate(best) for score, key, unnamed in found]
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return stored.filter(F.size("terms") > 0).mapInArrow(walk, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of every item, and its text."""
    spark = docs.sparkSession
    named = items.select(F.col(item_id).alias("item_id"), whole_text().alias("item_text")).distinct()
    total = named.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    kind = named.schema["item_id"].dataType.simpleString()
    found = []
    for number in range(blocks):
        block = named.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == number).collect()
        block = [(row.item_id, row.item_text) for row in block if terms(row.item_text)]
        if not block:
            continue
        best = ranked_block(docs, block)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)
        names = spark.createDataFrame([(i, *pair) for i, pair in enumerate(block)], f"item long, item_id {kind}, item_text string")
        found.append(top.join(F.broadcast(names), "item").select("item_id", "item_text", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, item_text string, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)
