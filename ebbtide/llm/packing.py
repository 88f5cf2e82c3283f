"""Packing token sequences: a configuration linear program over the histogram of lengths.

Documents longer than a sequence are cut into full pieces, of which the first takes the remainder.
A configuration says how many pieces of each length share a sequence. The program covers the
histogram of lengths with as few configurations as it can, in fractions: multiplicative weights price the
lengths, a knapsack dynamic program finds the configurations of highest price, a round uses them as far as
the counts of their lengths go, and lengths that it leaves short grow in price by the share they lack. The
average of the rounds, with what it lacks covered at the last prices, is a solution whose distance from the
bound of the dual program is known; rounds end when it is below ``GAP``. It is rounded down to whole
sequences, with best fit, longest first, for the pieces left. Where counts are small and rounding down leaves
most of them, whole configurations by price can be fewer; the fewest are used, those of the program on ties.

The driver holds the histogram (one count per length) and the configurations, whatever the number of
documents. A piece finds its place from its rank among pieces of its length: its rank within its
input task plus a count of those in tasks before.

A null text has the end id alone. Null or repeated ``doc_id`` are packed row by row. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.shared import over_batches, slices, whole_text
from ebbtide.llm.word_encoding import encoder
from ebbtide.runtime import materialized

LIMIT = 1024
#: Texts that a task encodes, and is sent, at a time.
ROWS = 1280
#: Rounds at most, how much dearer a round makes a length it leaves out, how far below the best price a
#: configuration may be to be used, and the gap between solution and bound at which rounds end.
ROUNDS, STEP, SLACK, GAP = 60, 0.3, 0.05, 0.002
#: Fractions of a sequence below this count as none.
TINY = 1e-9
END = np.uint32(2).tobytes()


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids, task, nth: every piece, with its rank in its task and length."""
    def cut(batches):
        words = encoder(tokenizer, True)
        encode, task, seen = words.encode_all, TaskContext.get().partitionId(), Counter()

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            source, rows = [], []
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += END
                n = len(ids) // 4
                ends = range((n - 1) % limit + 1, n + 1, limit)
                for k, end in enumerate(ends):
                    start = 0 if k == 0 else end - limit
                    rows.append((k, start, end - start, ids[4 * start:4 * end], task, seen[end - start]))
                    seen[end - start] += 1
                    source.append(i)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source)), *columns], names=["doc_id", "piece", "start", "length", "ids", "task", "nth"])
        yield from map(of, slices(batches, ROWS))
        # an executor has more workers than tasks, and those that wait would keep their words
        words.forget()
        pa.default_memory_pool().release_unused()

    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return narrow.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, task int, nth long")


def knapsack(price: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest total price that fits into each room, by dynamic programming, and the length last
    taken for it (0: the room less one is as good). A length may be taken any number of times."""
    value, last = np.zeros(limit + 1), np.zeros(limit + 1, np.int64)
    for room in range(1, limit + 1):
        with_last = price[1:room + 1] + value[room - 1::-1][:room]
        best = int(np.argmax(with_last))
        if with_last[best] > value[room - 1]:
            value[room], last[room] = with_last[best], best + 1
        else:
            value[room] = value[room - 1]
    return value, last


def configuration(first: int, last: np.ndarray, limit: int) -> dict[int, int]:
    """The best configuration that holds a piece of length ``first``: counts by length."""
    counts, room = {first: 1}, limit - first
    while room > 0:
        size = int(last[room])
        if size:
            counts[size] = counts.get(size, 0) + 1
        room -= size or 1
    return counts


Plan = list[tuple[dict[int, int], int]]


Fractions = dict[tuple[tuple[int, int], ...], float]


def priced_cover(counts: np.ndarray, price: np.ndarray, limit: int, target: float) -> tuple[Fractions, np.ndarray, float]:
    """Configurations of high price, up to ``target`` of them and to the counts; what is left; the highest price.

    Each length, longest first, offers its best configuration. The knapsack is solved anew without the
    lengths that have run out, until nothing is left or the target is reached.
    """
    left, offered, cover, total, highest = counts.astype(float), price.copy(), {}, 0.0, None
    while total < target - TINY and left.max() > TINY:
        value, last = knapsack(offered, limit)
        highest = value[limit] if highest is None else highest
        sizes = np.flatnonzero(left > TINY)[::-1]
        worth = offered[sizes] + value[limit - sizes]
        for size in sizes[worth >= (1 - SLACK) * worth.max()].tolist():
            content = configuration(size, last, limit)
            times = min(target - total, *(left[s] / n for s, n in content.items()))
            if times > TINY:
                key = tuple(sorted(content.items()))
                cover[key] = cover.get(key, 0.0) + times
                total += times
                for s, n in content.items():
                    left[s] -= n * times
        left[left <= TINY] = 0.0
        offered[left == 0] = -1.0
    return cover, left, highest


def configuration_program(histogram: np.ndarray, limit: int = LIMIT, rounds: int = ROUNDS) -> tuple[Fractions, np.ndarray, float]:
    """A near-optimal fractional cover of the histogram, the prices, and a lower bound of every cover.

    Prices over the knapsack's value are a solution of the dual program, hence the bound; the first one
    is the volume. A round has as many sequences as the bound, so that what it leaves out shows its price.
    """
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return {}, np.zeros(limit + 1), 0.0
    count = histogram[lengths]
    bound = float((count * lengths).sum() / limit)
    price, sums, load = np.full(limit + 1, -1.0), {}, np.zeros(limit + 1)
    price[lengths] = lengths / limit * (1 + lengths / limit / 10)  # a piece twice as long is worth more than two
    solution, fewest = {}, np.inf
    for k in range(1, rounds + 1):
        cover, left, highest = priced_cover(histogram, price, limit, bound)
        bound = max(bound, float((count * price[lengths]).sum() / highest))
        for content, times in cover.items():
            sums[content] = sums.get(content, 0.0) + k * times
        load += k * (histogram - left)
        price[lengths] *= (1 + STEP) ** (left[lengths] / count / np.sqrt(k))
        price[lengths] /= price[lengths].max()
        if k & (k - 1) == 0 or k % 8 == 0 or k == rounds:
            weight = k * (k + 1) / 2  # later rounds know the prices better and count more
            average = {content: times / weight for content, times in sums.items()}
            lacking = np.maximum(histogram - load / weight, 0.0)
            offered = np.where(lacking > TINY, price, -1.0)
            for content, times in priced_cover(lacking, offered, limit, np.inf)[0].items():
                average[content] = average.get(content, 0.0) + times
            if sum(average.values()) < fewest:
                solution, fewest = average, sum(average.values())
            if fewest <= (1 + GAP) * bound:
                break
    return solution, price, bound


def rounded(histogram: np.ndarray, cover: Plan, limit: int = LIMIT) -> Plan:
    """Whole configurations, then best fit for the pieces they leave; uses every piece once."""
    left, plan = histogram.copy(), list(cover)
    for counts, times in cover:
        for size, n in counts.items():
            left[size] -= n * times
    # best fit, longest first, over groups of sequences that are filled alike
    open_: dict[tuple[tuple[int, int], ...], int] = {}
    room_of: dict[int, set] = {}
    rooms = np.zeros(limit + 1, bool)

    def add(content: tuple[tuple[int, int], ...], times: int) -> None:
        room = limit - sum(size * n for size, n in content)
        open_[content] = open_.get(content, 0) + times
        room_of.setdefault(room, set()).add(content)
        rooms[room] = True

    for size in range(limit, 0, -1):
        pending = int(left[size])
        while pending:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                per = limit // size
                if pending >= per:
                    add(((size, per),), pending // per)
                if pending % per:
                    add(((size, pending % per),), 1)
                break
            room = size + int(fits[0])
            content = min(room_of[room])
            times, per = open_[content], min(room // size, pending)
            use = min(times, pending // per)
            open_[content] -= use
            if not open_[content]:
                del open_[content]
                room_of[room].discard(content)
                rooms[room] = bool(room_of[room])
            add((*content, (size, per)), use)
            pending -= use * per
    plan += [(dict(content), times) for content, times in open_.items()]
    return plan


def rounded_by_price(histogram: np.ndarray, price: np.ndarray, limit: int = LIMIT) -> Plan:
    """Whole configurations for the longest piece left, again and again, from the pieces still there.

    The knapsack is solved anew whenever its answer asks for a length that has run out.
    """
    left, plan = histogram.copy(), []
    offered, last = np.where(left > 0, price, -1.0), None
    for size in range(limit, 0, -1):
        while left[size]:
            counts, room = {size: 1}, limit - size
            while room > 0:
                if last is None:
                    last = knapsack(offered, limit)[1]
                take = int(last[room])
                if take and counts.get(take, 0) >= left[take]:
                    if counts.get(take):  # the last ones of their length are in this sequence
                        room -= 1
                        continue
                    offered[take], last = -1.0, None
                    continue
                if take:
                    counts[take] = counts.get(take, 0) + 1
                room -= take or 1
            times = min(int(left[s]) // n for s, n in counts.items())
            for s, n in counts.items():
                left[s] -= n * times
            plan.append((counts, times))
    return plan


def solved(histogram: np.ndarray, limit: int = LIMIT) -> Plan:
    """The program's cover rounded down and completed, or where that takes more, by price, or best fit alone."""
    cover, price, _ = configuration_program(histogram, limit)
    whole = [(dict(content), int(times + TINY)) for content, times in cover.items() if times + TINY >= 1]
    candidates = (rounded(histogram, whole, limit), rounded_by_price(histogram, price, limit), rounded(histogram, [], limit))
    return min(candidates, key=lambda p: sum(t for _, t in p))


def places(plan: Plan) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, pieces a sequence, offset of the first)."""
    used, rows, sequence = Counter(), {}, 0
    for content, times in plan:
        offset = 0
        for size, n in sorted(content.items(), reverse=True):
            rows.setdefault(size, []).append((used[size], sequence, n, offset))
            used[size] += n * times
            offset += n * size
        sequence += times
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def packed(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary), sequence_id, offset."""
    cut = materialized(pieces(docs, tokenizer, limit), rows=ROWS)
    per_task = materialized(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = np.zeros(limit + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    shared = histogram.copy()
    shared[limit] = 0  # full pieces have a sequence each
    where = places([*([({limit: 1}, int(histogram[limit]))] if histogram[limit] else []), *solved(shared, limit)])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(firsts, ["length", "task"]).withColumn("rank", F.col("first") + F.col("nth"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(i).to_numpy() for i in (3, 5))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for size in np.unique(length).tolist():
            of, table = length == size, where[size]
            row = table[np.searchsorted(table[:, 0], rank[of], side="right") - 1]
            nth = rank[of] - row[:, 0]
            sequence[of] = row[:, 1] + nth // row[:, 2]
            offset[of] = row[:, 3] + nth % row[:, 2] * size
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
            names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return over_batches(
        ranked.select("doc_id", "piece", "start", "length", "ids", "rank"), place,
        "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the pieces of each sequence put together in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    # one sequence has at most as many pieces as tokens
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, p: F.concat(out, p["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
