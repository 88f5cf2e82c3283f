"""Scoring with a class-based n-gram model: Brown's exchange clustering, trained on the corpus.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(token | class). The end of
a text is a class of its own, which also stands before the first token.

The clustering has two steps. The first gives a start: the ``UNITS`` most frequent words of the training
texts, each alone, and all others in ``ENDINGS`` groups of one ending move one after the other to the class
that raises the likelihood of the class bigrams most, until a sweep moves none or ``SWEEPS`` are done. Its input,
the counts of neighbouring units, has at most (UNITS + ENDINGS + 1) squared rows whatever the corpus, and
is all that the driver holds. In the second step every other word of the training texts, however rare, leaves its
group and moves by itself: tasks add up how often each class stands before and behind it, and put it
into the class that raises the same likelihood most against the first step's table. These words move
at once, so the model's counts are taken anew afterwards, from the classes of all training tokens. Words not
seen in training have no neighbours to go by, and the class of their ending.

P(class | before) adds ``ADD_CLASS`` to each count. P(word | class) adds ``ADD_WORD`` to each, with one
place per class for all words not seen in training; a class's probabilities sum to one.

Words and counts cover every training text. The ``KNOWN`` most frequent words reach the tasks as a
list of bounded size; counts and classes of the others are joined by word. Null text is the empty text, which is
its end alone. A null ``doc_id`` is in the training part. Rows are scored one by one, also where they
repeat. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice, repeat
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.shared import over_batches, slices, whole_text
from ebbtide.runtime import materialized

UNITS, ENDINGS, CLASSES, SWEEPS = 1024, 1023, 48, 4
KNOWN, ADD_WORD, ADD_CLASS, ADD_BASE = 1 << 16, 0.1, 0.5, 0.1
END = b""  # no word is empty
OPEN = 255  # stands for a class that is joined by word
STEPS = 64  # counts up to this one have what they change looked up


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


class Numbers(defaultdict):
    """Numbers of words in the order they are met, and the words by number."""

    def __init__(self) -> None:
        super().__init__(count().__next__)
        self.names: list[bytes] = []

    def codes(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.names += islice(self, len(self.names), None)
        return found


def joined_tokens(texts: pa.Array) -> tuple[list[bytes], list[int]]:
    """The tokens of all texts, one after the other, and how many each has."""
    words, sizes = [], []
    for text in texts.to_pylist():
        found = tokens(text)
        words += found
        sizes.append(len(found))
    return words, sizes


def ending(word: bytes) -> int:
    """The group of a word that is no unit of its own, by its last four bytes."""
    return zlib.crc32(word[-4:]) % ENDINGS


def unit_of(word: bytes, units: dict[bytes, int]) -> int:
    """Number of the exchange unit: the frequent words, then the endings; the end of a text is 0."""
    return units.get(word) or (0 if word == END else 1 + UNITS + ending(word))


def units_of(words: list[bytes], units: dict[bytes, int]) -> np.ndarray:
    """``unit_of`` each word."""
    get, crc32 = units.get, zlib.crc32
    return np.array([get(w) or (1 + UNITS + crc32(w[-4:]) % ENDINGS if w else 0) for w in words], np.int64)


def word_counts(training: DataFrame) -> DataFrame:
    """word, n: the tokens of all training texts, counted in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in slices(batches):
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        if counts:
            yield out()
    return training.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def unit_pairs(training: DataFrame, units: dict[bytes, int]) -> np.ndarray:
    """How often a unit follows another, over all training texts."""
    size = 1 + UNITS + ENDINGS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in slices(batches):
            number = Numbers()  # of one batch, small enough to stay near the processor
            code = number.codes(joined_tokens(batch.column(0))[0])
            unit = units_of(number.names, units)[code]  # every text ends with the unit that stands before the next one
            np.add.at(total, np.concatenate([[0], unit[:-1]]) * size + unit, 1)
        # a row per unit that stands before, not per pair: tasks see nearly every pair of units
        total = total.reshape(size, size)
        before = np.flatnonzero(total.any(1))
        for k in range(0, len(before), 256):
            some = before[k:k + 256].tolist()
            after = [np.flatnonzero(total[u]) for u in some]
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([v.astype(np.int32).tobytes() for v in after], pa.binary()),
                pa.array([total[u, v].tobytes() for u, v in zip(some, after)], pa.binary())], names=["unit", "after", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for unit, after, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums.setdefault(unit, np.zeros(size, np.int64))[np.frombuffer(after, np.int32)] += np.frombuffer(counts, np.int64)
        for unit, total in sums.items():
            after = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(unit * size + after), pa.array(total[after])], names=["pair", "n"])

    tables = training.select("text").mapInArrow(count, "unit int, after binary, counts binary").repartition("unit")
    rows = tables.mapInArrow(add, "pair long, n long").toArrow()
    pairs = np.zeros(size * size, np.float64)
    pairs[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return pairs.reshape(size, size)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit; unit 0 keeps class 0 to itself.

    Maximizes sum N(g, h) log N(g, h) - sum N(g) log N(g) over left and right margins, the part of the
    bigram likelihood that depends on the classes.
    """
    size = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[(order != 0) & (weight[order] > 0)]
    of = np.zeros(size, np.int64)
    of[1:] = 1 + np.arange(size - 1) % (classes - 1)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    out, into = pairs @ member, pairs.T @ member  # unit to class after it, and class before it to unit
    table = member.T @ out
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            own, self_pair = of[u], pairs[u, u]
            right, left = out[u].copy(), into[u].copy()
            right[own] -= self_pair
            left[own] -= self_pair
            # the table without the unit
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= self_pair
            rows, columns = table.sum(1), table.sum(0)
            gain = (xlogx(table + right) - xlogx(table)).sum(1) + (xlogx(table + left[:, None]) - xlogx(table)).sum(0)
            # the cell of the class with itself changes by both and by the unit's pairs with itself
            d = np.diagonal(table)
            gain += xlogx(d + right + left + self_pair) - xlogx(d + right) - xlogx(d + left) + xlogx(d)
            total_right, total_left = right.sum() + self_pair, left.sum() + self_pair
            gain -= xlogx(rows + total_right) - xlogx(rows) + xlogx(columns + total_left) - xlogx(columns)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table[best] += right
            table[:, best] += left
            table[best, best] += self_pair
            if best != own:
                moved += 1
                of[u] = best
                out[:, own] -= pairs[:, u]
                out[:, best] += pairs[:, u]
                into[:, own] -= pairs[u]
                into[:, best] += pairs[u]
        if not moved:
            break
    return of


def neighbours(training: DataFrame, units: dict[bytes, int], classes: np.ndarray) -> DataFrame:
    """word, entries: per task, how often a class stands before (its number) and behind (and ``CLASSES``) each word that is no unit.

    Entries are 64-bit numbers, 128 times the count and that number.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, of, parts, size = Numbers(), np.empty(0, np.int64), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            words, codes = np.divmod(keys, 2 * CLASSES)
            starts = np.flatnonzero(np.diff(words, prepend=-1))
            for at in range(0, len(starts), 10_000):
                some = starts[at:at + 10_000]
                end = starts[at + 10_000] if at + 10_000 < len(starts) else len(keys)
                cuts = (8 * (np.append(some, end) - some[0])).tolist()
                entries = (128 * n[some[0]:end] + codes[some[0]:end]).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([number.names[w] for w in words[some].tolist()], pa.binary()),
                    pa.array([entries[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["word", "entries"])

        for batch in slices(batches):
            code = number.codes(joined_tokens(batch.column(0))[0])
            of = np.append(of, units_of(number.names[len(of):], units))
            unit = of[code]
            found = classes[unit]  # every text ends with the class that stands before the next one
            at = np.flatnonzero(unit > UNITS)
            parts += [code[at] * 2 * CLASSES + np.concatenate([[0], found])[at], code[at] * 2 * CLASSES + CLASSES + np.append(found, 0)[at + 1]]
            size += 2 * len(at)
            if size > 4_000_000 or len(number) > 500_000:
                yield from out()
                number, of, parts, size = Numbers(), np.empty(0, np.int64), [], 0
        if size:
            yield from out()
    return training.select("text").mapInArrow(count, "word binary, entries binary")


class Gains:
    """What a word's counts change in the likelihood by the class it is put into, against one table of class pairs."""

    def __init__(self, table: np.ndarray) -> None:
        self.size = len(table)
        self.cells = np.concatenate([table, table.T])  # row: class before or behind; column: class of the word
        self.margins = table.sum(1), table.sum(0)
        self.empty = self.margins[1] == 0
        few = np.arange(STEPS + 1)
        self.few = self._step(self.cells, few[:, None, None])
        self.few_all = [self._step(m, few[:, None]) for m in self.margins]

    @staticmethod
    def _f(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    def _step(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self._f(x + n) - self._f(x)

    def _less(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a count that is in ``x`` already has changed there."""
        return self._f(x) - self._f(np.maximum(x - n, 0))

    def best_classes(self, around: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The class of each word, by its counts of classes before and behind it, and the one it is in now."""
        word, code = np.nonzero(around)
        n = around[word, code].astype(np.int64)
        change = self.few[np.minimum(n, STEPS), code]
        many = np.flatnonzero(n > STEPS)
        change[many] = self._step(self.cells[code[many]], n[many, None])
        mine = own[word]
        change[np.arange(len(word)), mine] = self._less(self.cells[code, mine], n)  # it is counted there already
        each, total = np.arange(len(around)), around[:, :self.size].sum(1).astype(np.int64)
        gain = np.add.reduceat(change, np.searchsorted(word, each))  # sorted by word, and every word has neighbours
        many = np.flatnonzero(total > STEPS)
        for margin, few in zip(self.margins, self.few_all):
            step = few[np.minimum(total, STEPS)]
            step[many] = self._step(margin, total[many, None])
            step[each, own] = self._less(margin[own], total)
            gain -= step
        gain[:, 0] = -np.inf
        gain[:, self.empty] = -np.inf  # words that move at once would all meet in one empty class
        best = np.argmax(gain, 1)
        return np.where(gain[each, best] > gain[each, own] + 1e-9, best, own)


def moved(training: DataFrame, units: dict[bytes, int], classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """word, n, class of every training word that is no unit."""
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(table)

        def out(words: list[bytes], around: np.ndarray) -> pa.RecordBatch:
            found = gains.best_classes(around, classes[units_of(words, {})])
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(around[:, :CLASSES].sum(1).astype(np.int64)), pa.array(found, pa.int32())], names=["word", "n", "class"])

        last, sums = None, None  # the word that the next batch may go on with
        for batch in slices(batches):
            words = batch.column(0)
            new = np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))
            entries = batch.column(1).to_pylist()
            group = np.repeat(np.cumsum(new) - 1, [len(x) // 8 for x in entries])
            counts, codes = np.divmod(np.frombuffer(b"".join(entries), np.int64), 128)
            names = words.filter(pa.array(new)).to_pylist()
            around = np.bincount(group * 2 * CLASSES + codes, counts, len(names) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            if names[0] == last:
                around[0] += sums
            elif last is not None:
                names.insert(0, last)
                around = np.concatenate([sums[None], around])
            last, sums = names[-1], around[-1]
            if len(names) > 1:
                yield out(names[:-1], around[:-1])
        if last is not None:
            yield out([last], sums[None])
    return neighbours(training, units, classes).repartition("word").sortWithinPartitions("word").mapInArrow(move, "word binary, n long, class int")


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), whole_text().alias("text"))
    training = texts.filter(~F.col("held_out"))
    counts = word_counts(training).filter("word != X''").orderBy(F.desc("n"), "word").limit(UNITS)
    units = {bytes(r.word): i for i, r in enumerate(counts.toLocalIterator(), 1)}
    pairs = unit_pairs(training, units)
    classes = exchange(pairs)
    member = np.eye(CLASSES)[classes]
    # the units' counts are the margins of their pairs; the end of a text is unit 0
    alone = [(w, int(pairs[:, i].sum()), int(classes[i])) for w, i in {END: 0, **units}.items() if pairs[:, i].any()]
    vocabulary = materialized(moved(training, units, classes, member.T @ pairs @ member).unionAll(
        spark.createDataFrame(alone, "word binary, n long, class int")))
    top = vocabulary.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    known = {w: i for i, w in enumerate(top.column(0).to_pylist())}
    n = top.column(1).to_numpy()
    # class, logarithms of the counts, and that the list has the word
    facts = np.column_stack([top.column(2).to_numpy(), np.log10(n + ADD_BASE), np.log10(n + ADD_WORD), np.ones(len(n))])
    types, mass = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in vocabulary.groupBy("class").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():
        types[row["class"]], mass[row["class"]] = row.words, row.n
    total, distinct = int(mass.sum()), int(types.sum())
    emission_total = np.log10(mass + ADD_WORD * (types + 1))
    base_total = log10(total + ADD_BASE * (distinct + 1)) if total else log10(ADD_BASE)
    model = spark.sparkContext.broadcast((known, facts, classes))  # of bounded size

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the bounded list decides of each text, the classes of its tokens as bytes, and its other words with their places."""
        known, facts, classes = model.value
        for batch in slices(batches):
            words, sizes = joined_tokens(batch.column(2))
            number = Numbers()
            code = number.codes(words)
            place = np.fromiter(map(known.get, number.names, repeat(-1)), np.int64, len(number))
            table = np.zeros((len(number), 4))
            table[place >= 0] = facts[place[place >= 0]]
            rest = np.flatnonzero(place < 0)  # a word that the list has not is in the class of its ending
            table[rest, 0] = classes[units_of([number.names[k] for k in rest.tolist()], {})]
            found, starts = table[code], np.cumsum([0, *sizes])
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.add.reduceat(found[:, 1:], starts[:-1])  # no text is without its end
            shut = np.where(found[:, 3] == 1, found[:, 0], OPEN).astype(np.uint8)
            held = [shut[a:b].tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist())]
            # the other words of each text, each once with all its places
            other = np.flatnonzero(found[:, 3] == 0)
            keys = row[other] * len(number) + code[other]
            order = np.argsort(keys, kind="stable")
            other, keys = other[order], keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            each, ends = code[other[first]], np.append(first, len(other))
            cuts = np.searchsorted(row[other[first]], np.arange(len(sizes) + 1))
            listed = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            parts = lambda values, at: [values[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]
            bag = [listed(pa.array([number.names[k] for k in each.tolist()], pa.binary())), listed(pa.array(np.diff(ends), pa.int32())),
                   pa.array(parts(table[each, 0].astype(np.uint8), cuts), pa.binary()),
                   pa.array(parts((other - starts[row[other]]).astype(np.int32), ends[cuts]), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(sums[:, 2].astype(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                 pa.array(held, pa.binary()), *bag], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "emitted", "classes", "words", "times", "unseen", "at"])

    partial = materialized(texts.mapInArrow(
        part, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emitted double, classes binary, "
        "words array<binary>, times array<int>, unseen binary, at binary").withColumn("row", F.monotonically_increasing_id()))
    # a word's places stay with its text; only its number there is shuffled
    bagged = partial.select("row", "times", F.posexplode("words").alias("pos", "word")).select("row", "pos", "word", F.get("times", "pos").alias("times"))
    counted = bagged.join(vocabulary, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    rest = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + ADD_BASE)).alias("more_base"),
        F.sum(F.col("times") * F.log10(F.col("c") + ADD_WORD)).alias("more_emitted"),
        F.collect_list(F.col("pos").cast("long") * 256 + F.col("class")).alias("open"))  # of one text's words, without those that have no class

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The classes of all tokens of each text."""
        held, unseen, at = (batch.column(i).to_pylist() for i in (5, 6, 7))
        cuts, firsts = (np.cumsum([0, *map(len, x)]) for x in (held, unseen))
        every, of = (np.frombuffer(b"".join(x), np.uint8).copy() for x in (held, unseen))
        # words not seen in training keep the class of their ending
        numbers, own = np.divmod(batch.column(9).flatten().to_numpy(), 256)
        of[np.repeat(firsts[:-1], pc.fill_null(batch.column(9).value_lengths(), 0).to_numpy()) + numbers] = own
        times = batch.column(8).flatten().to_numpy()
        start = np.repeat(cuts[:-1], np.diff(firsts))
        every[np.repeat(start, times) + np.frombuffer(b"".join(at), np.int32)] = np.repeat(of, times)
        closed = pa.array([every[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], closed], names=["doc_id", "held_out", "n_tokens", "n_known", "sums", "classes"])

    zero = F.lit(0.0)
    whole = partial.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.struct((F.col("base") + F.coalesce("more_base", zero)).alias("base"), (F.col("emitted") + F.coalesce("more_emitted", zero)).alias("emitted")).alias("sums"),
        "classes", "unseen", "at", "times", "open")
    closed = materialized(over_batches(
        whole, close, "doc_id long, held_out boolean, n_tokens long, n_known long, sums struct<base: double, emitted: double>, classes binary"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often a class follows another; a text ends with the class that stands before the next one."""
        seen = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in slices(batches):
            every = np.frombuffer(b"\0" + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            seen += np.bincount(every[:-1] * CLASSES + every[1:], minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["pair", "n"])

    table = np.zeros(CLASSES * CLASSES)
    for row in closed.filter(~F.col("held_out")).select("classes").mapInArrow(follow, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[row.pair] = row.n
    table = table.reshape(CLASSES, CLASSES)
    transition = np.log10((table + ADD_CLASS) / (table.sum(1, keepdims=True) + ADD_CLASS * CLASSES)) - emission_total

    def chained(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = batch.column(5).to_pylist()
        every = np.frombuffer(b"\0" + b"".join(held), np.uint8)
        sums = np.add.reduceat(transition[every[:-1], every[1:]], np.cumsum([0, *map(len, held[:-1])]))
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "sums", "chain"])

    scored = over_batches(
        closed, chained, "doc_id long, held_out boolean, n_tokens long, n_known long, sums struct<base: double, emitted: double>, chain double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums.base") - F.col("n_tokens") * F.lit(base_total)).alias("base_score"), (F.col("sums.emitted") + F.col("chain")).alias("score"))
