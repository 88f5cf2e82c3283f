"""Quality rules whose limits follow the data: quantile sketches per language and source.

A sketch is a table of counts over coarse values: a value keeps its seven leading bits, which bounds
the relative error of a quantile by 1/64. Two sketches merge by adding counts, in any order, with
the same result; so the limits do not depend on how the rows are partitioned, and a hot source is
summed map-side like any count.

The sketches take the rows that pass the base rules, so that junk of that kind moves no limit; those of
repetition take values above zero, as most texts repeat nothing. A measure passes up to
``q75 + max(REACH * (q75 - q50), LEAST)`` of its group, word length also down to the mirror image below
``q25``. Median and quartile stay in place while less than a quarter of the values are junk. ``LEAST`` is what
a difference must come to where the quartiles coincide. A group of fewer than ``min_group`` values takes the
limit from the merged sketch of its language, and if that is small too, from the one of all rows; without any
value, everything passes.

Null text has no words. Null language or source is a group like another. A null or repeated
``doc_id`` is judged row by row. Empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ebbtide.llm.shared import SPACES, over_batches, whole_text
from ebbtide.runtime import materialized

SYMBOLS = "#*$%&|<>"
#: Units of the distance between median and quartile from the quartile to the limit.
REACH = 8
#: Least distance, in thousandths, between a quartile and the limit.
LEAST = {"symbols": 100, "duplicate_lines": 100, "repeated_words": 350, "word_length": 500}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    code = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    size = len(numbers)
    if size < 1 << 21:
        window = (code[:-2] * size + code[1:-1]) * size + code[2:]
    else:  # three numbers no longer fit into 64 bits: number the pairs first
        pair = np.unique(code[:-1] * size + code[1:], return_inverse=True)[1]
        window = pair[:-1] * size + code[2:]
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    place = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
    hit = twice[place] == window
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= hit
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, ...]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines),
    )


def measured(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the counts of every whole text, and the columns to carry along."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [text_counts(x.as_py()) for x in batch.column(3)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, *batch.columns[4:]], names=["doc_id", "lang", "source", *COUNTS, *carry])
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), whole_text(), *carry)
    more = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry]
    return over_batches(narrow, count, "doc_id long, lang string, source string, " + ", ".join([*(f"{c} long" for c in COUNTS), *more]))


def _thousandths(count: str, of: str) -> Column:
    return F.expr(f"1000 * {count} div greatest({of}, 1)")


MEASURES = {
    "symbols": ("n_symbols", "n_words"), "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
}
ABOVE_ZERO = ("duplicate_lines", "repeated_words")
LIMITS = (*(f"limit_{m}" for m in MEASURES), "least_word_length")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def coarse(value: Column) -> Column:
    """A whole number with its seven leading bits kept and the rest set to zero."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """level, lang, source, measure, value, n: mergeable counts of coarse values, at three levels.

    Level 0 is a source within a language, 1 a language, 2 all rows; each merges the one below.
    """
    entries = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), coarse(_thousandths(*of)).alias("value")) for name, of in MEASURES.items()
    ]))
    fine = (
        counts.filter(~base_failed()).select("lang", "source", entries.alias("e"))
        .filter((F.col("e.value") > 0) | ~F.col("e.measure").isin(*ABOVE_ZERO)).groupBy("lang", "source", "e.measure", "e.value")
        .agg(F.count("*").alias("n")).withColumn("level", F.lit(0))
    )
    none = F.lit(None).cast("string")
    language = fine.groupBy("lang", "measure", "value").agg(F.sum("n").alias("n")).withColumns({"level": F.lit(1), "source": none})
    everything = language.groupBy("measure", "value").agg(F.sum("n").alias("n")).withColumns({"level": F.lit(2), "lang": none, "source": none})
    return fine.unionByName(language).unionByName(everything)


def limits(sketch: DataFrame, min_group: int, least: dict[str, int] = LEAST) -> DataFrame:
    """level, lang, source and the limits in thousandths, from the sketches; null where a sketch is small."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("rows", F.sum("n").over(group))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("rows"), F.col("value")))
    reach = lambda distance: F.greatest(REACH * distance, F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("measure")].cast("long"))
    per_measure = ranked.groupBy("level", "lang", "source", "measure").agg(
        F.max("rows").alias("n"), quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"),
    ).filter((F.col("n") >= min_group) | (F.col("level") == 2)).withColumns({
        "most": F.col("q3") + reach(F.col("q3") - F.col("q2")), "fewest": F.col("q1") - reach(F.col("q2") - F.col("q1"))})
    of = lambda m, bound: F.max(F.when(F.col("measure") == m, F.col(bound)))
    return per_measure.groupBy("level", "lang", "source").agg(
        *[of(m, "most").alias(f"limit_{m}") for m in MEASURES], of("word_length", "fewest").alias("least_word_length"))


def quality(docs: DataFrame, min_group: int = 100, least: dict[str, int] = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: counts, the columns to carry along, the limits that applied, base_failed and kept."""
    counts = materialized(measured(docs, carry))
    table = materialized(limits(sketches(counts), min_group, least))

    def level(number: int, *keys: str) -> DataFrame:
        return table.filter(F.col("level") == number).select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*LIMITS).alias(f"level{number}"))

    # the three levels meet per group, so that the rows are joined once
    groups = counts.select("lang", "source").distinct()
    same = lambda k: F.col(k).eqNullSafe(F.col(f"_{k}"))
    everything = level(2).scalar()
    chosen = (
        groups.join(level(0, "lang", "source"), same("lang") & same("source"), "left").drop("_lang", "_source")
        .join(level(1, "lang"), same("lang"), "left")
        .select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                *[F.coalesce(f"level0.{x}", f"level1.{x}", everything[x]).alias(x) for x in LIMITS])
    )
    judged = counts.join(chosen, same("lang") & same("source"), "left").select("doc_id", "lang", "source", *COUNTS, *carry, *LIMITS)
    no_limit = F.lit(True)
    passes = F.coalesce(_thousandths(*MEASURES["word_length"]) >= F.col("least_word_length"), no_limit)
    for m, of in MEASURES.items():
        passes = passes & F.coalesce(_thousandths(*of) <= F.col(f"limit_{m}"), no_limit)
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & passes)
