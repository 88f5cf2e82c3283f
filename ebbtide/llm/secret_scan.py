"""Secret scans with an incremental ledger of blobs, in DataFrame functions alone.

Every version of a text is addressed by its SHA-256. The ledger holds, per blob, the rule versions it
was scanned with and what they found. A run scans each blob once, however many paths hold it, and
only with the rule versions that the ledger lacks for it; then the findings of all current rules are
joined back to every path. Changing a rule's pattern means raising its version.

Spans count code points and end exclusively. Null text is the empty text and has no findings. Rows
with null or repeated ids are paths like others. An empty table gives an empty result. Only the named
columns are read; `redacted` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.shared import new_folder, unused, whole_text

SPAN = "array<struct<start: bigint, end: bigint, kind: string, rule: string>>"
LEDGER = f"blob string, scanned array<string>, findings {SPAN}"


@dataclass(frozen=True)
class Rule:
    """``least`` characters in ``group`` of a match; shorter matches are dropped after matching."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# The three base rules, then token formats that their issuers document.
# A run of 16 or more is the same match as a whole run, filtered by length; so is AKIA with 14 more.
RULES = (
    Rule("assign", 1, f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16,}"),
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
)


#: Elements of an array that are taken together, so that no accumulator is copied once per element of the whole.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas within use it."""
    return F.transform(F.array(value), body)[0]


def blocks(values: Column) -> Column:
    """The array cut into arrays of ``BLOCK`` elements."""
    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda i: F.slice(v, i, BLOCK))
    return let(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.slice(F.array(v), 1, 0)))


def before_each(values: Column, combine: Callable[[Column, Column], Column], start: int) -> Column:
    """For each whole number of an array, the numbers before it combined, from ``start``, which changes nothing."""
    start = F.lit(start).cast("bigint")
    begin = F.struct(start.alias("at"), F.lit([]).cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct(combine(acc.at, x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))
    within = lambda part: F.aggregate(part, begin, step, lambda acc: acc.out)
    whole = lambda parts: within(F.transform(parts, lambda part: F.aggregate(part, start, combine)))
    return let(blocks(values), lambda parts: F.flatten(F.zip_with(
        parts, whole(parts), lambda part, earlier: F.transform(within(part), lambda x: combine(earlier, x)))))


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text: leftmost, without overlap, the short ones left out.

    A match begins where the texts between the matches and the matches before it end.
    """
    pattern = F.lit(rule.pattern)
    whole, part = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (0, rule.group))
    between = F.split(text, rule.pattern, -1)  # the text after the last match comes last
    sizes = F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("size"), F.length(p).alias("part")))
    skips = let(sizes, lambda all_sizes: F.zip_with(F.slice(between, 1, F.size(all_sizes)), all_sizes, lambda b, w: F.struct(
        F.length(b).alias("skip"), w.size.alias("size"), w.part.alias("part"))))
    ends = lambda rows: before_each(F.transform(rows, lambda x: (x.skip + x.size).cast("bigint")), lambda a, b: a + b, 0)
    placed = let(skips, lambda rows: F.zip_with(rows, ends(rows), lambda x, at: F.struct(
        (at + x.skip).alias("start"), (at + x.skip + x.size).alias("end"), x.part.alias("part"))))
    found = F.transform(F.filter(placed, lambda x: x.part >= rule.least), lambda x: F.struct(
        x.start.alias("start"), x.end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule")))
    return F.when(text.rlike(rule.pattern), found.cast(SPAN)).otherwise(F.lit([]).cast(SPAN))


def paths_of(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob: the content address of every version."""
    return versions.select(F.col(path).alias("path"), F.sha2(whole_text(text), 256).alias("blob"))


def read_ledger(versions: DataFrame, ledger: str) -> DataFrame:
    """One row per blob: all rule versions it was scanned with and all findings."""
    rows = versions.sparkSession.read.schema(LEDGER).parquet(ledger)
    # a blob has a row per run that brought new rule versions
    return rows.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("scanned"), F.flatten(F.collect_list("findings")).alias("findings"))


def scan_into(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> None:
    """Scan the unseen pairs of blob and rule version, and append what they give to the ledger folder."""
    spark = versions.sparkSession
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.select(F.sha2(whole_text(text), 256).alias("blob"), whole_text(text).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = read_ledger(versions, ledger).select("blob", "scanned")
    missing = F.array_except(keys, F.coalesce("scanned", F.lit([]).cast("array<string>")))
    todo = blobs.join(seen, "blob", "left").select("blob", "text", missing.alias("missing")).filter(F.size("missing") > 0)
    found = [F.when(F.array_contains("missing", r.key), spans(F.col("text"), r)).otherwise(F.lit([]).cast(SPAN)) for r in rules]
    todo.select("blob", F.col("missing").alias("scanned"), F.concat(*found).alias("findings")).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob, findings of the current rules (by start, then in the order of the rules), for every path."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    current = F.filter("findings", lambda f: f.rule.isin([r.key for r in rules]))
    sortable = F.transform(current, lambda f: F.struct(f.start.alias("start"), order[f.rule].alias("place"), f.end.alias("end"), f.kind.alias("kind"), f.rule.alias("rule")))
    back = F.transform(F.sort_array(sortable), lambda f: F.struct(f.start.alias("start"), f.end.alias("end"), f.kind.alias("kind"), f.rule.alias("rule")))
    # blobs without findings need no row
    hits = read_ledger(versions, ledger).select("blob", back.alias("findings")).filter(F.size("findings") > 0)
    return paths_of(versions, path, text).join(hits, "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.lit([]).cast(SPAN)).alias("findings"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan with a ledger of its own and return the findings of every path."""
    ledger = new_folder(versions.sparkSession, "secrets")
    scan_into(versions, ledger, rules)
    return findings(versions, ledger, rules)


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of spans that overlap or touch, replaced. Spans come by start.

    A run begins where a span starts after all earlier ones have ended. Texts between runs are taken from
    the text that a block of runs covers, since a position in a text is found by reading up to it.
    """
    ends = F.transform(found, lambda f: f.end)
    after = before_each(ends, lambda a, b: F.greatest(a, b), -1)
    runs = F.filter(F.zip_with(found, after, lambda f, at: F.struct(at.alias("at"), f.start.alias("start"))), lambda r: r.start > r.at)
    runs = F.transform(runs, lambda r: F.struct(F.greatest(r.at, F.lit(0)).cast("int").alias("at"), r.start.cast("int").alias("start")))
    pieces = lambda part, covered: F.array_join(F.transform(part, lambda r: F.concat(
        F.substring(covered, r.at - part[0].at + 1, r.start - r.at), F.lit(mask))), "")
    covered = lambda part: F.substring(text, part[0].at + 1, F.element_at(part, -1).start - part[0].at)
    joined = F.array_join(F.transform(blocks(runs), lambda part: let(covered(part), lambda c: pieces(part, c))), "")
    return F.concat(joined, F.substring(text, F.coalesce(F.array_max(ends), F.lit(0)).cast("int") + 1, F.length(text)))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the secrets in ``text`` replaced; ``n_chars``, where it is a column, is
    counted anew there and keeps its type."""
    ledger = new_folder(docs.sparkSession, "secrets")
    scan_into(docs, ledger, rules)
    blob, found = unused("_blob", docs), unused("_found", docs)
    hits = read_ledger(docs, ledger).filter(F.size("findings") > 0).select(F.col("blob").alias(blob), F.array_sort("findings").alias(found))
    joined = docs.join(hits, F.sha2(whole_text(), 256) == F.col(blob), "left")
    hit = F.col(found).isNotNull()
    changed = joined.withColumn("text", F.when(hit, masked(F.col("text"), F.col(found), mask)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(hit, size).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
