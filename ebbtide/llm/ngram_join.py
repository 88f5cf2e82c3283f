"""N-gram Jaccard join with adaptive multi-match prefixes, and the components its links make.

A document's set holds the hashes of its distinct word n-grams. In one global order of the n-grams,
two sets of similarity t or more that keep the first ``|x| - ceil(t |x|) + l`` of their n-grams share
at least l of those. Each document chooses its own l: a longer prefix costs index rows, and divides
the candidates to verify by l, as the frequencies of its n-grams estimate. A pair is verified if its
prefixes share as many n-grams as the smaller l of the two; that loses no pair.

The order puts the ``FREQUENT`` n-grams of highest frequency last, by frequency, and the others first,
by hash. Frequencies are gathered from every document; n-grams seen once in an input task are left
out of them, which changes the order, never the result.

Documents of equal sets are one class, joined through its smallest id. ``jaccard_links`` gives every
link. ``jaccard_components`` wants links for the components they make alone, so there pairs already connected are not verified again: rounds of stars first join
documents to one pivot per shared n-gram and size band, then all pairs that still lie in different
components are generated and verified. A group of g near copies costs g pairs, not g squared.

A pair is verified in two steps. A sketch per set, how many of its hashes fall to each of ``SKETCH`` parts, bounds
from above what two sets share; only the sets of pairs it leaves are shuffled, told from the
others by a bitmap of bounded size.

Null or wordless text has the empty set and links with nothing. Rows that share a ``doc_id`` are one
document, each of whose texts can link; a null id has no component. An empty table gives an empty
result. Other columns are not read. N-gram hashes have 64 bits, set signatures 128.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.shared import kept, over_batches, slices, whole_text
from ebbtide.runtime import materialized

WORDS, PERCENT = 4, 85
FREQUENT, STAR_ROUNDS, KEPT = 1 << 17, 3, 400_000
SKETCH, CELLS = 256, 1 << 24
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes() -> _Hashes:
    """One per worker, kept between tasks."""
    return kept("word hashes", _Hashes)


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text; fewer words than n are one n-gram."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    code = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    if len(code) < size:  # a length of its own, so that it differs from longer sequences
        code = np.concatenate([code, np.full(size - len(code), len(code), np.uint64)])
    mixed = np.zeros(len(code) - size + 1, np.uint64)
    for k in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(ODD[k % 4]) + code[k:len(code) - size + 1 + k] * np.uint64(ODD[(k + 1) % 4])
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(ODD[1])
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def needed(size: int, percent: int) -> int:
    """N-grams that a set of this size shares with any set it links to."""
    return -(-percent * size // 100)


def matched_prefix(found: np.ndarray, frequent: np.ndarray, frequency: np.ndarray, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of matches a document asks for, and its prefix of that many n-grams more, the
    frequent ones of it apart."""
    place = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
    common = frequent[place] == found if len(frequent) else np.zeros(len(found), bool)
    often, often_df = found[common], frequency[place[common]] if len(frequent) else np.empty(0, np.int64)
    by = np.argsort(often_df, kind="stable")
    ordered = np.concatenate([found[~common], often[by]])
    partners = np.concatenate([np.full(len(found) - len(often), 0.02), often_df[by] - 1.0])
    size, least = len(found), needed(len(found), percent)
    total = np.cumsum(partners)
    best, best_cost = 1, np.inf
    for matches in MATCHES:
        if matches > least:
            break
        length = size - least + matches
        cost = length + total[length - 1] * (1 + (1 + size / 256) / matches)
        if cost < best_cost:
            best, best_cost = matches, cost
    rare = size - len(often)
    return best, ordered[:min(rare, size - least + best)], ordered[rare:size - least + best]


def frequent_ngrams(docs: DataFrame, size: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams in most documents and their frequencies, sorted by n-gram: at most ``limit``."""
    def count(batches):
        parts, held = [], 0
        def merged():
            every = np.concatenate(parts)
            parts.clear()
            every.sort()  # in place, and only the starts of runs beside it
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            counts = np.diff(starts, append=len(every))
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(every[starts[often]]), pa.array(counts[often])], names=["ngram", "n"])
        for batch in slices(batches):
            for text in batch.column(0):
                parts.append(shingles(text.as_py(), size))
                held += len(parts[-1])
            if held > 4_000_000:
                yield merged()
                held = 0
        if held:
            yield merged()

    counts = docs.select(whole_text().alias("text")).mapInArrow(count, "ngram long, n long")
    top = counts.groupBy("ngram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ngram").limit(limit).toArrow()
    ngrams, frequency = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.argsort(ngrams)
    return ngrams[order], frequency[order]


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, signature, matches and the prefix (rare, often: binary) of every row."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_ngrams(docs, size, FREQUENT))  # 2 MB at most

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1):
            found = shingles(text.as_py(), size)
            matches, rare, often = matched_prefix(found, *frequent.value, percent) if len(found) else (0, found, found)
            rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), matches, rare.tobytes(), often.tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n", "signature", "matches", "rare", "often"])
    return over_batches(
        docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), describe,
        "doc_id long, n long, signature binary, matches int, rare binary, often binary")


def index_rows(classes: DataFrame, part: str) -> DataFrame:
    """ngram, doc, place: a row per n-gram of that part of each class's prefix, and its place there."""
    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = [np.frombuffer(p.as_py(), np.int64) for p in batch.column(1)]
        docs = np.repeat(batch.column(0).to_numpy(), [len(g) for g in grams])
        places = np.concatenate([k + np.arange(len(g)) for k, g in zip(batch.column(2).to_pylist(), grams)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(docs), pa.array(places)], names=["ngram", "doc", "place"])
    return over_batches(classes.select("doc", part, F.lit(0).cast("long") if part == "rare" else "rares"), explode, "ngram long, doc long, place long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``a``, ``b`` links.

    Alternating large and small stars: every round links each node's neighbours to the smallest, until
    nothing changes. A round is two aggregations and joins, whatever the degree of a node.
    """
    links = materialized(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = materialized(both.join(least, "u").filter("v > u AND v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        around = large.join(low, "u")
        links = materialized(
            around.select(F.col("v").alias("u"), F.col("low").alias("v")).unionAll(low.select("u", F.col("low").alias("v"))).filter("u > v").distinct())
        new = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
        if new == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = new


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is in column ``id`` of ``ids``, and others whose hash meets one of those; ``rows`` are not shuffled.

    The ids mark bits of a bitmap of ``CELLS`` bits, 2 MB, whatever their number.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS).cast("long"))
    marks = ids.select(cell("id").alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("_bits"))
    bit = F.bitmap_bit_position(cell(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_part", F.bitmap_bucket_number(cell(key))).join(F.broadcast(marks), "_part")
    return found.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def sketch(found: np.ndarray) -> bytes:
    """How many hashes of a set fall to each part; the highest number stands for more, too."""
    return np.minimum(np.bincount(found & (SKETCH - 1), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc, n, sketch (binary), found (binary): the sets of the wanted documents and maybe of others, from their texts."""
    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t.as_py(), size) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(map(sketch, found), pa.binary()),
             pa.array([f.tobytes() for f in found], pa.binary())], names=["doc", "n", "sketch", "found"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), whole_text().alias("text"))
    return over_batches(among(texts, "doc", wanted.select(F.col("doc").alias("id"))), build, "doc long, n long, sketch binary, found binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets are similar enough."""
    def bound(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, m = (batch.column(i).to_numpy() for i in (2, 4))
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (3, 5))
        least = np.minimum(x, y)
        most = least.sum(1, dtype=np.int64)
        keep = (100 * most >= percent * (n + m - most)) | (least == 255).any(1)
        return pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for one, other in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(one.as_py(), np.int64), np.frombuffer(other.as_py(), np.int64)
            if len(x) > len(y):
                x, y = y, x
            same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            keep.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
        return pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        one = sets.select(F.col("doc").alias("a"), *[F.col(c).alias(f"one_{c}") for c in columns])
        other = sets.select(F.col("doc").alias("b"), *[F.col(c).alias(f"other_{c}") for c in columns])
        return pairs.join(one, "a").join(other, "b").select("a", "b", *[f"{side}_{c}" for side in ("one", "other") for c in columns])

    near = materialized(over_batches(with_both(pairs, sets, "n", "sketch"), bound, "a long, b long").distinct())
    met = among(sets.select("doc", "found"), "doc", near.select(F.explode(F.array("a", "b")).alias("id")))
    return over_batches(with_both(near, met, "found"), verify, "a long, b long")


def prepared(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with their signatures, classes, index rows of the classes that can be in a pair, and their sets."""
    described = materialized(prefixes(docs, size, percent))
    shared = described.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "signature").agg(
        F.min("doc_id").alias("doc"), F.count("*").alias("rows"), F.min_by("matches", "doc_id").alias("matches"))
    classes = materialized(shared)
    # the class's row: one of those with its id and signature, whose prefixes are equal
    # with the length of the rare part, so that the part itself is shuffled once
    own = described.withColumn("rares", (F.octet_length("rare") / 8).cast("long"))
    own = own.join(classes.select(F.col("doc").alias("doc_id"), "signature"), ["doc_id", "signature"], "left_semi")
    own = own.select(F.col("doc_id").alias("doc"), "rare", "often", "rares")
    # n-grams of one document can make no pair. Those that a third of all rows may hold are frequent
    # ones, which are kept as they are, so the window sees small groups alone.
    met = index_rows(own, "rare").withColumn("docs", F.count("*").over(Window.partitionBy("ngram"))).filter("docs > 1").drop("docs")
    facts = classes.select("doc", "n", "matches")
    # linked sets lie in one band of sizes or in neighbouring ones; the margin is far above the rounding of logarithms
    band = F.floor(F.log(F.col("n").cast("double")) / (1e-9 - F.log(F.lit(percent / 100)))).cast("int").alias("band")
    met = materialized(met.unionAll(index_rows(own, "often")).join(facts, "doc").select("ngram", "doc", "place", "n", "matches", band))
    # n-grams that no other document of such a size has in its prefix can make no pair either
    held = met.groupBy("ngram", "band").agg(F.min("matches").alias("fewest"), F.count("*").alias("docs"))
    around = held.select("ngram", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "fewest", "docs")
    around = around.groupBy("ngram", "band").agg(F.min("fewest").alias("fewest"), F.sum("docs").alias("docs")).filter("docs > 1").drop("docs")
    met = materialized(met.join(around, ["ngram", "band"]).select(*met.columns, "fewest"))
    # a document whose shared n-grams are fewer than it and each of its partners ask for is in no pair
    able = met.groupBy("doc").agg(F.count("*").alias("shared"), F.min("fewest").alias("fewest"), F.first("matches").alias("m"))
    able = materialized(able.filter("shared >= least(fewest, m)").select("doc", "shared"))
    met = met.drop("fewest")
    # the fewer n-grams of its prefix a document has to itself, the better a pivot it is
    alone = (F.col("n") - F.ceil(F.col("n") * percent / 100) + F.col("matches") - F.col("shared")).alias("alone")
    # n-grams before this one in the document's order that no other prefix in question has; a window per document
    lone = (F.col("place") - F.row_number().over(Window.partitionBy("doc").orderBy("place")) + 1).alias("lone")
    postings = materialized(met.join(able, "doc").select(*met.columns, alone, lone))
    sets = materialized(sets_of(docs, able.select("doc"), size))

    return described, classes, postings, sets


def possible(percent: int, n: str, place: str, m: str, other_place: str, least: Column) -> Column:
    """The sizes allow a link, also without the n-grams before this one that are not shared, and the n-gram is among those where the first ``least``
    shared ones of a linked pair lie: the pair shares at least t / (1 + t) of the sum of its sizes."""
    share = F.expr(f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")
    # of the n-grams before this one, those shared are as many on both sides, and prefixes hold them
    before = F.expr(f"least({place} - lone, {other_place} - other_lone)")
    fits = (F.col(n) - F.col(place) + before >= share) & (F.col(m) - F.col(other_place) + before >= share)
    return fits & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.col(place) < F.col(n) - share + least) & (F.col(other_place) < F.col(m) - share + least)


def candidates(rows: DataFrame, percent: int, wanted: Column) -> DataFrame:
    """The pairs a < b of index rows that can link, of those ``wanted``."""
    asks = F.least("matches", "asked")
    other = rows.select("ngram", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("matches").alias("asked"), F.col("place").alias("other_place"), F.col("lone").alias("other_lone"), F.col("component").alias("other"))
    pairs = rows.join(other, "ngram").filter((F.col("doc") < F.col("b")) & wanted & possible(percent, "n", "place", "m", "other_place", asks))
    asked = pairs.groupBy(F.col("doc").alias("a"), "b", asks.alias("least")).count().filter(F.col("count") >= F.col("least"))
    return asked.select("a", "b")


def jaccard_links(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links, verified, as pairs a < b of classes; and one row per document: doc_id, n_shingles, class_id, n_links.

    A class is the smallest id of an equal set, its links those to other classes. A group of g near
    copies of different sets has up to g (g - 1) / 2 links, all of which are in the result.
    """
    described, classes, postings, sets = prepared(docs, size, percent)
    rows = materialized(postings.withColumn("component", F.col("doc")))
    links = materialized(linked(candidates(rows, percent, F.lit(True)).distinct(), sets, percent).distinct())
    counts = links.select(F.col("a").alias("_doc")).unionAll(links.select("b")).groupBy("_doc").agg(F.count("*").alias("_links"))
    named = materialized(classes.join(counts, classes["doc"] == counts["_doc"], "left").filter("rows > 1 OR _links > 0").select(
        "n", "signature", F.col("doc").alias("_class"), "_links"))
    members = described.join(named, ["n", "signature"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_class", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_links", F.lit(0).cast("long"))).alias("n_links"))
    return links, members


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id of an equal set), component_id."""
    described, classes, postings, sets = prepared(docs, size, percent)
    asks = F.least("matches", "asked")
    known = None  # node, component of every node linked so far

    def placed() -> DataFrame:
        if known is None:
            return postings.withColumn("component", F.col("doc"))
        names = known.withColumnsRenamed({"node": "doc", "component": "_component"})
        return postings.join(names, "doc", "left").withColumn("component", F.coalesce("_component", "doc")).drop("_component")

    def joined(links: DataFrame) -> DataFrame:
        if known is not None:
            links = links.unionAll(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return components(links)

    for turn in range(STAR_ROUNDS):
        rows = placed()
        rank = F.struct(F.col("alone"), F.xxhash64("doc", F.lit(turn)).alias("by")) if turn < 2 else F.xxhash64("doc", F.lit(turn))
        order = F.struct(rank.alias("rank"), "doc", "component", "n", "matches", "place", "lone")
        pivots = rows.groupBy("ngram", "band").agg(F.min(order).alias("p"), F.min("component").alias("low"), F.max("component").alias("high"))
        pivots = pivots.filter("low < high").select(
            "ngram", "band", F.col("p.doc").alias("b"), F.col("p.component").alias("other"), F.col("p.n").alias("m"),
            F.col("p.matches").alias("asked"), F.col("p.place").alias("other_place"), F.col("p.lone").alias("other_lone"))
        meet = rows.join(pivots, ["ngram", "band"]).filter((F.col("component") != F.col("other")) & possible(percent, "n", "place", "m", "other_place", asks))
        enough = F.count("*") >= F.min(asks)
        best = meet.groupBy(F.col("doc").alias("a"), "b").agg(F.count("*").alias("count"), enough.alias("enough")).filter("enough").groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
        links = materialized(linked(best, sets, percent))
        if links.isEmpty():
            break
        known = joined(links)

    rows = placed()
    mixed = rows.groupBy("ngram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("ngram")
    left = materialized(rows.join(mixed, "ngram"))
    links = materialized(linked(candidates(left, percent, F.col("component") != F.col("other")), sets, percent))
    if not links.isEmpty():
        known = joined(links)

    # copies and members meet their class by signature; only classes of several rows or with links need it
    named = classes.withColumn("component", F.col("doc"))
    if known is not None:
        names = known.withColumnsRenamed({"node": "doc", "component": "_component"})
        named = classes.join(names, "doc", "left").withColumn("component", F.coalesce("_component", "doc"))
    named = materialized(named.filter("rows > 1 OR component != doc").select("n", "signature", F.col("doc").alias("_class"), "component"))
    return described.join(named, ["n", "signature"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_class", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
