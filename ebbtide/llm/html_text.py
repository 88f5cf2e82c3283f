"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: tags, and whole strings of text. A token's role is the path of the
containers around it. Over the pages of a host, tokens with the same occurrence vector (how often they
occur in each page) form an equivalence class. A vector is kept as its support and a sum of hashes of
(page, count), which tasks add up in any order; equal sums are equal vectors. A class can be valid if it
has an opening and a closing tag that occur in at least half of the host's pages
and ``LEAST`` of them; copies of a page count once.

Classes are then held against every page. A class must be ordered: its members come one after the other, in
one order, as often as it occurs. Members whose place in that order is not the same everywhere are taken out, and the
others are a smaller class. Classes must be nested: none begins within another and ends outside of it (the
one of less support, or fewer members, goes), and each lies between the same two members of the class around it. What is left is a
tree, the template. Its slots, between two members, tell tokens of one path apart: a token's role takes in its slot,
and classes are found and checked anew until a round finds no more members.

Strings in a valid class are fixed text. What a page has besides is data, in its slots. A container of the template is
filled if any page of the host has data in it. Fixed text in a container that is not filled is no main text; in one that is,
within an article, it goes with the data (a heading, a label); outside of an article only as a heading right before data.

A slot whose path leads through navigation, header, footer, aside, form or a container named like one
(by tag, id, class or role) is no main text. Names of ``html`` and ``body`` tell of the whole page and
are not read; a header within the article is its own. Where fixed text that would go
makes more than half of the text that an article has left, pages repeat the article and not a template,
so it stays. The main text is that of all slots left, or of those below ``article`` or ``main`` where
the page has one.

Character references are decoded; white space inside a block becomes one space; blocks are joined by
line feeds in page order. A null or empty page has the empty text. A null url is a host of its own; null
or repeated page_id are rows like others. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.shared import over_batches, slices, whole_text
from ebbtide.runtime import materialized

LEAST = 3
ODD = 0x9E3779B97F4A7C15
# Element kinds of HTML, and words that name page furniture in ids, classes and roles.
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html head body nav header footer aside article main section div form table ul ol menu dialog fieldset dl td details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE = frozenset("head nav aside footer form menu dialog fieldset".split())
WHOLE = frozenset("html body article main".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disclaimer|disqus|footer|"
    r"login|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo|related|replies|"
    r"respond|share|sharing|sidebar|signup|skip|social|sponsor(?:ed)?|subscribe|toolbar|widgets?)(?:$|[\s_-])", re.I)
RAW = "script|style|noscript|template|iframe|svg|canvas|textarea|select|button|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
HEADER = re.compile(r"(?:^|[\s_-])(header|masthead)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"\b(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """kind ("open", "close", "text"), tag or decoded string, and attributes, in page order."""
    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at:
            yield "text", references.unescape(page[at:match.start()]), ""
        at = match.end()
        if match[3]:
            yield "close" if match[2] else "open", match[3].lower(), match[4]
        elif match[1]:
            yield "raw", match[1].lower(), ""
    if at < len(page):
        yield "text", references.unescape(page[at:]), ""


def named(tag: str, attributes: str) -> str:
    """A container's step in a path: its tag, and id, class and role where it has them."""
    found = " ".join(next(filter(None, m[1:]), "") for m in ATTRIBUTE.findall(attributes))
    return f"{tag}[{' '.join(found.split())}]" if found.strip() else tag


def walked(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """Events of a page: "open" or "close" with the path and step of a container; "break" between blocks, with
    the tag of a heading that begins; "text" with its path and string. Unclosed containers end with their parent."""
    path: list[str] = []
    tags: list[str] = []
    for kind, value, attributes in tokens(page):
        if kind == "text":
            yield "text", tuple(path), value
            continue
        if kind == "raw":
            yield "text", tuple(path), " "
            continue
        if value in BLOCKS:
            yield "break", (), value if kind == "open" and value in HEADINGS else ""
        elif value == "br":
            yield "text", tuple(path), " "
        if value not in CONTAINERS:
            continue
        if kind == "open":
            step = named(value, attributes)
            yield "open", tuple(path), step
            tags.append(value)
            path.append(step)
        elif value in tags:
            while tags:
                tag, step = tags.pop(), path.pop()
                if tag == value:
                    yield "close", tuple(path), step
                    break


def furniture(path: tuple[str, ...]) -> bool:
    """Whether a path leads through page furniture. A header within the article is its own."""
    article = False
    for step in path:
        tag, _, names = step.partition("[")
        names = names.rstrip("]")
        if tag in WHOLE:
            article = article or tag in ("article", "main")
        elif tag in FURNITURE or NAMED.search(names) or not article and (tag == "header" or HEADER.search(names)):
            return True
    return False


def inside_article(path: tuple[str, ...]) -> bool:
    return any(step.partition("[")[0] in ("article", "main") for step in path)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def digest(*parts: str) -> int:
    """A signed 64-bit hash."""
    value = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


OPEN, CLOSE, TEXT = range(3)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64).view(np.int64)


def sequence(events: list[tuple[str, tuple[str, ...], str]]) -> tuple[list[int], np.ndarray, list[int]]:
    """Kind and role of each token of a page, and its innermost container: the place of the opening tag among the tokens, or -1."""
    kinds, roles, parents, openers = [], [], [], []
    for kind, path, value in events:
        depth = len(path)
        if kind == "open":
            del openers[depth:]
            parents.append(openers[-1] if depth else -1)
            openers.append(len(kinds))
            kinds.append(OPEN)
        elif kind == "close":
            parents.append(openers[depth])
            kinds.append(CLOSE)
        elif kind == "text" and (value := squeezed(value)):
            parents.append(openers[depth - 1] if depth else -1)
            kinds.append(TEXT)
        else:
            continue
        roles.append(digest(kind, "/".join(path), value))
    return kinds, np.array(roles, np.int64), parents


class Member(NamedTuple):
    """A token's place in its class, and the slot behind it."""
    rank: int
    last: bool
    slot: int


def slots(roles: list[int], kinds: list[int], parents: list[int], valid: dict[int, Member]) -> list[int]:
    """The slot that each token lies in; members of a class lie in that of their class, closing tags in that of their container."""
    found, around, slot = [], [], 0
    for i, role in enumerate(roles):
        member = valid.get(role)
        if member is None:
            found.append(found[parents[i]] if kinds[i] == CLOSE else slot)
            continue
        if member.rank == 0:
            around.append(slot)
        found.append(around[-1] if around else 0)
        slot = member.slot
        if member.last:
            slot = around.pop() if around else 0
    return found


def refined(roles: np.ndarray, kinds: list[int], parents: list[int], templates: list[dict[int, Member]]) -> np.ndarray:
    """Roles that take in the slots of one template after the other."""
    for valid in templates:
        where = np.array(slots(roles.tolist(), kinds, parents, valid), np.int64)
        roles = (roles ^ (roles >> 29)) * MIX[0] + where * MIX[1]
    return roles


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#:]+)", 1)), F.lit(""))


def sequences(rows: DataFrame) -> DataFrame:
    """host, page (a hash), kinds, roles, parents (binary) of every different page."""
    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sequence(list(walked(page))) for page in batch.column(1).to_pylist()]
        columns = [pa.array(c, pa.binary()) for c in zip(*[(bytes(k), r.tobytes(), np.array(p, np.int32).tobytes()) for k, r, p in found])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["host", "page", "kinds", "roles", "parents"])

    seen = rows.select("host", "html", F.xxhash64("html").alias("page"))
    return over_batches(seen, walk, "host string, page long, kinds binary, roles binary, parents binary").dropDuplicates(["host", "page"])


def chain_of(lists: pa.ListScalar) -> list[dict[int, Member]]:
    """The templates of a host, as ``packed`` has them."""
    return [{t: Member(r, bool(e), s) for t, r, e, s in np.array(flat or [], np.int64).reshape(-1, 4).tolist()} for flat in lists.as_py() or []]


def over_pages(pages: DataFrame, chain: DataFrame | None, extra: DataFrame | None, visit: Callable, merge: Callable, schema: str) -> DataFrame:
    """Rows (host, *key, *values) that ``visit`` makes of each page, given what is known of its host; those of one key are merged in a task."""
    names = [f.split()[0] for f in schema.split(", ")]
    if chain is None:
        chain = pages.sparkSession.createDataFrame([], "host string, chain array<array<bigint>>")
    rows = pages.join(chain, "host", "left")
    rows = rows.withColumn("extra", F.lit(None).cast("array<bigint>")) if extra is None else rows.join(extra, "host")
    rows = rows.select("host", "page", "kinds", "roles", "parents", "chain", "extra")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple] = {}
        hosts: dict[str, tuple] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*k, *v) for k, v in sums.items()])], names=names)
        for batch in slices(batches):
            host_of_row, pages_of_row = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (host, page) in enumerate(zip(host_of_row, pages_of_row)):
                if host not in hosts:
                    if len(hosts) >= 256:
                        hosts.clear()
                    hosts[host] = chain_of(batch.column(5)[i]), np.array(batch.column(6)[i].as_py() or [], np.int64).reshape(-1, 4).tolist()
                known, facts = hosts[host]
                kinds, parents = list(batch.column(2)[i].as_py()), np.frombuffer(batch.column(4)[i].as_py(), np.int32).tolist()
                roles = np.frombuffer(batch.column(3)[i].as_py(), np.int64)
                for key, value in visit(page, kinds, roles, parents, known, facts):
                    key = (host, *key)
                    sums[key] = merge(sums[key], value) if key in sums else value
            if len(sums) > 100_000:
                yield out()
                sums.clear()
        if sums:
            yield out()
    return rows.mapInArrow(gather, schema)


def signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def vectors(pages: DataFrame, chain: DataFrame | None) -> DataFrame:
    """host, kind, token, support, vector: every token of a host, as a hash, with its occurrence vector."""
    def visit(page, kinds, roles, parents, known, facts):
        tokens, first, counts = np.unique(refined(roles, kinds, parents, known), return_index=True, return_counts=True)
        hashes = {n: digest(str(page), str(n)) for n in set(counts.tolist())}
        return [((kinds[i], t), (1, hashes[n])) for t, i, n in zip(tokens.tolist(), first.tolist(), counts.tolist())]

    parts = over_pages(
        pages, chain, None, visit, lambda a, b: (a[0] + b[0], signed(a[1] + b[1])), "host string, kind long, token long, support long, vector long")
    # tasks' sums are added modulo 2 ** 64: the halves are summed apart, so that no sum can overflow
    low, high = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("vector", 32)
    return parts.groupBy("host", "kind", "token").agg(
        F.sum("support").alias("support"), F.xxhash64(
            F.sum(low) % (1 << 32), F.pmod(F.sum(high) + F.shiftright(F.sum(low), 32), F.lit(1 << 32))).alias("vector"))


def valid_sizes(members: DataFrame) -> DataFrame:
    """Members of the classes that have several, an opening and a closing tag among them, with the class's ``size``."""
    classes = members.groupBy("host", "vector").agg(
        F.count("*").alias("size"), F.max((F.col("kind") == OPEN).cast("int")).alias("opens"), F.max((F.col("kind") == CLOSE).cast("int")).alias("closes"))
    return members.drop("size").join(classes.filter("size > 1 AND opens = 1 AND closes = 1").select("host", "vector", "size"), ["host", "vector"])


def facts_of(members: DataFrame, *columns: str) -> DataFrame:
    """host, extra: four numbers for each member. Bounded by half the host's pages: at most twice the tokens of an average page."""
    return members.groupBy("host").agg(F.flatten(F.collect_list(F.array(*[F.col(c).cast("long") for c in columns]))).alias("extra"))


def ordered(pages: DataFrame, chain: DataFrame | None, members: DataFrame) -> DataFrame:
    """Members with their ``rank``, of the classes or parts of classes that are in one order on all pages."""
    def visit(page, kinds, roles, parents, known, facts):
        class_of = {t: (c, n) for t, c, n, _ in facts}
        seen, ranks = Counter(), {}
        for role in refined(roles, kinds, parents, known).tolist():
            if role in class_of:
                c, n = class_of[role]
                rank = seen[c] % n
                seen[c] += 1
                low, high = ranks.get(role, (rank, rank))
                ranks[role] = min(low, rank), max(high, rank)
        return [((token,), found) for token, found in ranks.items()]

    parts = over_pages(
        pages, chain, facts_of(members, "token", "vector", "size", "support"), visit, lambda a, b: (min(a[0], b[0]), max(a[1], b[1])),
        "host string, token long, low long, high long")
    kept = parts.groupBy("host", "token").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low = high")
    held = valid_sizes(members.join(kept.select("host", "token", "low"), ["host", "token"]))
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("host", "vector").orderBy("low")) - 1).drop("low")


def nested(pages: DataFrame, chain: DataFrame | None, members: DataFrame) -> DataFrame:
    """Members of the classes that make a tree: no two overlap in part, and each lies in one slot."""
    def visit(page, kinds, roles, parents, known, facts):
        of = {t: (c, rank, *divmod(both, 1 << 20)) for t, c, rank, both in facts}
        around: list[tuple[tuple[int, int, int], list[int]]] = []  # support, size and class; rank so far
        found: dict[int, tuple] = {}

        def note(c: int, low: int, high: int, bad: int) -> None:
            a = found.get(c, (low, high, bad))
            found[c] = min(a[0], low), max(a[1], high), max(a[2], bad)

        for role in refined(roles, kinds, parents, known).tolist():
            if role not in of:
                continue
            c, rank, support, size = of[role]
            me = support, size, c
            if rank == 0:
                slot = signed(around[-1][0][2] + (around[-1][1][0] + 1) * ODD) if around else 0
                note(c, slot, slot, 0)
                around.append((me, [0]))
            elif any(other == me for other, _ in around):
                while around[-1][0] != me:
                    weaker = min(me, around.pop()[0])[2]  # the other began within this class and is not over yet
                    note(weaker, *found[weaker][:2], 1)
                around[-1][1][0] = rank
                if rank == size - 1:
                    around.pop()
        return [((c,), v) for c, v in found.items()]

    while True:
        both = F.col("support") * (1 << 20) + F.col("size")
        parts = over_pages(
            pages, chain, facts_of(members.withColumn("both", both), "token", "vector", "rank", "both"), visit,
            lambda a, b: (min(a[0], b[0]), max(a[1], b[1]), max(a[2], b[2])), "host string, vector long, low long, high long, bad long")
        whole = parts.groupBy("host", "vector").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad"))
        # a class that overlaps another can make that one seem to lie in several slots, so it goes first
        judged = whole.withColumn("overlaps", F.max("bad").over(Window.partitionBy("host")))
        gone = materialized(judged.filter("bad = 1 OR overlaps = 0 AND low != high").select("host", "vector"))
        if gone.isEmpty():
            return members
        members = materialized(members.join(gone, ["host", "vector"], "left_anti"))


def packed(members: DataFrame) -> DataFrame:
    """host, one: token, rank, whether it is the last, and the slot behind it, of each member."""
    slot = F.xxhash64("vector", "rank")
    four = F.array("token", F.col("rank").cast("long"), (F.col("rank") == F.col("size") - 1).cast("long"), slot)
    return members.groupBy("host").agg(F.flatten(F.collect_list(four)).alias("one"))


def templates(pages: DataFrame) -> DataFrame:
    """host, chain: the template of every round, the last one being the host's template."""
    counts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    chain, size = None, 0
    while True:
        frequent = vectors(pages, chain).join(counts, "host").filter((F.col("support") >= LEAST) & (2 * F.col("support") >= F.col("pages")))
        members = materialized(valid_sizes(frequent.select("host", "kind", "token", "support", "vector")))
        members = nested(pages, chain, materialized(ordered(pages, chain, members)))
        found = members.count()
        if found <= size:
            break
        one = packed(members)
        if chain is None:
            chain = materialized(one.select("host", F.array("one").alias("chain")))
        else:
            before = chain.join(one, "host", "full")
            chain = materialized(before.select("host", F.concat(
                F.coalesce("chain", F.array_repeat(F.array().cast("array<bigint>"), rounds)), F.array(F.coalesce("one", F.array().cast("array<bigint>")))).alias("chain")))
        rounds, size = 1 if not size else rounds + 1, found
    return pages.sparkSession.createDataFrame([], "host string, chain array<array<bigint>>") if chain is None else chain


def containers(pages: DataFrame, chain: DataFrame) -> DataFrame:
    """host, filled: the template's containers, by their opening tags, in which any page has data."""
    def visit(page, kinds, roles, parents, known, facts):
        if not known:
            return []
        roles, valid, marked = refined(roles, kinds, parents, known[:-1]).tolist(), known[-1], set()
        for i, kind in enumerate(kinds):
            if kind == TEXT and roles[i] not in valid:
                at = parents[i]
                while at >= 0 and at not in marked:
                    marked.add(at)
                    at = parents[at]
        return [((roles[i],), ()) for i in marked if roles[i] in valid]

    return over_pages(pages, chain, None, visit, lambda a, b: a, "host string, token long").groupBy("host").agg(F.collect_set("token").alias("filled"))


def fixed_text(events: list, known: list[dict[int, Member]], filled: set[int]) -> set[int]:
    """Which text tokens of a page, counted among its text tokens, are the template's and not the article's."""
    kinds, roles, parents = sequence(events)
    roles, valid = refined(roles, kinds, parents, known[:-1]).tolist(), known[-1]
    texts = [i for i, kind in enumerate(kinds) if kind == TEXT]
    heads, article, heading = [], [], False
    for kind, path, value in events:
        if kind == "break":
            heading = bool(value)
        elif kind == "text" and squeezed(value):
            heads.append(heading)
            article.append(inside_article(path))
    dropped = set()
    for n, i in enumerate(texts):
        if roles[i] in valid:
            at = parents[i]
            label = article[n] or heads[n] and n + 1 < len(texts) and roles[texts[n + 1]] not in valid
            if not label or at >= 0 and roles[at] in valid and roles[at] not in filled:
                dropped.add(n)
    return dropped


def main_text(page: str, known: list[dict[int, Member]] = (), filled: set[int] = frozenset()) -> str:
    """The text of a page's article, given the templates of its host and the containers that hold data."""
    events = list(walked(page))
    paths = dict.fromkeys(p for kind, p, _ in events if kind == "text")
    article = any(map(inside_article, paths))
    chosen = {p for p in paths if not furniture(p) and (inside_article(p) or not article)}
    fixed = fixed_text(events, known, filled) if known else set()
    texts = [(p, squeezed(v)) for kind, p, v in events if kind == "text"]
    if fixed and article:
        sizes = [(len(v), n in fixed) for n, (p, v) in enumerate(x for x in texts if x[1]) if p in chosen]
        if 2 * sum(n for n, gone in sizes if gone) > sum(n for n, _ in sizes):
            fixed = set()
    blocks, block, number = [], [], -1
    for kind, path, value in events:
        if kind == "break":
            blocks.append(block)
            block = []
        elif kind == "text":
            full = bool(squeezed(value))
            number += full
            if path in chosen and not (full and number in fixed):
                block.append(value)
    blocks.append(block)
    return "\n".join(filter(None, (squeezed("".join(b)) for b in blocks)))


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole_text("html").alias("html")).withColumn("host", host_of(F.col("url")))
    # copies of a page tell nothing about a template
    different = materialized(sequences(rows))
    chain = templates(different)
    known = materialized(chain.join(containers(different, chain), "host", "left"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, tuple] = {}
        for batch in slices(batches):
            texts = []
            for i, (host, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host not in hosts:
                    if len(hosts) >= 256:
                        hosts.clear()
                    hosts[host] = chain_of(batch.column(4)[i]), set(batch.column(5)[i].as_py() or ())
                texts.append(main_text(page, *hosts[host]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.join(known, "host", "left").select("page_id", "url", "host", "html", "chain", "filled").mapInArrow(
        extract, "page_id long, url string, text string")
