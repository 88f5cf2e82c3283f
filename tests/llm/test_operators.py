"""Each operator against a brute-force version, with missing, empty, repeated and clashing input."""

import collections
import functools
import glob
import hashlib
import io
import itertools
import math
import re
import time
import types
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from ebbtide.llm import (
    class_lm, exact_dedup, html_text, ngram_join, packing, piece_sampling, quality_rules, secret_scan, shared, token_files, warc, word_encoding,
)
from ebbtide.llm.shared import new_folder, whole_text
from ebbtide.runtime import BATCH, CLEANUP, materialized

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rank string, component long, n int, row long, blob string"
BASE = " ".join(f"w{i}" for i in range(120))
LONG = " ".join(f"word{i % 997}" for i in range(30_000))


def rows():
    texts = [
        None, "", " ", "\n", "one", "one two", "ONE two", BASE, BASE, BASE.replace("w60 ", "x60 "), BASE.replace("w5 ", "y5 ").replace("w90 ", "y90 "),
        LONG, LONG, "a  b\t c\n\nd", "日本語 🙂 ▁x", "password = abcdefgh12345678 AKIA" + "Q" * 16 + " " + "0af" * 8, "secret: short", "<|endoftext|> hi",
        "same line\nsame line\nother # $ %", "one two three " * 60,
    ]
    return [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), 0, "r", 1, 1, 1, "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(None, BASE, None, None, 0, 0, "r", 1, 1, 1, "b"), rows()[4]]  # without an id, and a repeated row
    return spark.createDataFrame([*rows(), *extra], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(spark):
    """Every id once."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_piece_sampling_is_lossless_and_repeatable(docs, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    read = piece_sampling.decoded(piece_sampling.encoded(docs, model), model).collect()
    assert len(read) == docs.count() and all(r.decoded == r.text for r in read)
    again = {(r.key, r.text): r.ids for r in piece_sampling.encoded(docs.repartition(5), model).collect()}
    assert all(again[r.key, r.text] == r.ids for r in read)
    other = {(r.key, r.text): r.ids for r in piece_sampling.encoded(docs, model, seed=1).collect()}
    assert any(other[r.key, r.text] != r.ids for r in read)
    assert piece_sampling.encoded(none, model).count() == 0


def test_piece_sampling_has_the_lattice_distribution():
    use = piece_sampling.sampler(public_tokenizers.path("piece_bpe_32k.model"), 1.0)

    def paths(text):
        if not text:
            yield 1.0, b""
        for k in range(1, len(text) + 1):
            if text[:k] in use.pieces:
                weight, ids = use.pieces[text[:k]]
                for w, rest in paths(text[k:]):
                    yield weight * w, ids + rest

    exact = list(paths(" then"))
    total, draws = sum(w for w, _ in exact), 40_000
    ids, counts = use.draw([" then"], np.zeros(draws, np.int64), np.random.default_rng(0).random(draws))
    ends = np.concatenate([[0], np.cumsum(counts)])
    seen = collections.Counter(use.spelled(ids[a:b]) for a, b in zip(ends, ends[1:]))
    assert max(abs(seen[i] / draws - w / total) for w, i in exact) < 0.01


def test_piece_sampling_does_not_depend_on_the_batch():
    use = piece_sampling.sampler(public_tokenizers.path("piece_bpe_32k.model"), 0.0)
    generator = np.random.default_rng(5)
    long = ["".join(generator.choice(["the", "in", "er", "an", "st", "on", "ing", "ate"], 25))[:62] for _ in range(60)]
    others = [" ".join("".join(generator.choice(list("etaoinshrdlu"), 12)) for _ in range(200)) for _ in range(60)]
    alone = [use.encode([t], [k])[0] for k, t in enumerate(long)]
    assert use.encode([*others, *long], [*range(1000, 1060), *range(60)])[60:] == alone
    assert all(use.decode(i) == t for i, t in zip(alone, long))


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join_matches_all_pairs(spark, plain, docs, none):
    generator = np.random.default_rng(3)
    texts = {r[0]: r[1] for r in rows()}
    for i in range(100, 220):  # a group of near copies with up to twelve edits, and small sets
        words = BASE.split() if i % 2 else [f"v{k % 7}" for k in range(int(generator.integers(1, 30)))]
        for at in generator.integers(0, len(words), int(generator.integers(0, 5))):
            words[at] = f"e{generator.integers(0, 50)}"
        texts[i] = " ".join(words)
    got = by_id(ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts)
    with_null = ngram_join.jaccard_components(docs).collect()
    assert len(with_null) == docs.count() and [r.component_id for r in with_null if r.doc_id is None] == [None]
    assert ngram_join.jaccard_components(none).count() == 0


def test_ngram_sets_are_of_documents_with_partners_of_their_size(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    texts = [long, BASE, BASE.replace("w60 ", "x60 "), *[" ".join(f"v{i}" for i in range(k * 60, k * 60 + 60)) for k in range(20)]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = ngram_join.prepared(table, 4, 85)[3]
    assert {r.doc for r in sets.collect()} == {1, 2}
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table).collect()} == {i: 1 if i == 2 else i for i in range(len(texts))}


def test_ngram_sets_of_far_pairs_stay_where_they_are(spark, monkeypatch):
    half = " ".join([*BASE.split()[:60], *(f"y{i}" for i in range(60))])
    docs = spark.createDataFrame([(0, BASE), (1, BASE.replace("w60 ", "x60 ")), (2, half), (3, half)], "doc_id long, text string")
    sets = materialized(ngram_join.sets_of(docs, spark.range(4).withColumnRenamed("id", "doc"), 4))
    wanted, among = [], ngram_join.among
    monkeypatch.setattr(ngram_join, "among", lambda rows, key, ids: wanted.extend(r.id for r in ids.collect()) or among(rows, key, ids))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "a long, b long")
    assert sorted(map(tuple, ngram_join.linked(pairs, sets, 85).collect())) == [(0, 1)] and sorted(wanted) == [0, 1]


def test_ngram_rows_among_ids_and_sketches_that_are_full(spark):
    ids = spark.range(-5000, 5000)
    found = {r.doc for r in ngram_join.among(ids.withColumnRenamed("id", "doc"), "doc", ids.filter("id % 100 = 0")).collect()}
    assert found >= set(range(-5000, 5000, 100)) and len(found) < 110
    full = np.frombuffer(ngram_join.sketch(np.arange(70_000, dtype=np.int64) * ngram_join.SKETCH), np.uint8)
    assert full[0] == 255 and not full[1:].any()


def test_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().mkString(",").count("shuffle_")
    before = files()
    table = materialized(spark.range(1000).repartition(5, "id"))
    for _ in range(50):  # they are removed behind the write
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 1000 and spark.conf.get(CLEANUP) == "false"


def test_workers_keep_one_thing():
    first = shared.kept("a", list)
    first.append(1)
    assert shared.kept("a", list) is first
    assert shared.kept("b", dict) == {} and shared.kept("a", list) == []


def test_ngram_links_are_all_pairs(spark, docs, none):
    texts = {}
    for i in range(40):  # one group of near copies, all with different sets, and copies of ten of them
        words = BASE.split()
        words[3 * (i % 30)] = f"e{i % 30}"
        texts[i] = " ".join(words)
    sets = {i: {tuple(t.split()[k:k + 4]) for k in range(117)} for i, t in texts.items()}
    expected = {(a, b) for a, b in itertools.combinations(range(30), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    links, members = ngram_join.jaccard_links(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3))
    assert len(expected) > 400 and sorted(map(tuple, links.collect())) == sorted(expected)
    degree = collections.Counter(x for pair in expected for x in pair)
    assert {r.doc_id: (r.class_id, r.n_links) for r in members.collect()} == {i: (i % 30, degree[i % 30]) for i in texts}
    assert ngram_join.jaccard_links(docs)[1].count() == docs.count() and ngram_join.jaccard_links(none)[1].count() == 0


def test_secret_spans_and_ledger(spark, docs, none):
    found = {r.path: r for r in secret_scan.scan(docs).collect()}
    assert len(found) and secret_scan.scan(none).count() == 0
    for i, text in {r[0]: r[1] or "" for r in rows()}.items():
        expected = []
        for place, rule in enumerate(secret_scan.RULES):
            expected += [(m.start(), place, m.end(), rule.kind) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
        assert [(f.start, f.end, f.kind) for f in found[i].findings] == [(s, e, k) for s, _, e, k in sorted(expected)]
    ledger = new_folder(spark, "test-ledger")
    first = secret_scan.RULES[:2]
    secret_scan.scan_into(docs, ledger, first)
    size = spark.read.parquet(ledger).count()
    assert size == docs.select("text").na.fill("").distinct().count()
    secret_scan.scan_into(docs, ledger, first)
    assert spark.read.parquet(ledger).count() == size  # nothing is unseen
    secret_scan.scan_into(docs, ledger)
    newer = spark.read.parquet(ledger).filter("array_contains(scanned, 'hex@1')")
    assert newer.count() == size and "assign@1" not in newer.first().scanned
    redacted = {r.doc_id: r for r in secret_scan.redacted(docs).collect()}
    assert redacted[15].text == "[SECRET] [SECRET] [SECRET]" and redacted[15].n_chars == len(redacted[15].text)
    assert redacted[7].text == BASE and redacted[0].text is None and list(secret_scan.redacted(docs).columns) == docs.columns


def test_secret_spans_and_masks_of_many_hits(spark):
    generator = np.random.default_rng(4)
    texts = ["".join(generator.choice(["0af1" * 5, "é", " ", "token=" + "a1" * 8, "AKIA" + "A" * 16, "\n"], n)) for n in (1, 2, 255, 256, 257, 700, 2000)]
    texts += [("0123456789abcdef" + "x") * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.path: r.findings for r in secret_scan.scan(docs).collect()}
    masked = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    for i, text in enumerate(texts):
        expected = sorted((m.start(), place, m.end(), rule.kind) for place, rule in enumerate(secret_scan.RULES)
                          for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least)
        assert [(f.start, f.end, f.kind) for f in found[i]] == [(s, e, k) for s, _, e, k in expected]
        out, at = [], -1
        for start, _, end, _ in expected:
            if start > at:
                out.append(text[max(at, 0):start] + "[SECRET]")
            at = max(at, end)
        assert masked[i] == "".join(out) + text[max(at, 0):]


def test_warc_round_trip(spark):
    big = "é" * 600
    pages = spark.createDataFrame(
        [(1, "http://a/x y", "<p>"), (2, None, None), (3, "http://b", big), (5, "http://c", big), (4, "http://d", big), (None, "u", big), (9, "l", "z" * 400_000)],
        "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archived(spark, pages, shard_bytes=2000, roll_bytes=1500).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 5), 4: ("revisit", 5), 5: ("response", None), None: ("revisit", 5), 9: ("response", None)}
    assert got[3].payload_bytes == 1200 and got[3].payload_digest == hashlib.sha1(big.encode()).hexdigest() and bytes(got[9].payload) == b"z" * 400_000
    assert warc.archived(spark, pages.limit(0)).count() == 0

    def files(partitions):
        folder = new_folder(spark, "test-warc")
        warc.write_archives(pages.repartition(partitions), folder, shard_bytes=2000, roll_bytes=1500)
        return {p.rsplit("/", 1)[1]: open(p, "rb").read() for p in glob.glob(f"{folder}/*.warc.gz")}
    assert files(1) == files(4)


def test_packing_places_every_token_once(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    placed = packing.packed(docs, path).collect()
    by_sequence = collections.defaultdict(list)
    for r in placed:
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for i, text in {r[0]: r[1] or "" for r in rows() if r[0] != 4}.items():
        mine = sorted((r for r in placed if r.doc_id == i), key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist()
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert all(r.length == 1024 for r in mine[1:]) and [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
    assert packing.packed(none, path).count() == 0


def test_packing_holds_few_texts_and_gives_words_back(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"word{i} two") for i in range(3000)], "doc_id long, text string").coalesce(1)

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
    sizes = [r.n for r in materialized(table.mapInArrow(seen, "n long"), rows=packing.ROWS).collect()]
    assert sum(sizes) == 3000 and max(sizes) <= packing.ROWS and spark.conf.get(BATCH) == "10000"
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", "more words"])], names=["doc_id", "text"])
    function = []
    monkeypatch.setattr(packing.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    frame = types.SimpleNamespace(mapInArrow=lambda f, schema: function.append(f))
    packing.pieces(types.SimpleNamespace(select=lambda *c: frame), path)
    assert sum(b.num_rows for b in function[0](iter([batch]))) == 2
    words = word_encoding.encoder(path, True)
    assert not words.known and not words.older


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_no_worse_than_best_fit(seed):
    generator = np.random.default_rng(seed)
    histogram = np.bincount(np.clip(generator.lognormal(4, 1, 400 * (seed + 1)).astype(int), 1, 255), minlength=257)
    plan = packing.solved(histogram, 256)
    used = collections.Counter()
    for content, times in plan:
        assert sum(s * n for s, n in content.items()) <= 256
        for s, n in content.items():
            used[s] += n * times
    assert all(used[s] == n for s, n in enumerate(histogram))
    count = lambda p: sum(t for _, t in p)
    assert math.ceil((np.arange(257) * histogram).sum() / 256) <= count(plan) <= count(packing.rounded(histogram, [], 256))


@pytest.mark.parametrize("times", [1, 1000])
def test_configuration_program_covers_near_its_bound(times):
    generator = np.random.default_rng(1)
    histogram = times * np.bincount(np.clip(generator.lognormal(4, 0.5, 3000).astype(int), 1, 255), minlength=257)
    cover, price, bound = packing.configuration_program(histogram, 256)
    used = np.zeros(257)
    for content, amount in cover.items():
        assert amount > 0 and sum(s * n for s, n in content) <= 256
        for s, n in content:
            used[s] += n * amount
    assert (used >= histogram * (1 - 1e-9)).all() and bound <= sum(cover.values()) <= 1.01 * bound
    # prices divided by the dearest configuration are dual feasible: no cover takes less than they sum to
    value = packing.knapsack(price, 256)[0][256]
    assert (np.maximum(price, 0) * histogram).sum() / value <= sum(cover.values()) * (1 + 1e-9)
    count = lambda plan: sum(t for _, t in plan)
    whole = [(dict(content), int(amount)) for content, amount in cover.items() if amount >= 1]
    from_program, best_fit = packing.rounded(histogram, whole, 256), packing.rounded(histogram, [], 256)
    assert count(packing.solved(histogram, 256)) <= count(best_fit)
    if times > 1:  # large counts: rounding down costs next to nothing, and the program decides
        assert count(whole) > 0.99 * count(from_program) and count(from_program) <= 1.01 * bound
        assert count(from_program) == count(packing.solved(histogram, 256)) < count(best_fit)


def test_configuration_program_of_few_and_no_lengths():
    assert packing.solved(np.zeros(257, np.int64), 256) == []
    for sizes in ([(200, 7)], [(1, 5)], [(150, 10), (100, 4), (60, 7)]):
        histogram = np.zeros(257, np.int64)
        for size, n in sizes:
            histogram[size] = n
        cover, _, bound = packing.configuration_program(histogram, 256)
        assert sum(cover.values()) >= bound - 1e-9
        # by brute force: the fewest sequences of 256 that hold the pieces
        pieces = [size for size, n in sizes for _ in range(n)]

        @functools.cache
        def fewest(left):
            if not left:
                return 0
            best = math.inf
            for others in {c for k in range(4) for c in itertools.combinations(left[1:], k)}:
                if left[0] + sum(others) <= 256:
                    rest = list(left[1:])
                    for x in others:
                        rest.remove(x)
                    best = min(best, 1 + fewest(tuple(rest)))
            return best
        if sizes[0][0] > 1:
            assert sum(t for _, t in packing.solved(histogram, 256)) == fewest(tuple(sorted(pieces, reverse=True)))


def test_html_extraction(spark):
    page = lambda k, body: f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li>Menu</li></ul></nav>{body}<div class='comments'><p>nice {k}</p></div><footer>c</footer></body></html>"
    bodies = [f"<div id='content'><h1>H{k}</h1><p>Text &amp;  more\n{k} <b>b{k}</b>old{k}<br>x{k}</p><p>Second {k} of some length</p></div><div class='box'>Always here</div>" for k in range(6)]
    rows = [(k, f"https://Host.example/{k}", page(k, b)) for k, b in enumerate(bodies)]
    rows += [(10, "http://single.example/a", "<article><h1>A</h1><p>one<p>two</article><aside>no</aside>"), (11, None, None), (12, "x", "plain & text")]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[2] == "H2\nText & more 2 b2old2 x2\nSecond 2 of some length"
    assert (got[10], got[11], got[12]) == ("A\none\ntwo", "", "plain & text")
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_text_of_copies_siblings_and_telling_names(spark):
    one = "<html><head></head><body><div id='t'><p>Only page</p></div></body></html>"
    two = "<html><body class='no-sidebar newsletter'><div class='lead'><p>Lead {0}</p></div><div class='story'><p>Long story {0} of words</p></div><div class='box'>Always</div></body></html>"
    head = "<html><body><article><div class='entry-header'><h1>Title {0}</h1></div><p>Body {0}</p><div class='share'>no</div></article></body></html>"
    many = "<html><body><div><p>Page {0}</p></div></body></html>"
    own = "<html><body><div><p>Page x</p></div><section><p>Own text</p></section></body></html>"
    rows = [(k, "http://one.example/", one) for k in range(4)] + [(4 + k, None, one) for k in range(3)]
    rows += [(10 + k, f"http://two.example/{k}", two.format(k)) for k in range(5)] + [(20 + k, f"http://head.example/{k}", head.format(k)) for k in range(3)]
    rows += [(30 + k, f"http://many.example/{k}", many.format(k)) for k in range(4)] + [(40 + k, "http://many.example/x", own) for k in range(20)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {got[k] for k in range(7)} == {"Only page"}
    assert got[12] == "Lead 2\nLong story 2 of words"
    assert got[21] == "Title 1\nBody 1"
    assert got[30] == "Page 0" and got[45] == "Page x\nOwn text"


def test_html_template_strings_inside_the_article(spark):
    page = "<html><body><article><p>Story number {0} of this host</p><div><p>Share this</p></div><p>End {0} of it</p></article></body></html>"
    same = "<html><body><article><p>{0}</p><p>One long text that this host has on every page</p></article></body></html>"
    rows = [(k, f"http://host.example/{k}", page.format(k)) for k in range(4)] + [(10 + k, f"http://same.example/{k}", same.format(k)) for k in range(4)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[2] == "Story number 2 of this host\nEnd 2 of it"
    assert got[11] == "1\nOne long text that this host has on every page"


def test_html_template_is_a_tree_of_ordered_classes(spark):
    texts = lambda body: {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(
        [(k, f"http://{h}.example/{k}", f"<html><body>{body(k, h)}</body></html>") for h in ("one", "two") for k in range(4 * (h == "two"), 4 + 4 * (h == "two"))],
        "page_id long, url string, html string").repartition(3)).collect()}
    # headings that all pages have stay with the text below them; a box without data goes, also one on the path of another
    paper = texts(lambda k, h: f"<article><h2>Abstract</h2><p>About {k} of {h}</p><h2>References</h2><p>Other {k}</p><div><p>Follow us</p></div><div><p>Box {k}</p></div></article>")
    assert paper[2] == "Abstract\nAbout 2 of one\nReferences\nOther 2\nBox 2"
    # no article, and furniture in containers that neither tag nor name tells
    plain = texts(lambda k, h: f"<div><a>Home</a><a>Contact</a></div><div><h2>Summary</h2><p>Story {k} of {h}</p></div><div><p>All rights reserved</p></div>")
    assert plain[5] == "Summary\nStory 5 of two"


def test_html_classes_are_checked_for_order_and_nesting(spark):
    """Against every page by brute force: members in one order, spans that lie apart or within one another."""
    body = "<div><p>A</p></div><section><p>B</p></section>", "<section><p>B</p></section><div><p>A</p></div>"
    rows = [(k, "http://x.example/", f"<html><body>{body[k % 2]}<main>{k}<table><tr><td>one {k}<td>two</table></main></body></html>") for k in range(6)]
    pages = materialized(html_text.sequences(spark.createDataFrame(rows, "page_id long, host string, html string").repartition(3)))
    one = html_text.templates(pages).first()
    assert one
    known = [{t: html_text.Member(*m) for t, *m in zip(*[iter(flat)] * 4)} for flat in one.chain]
    strings = set()
    for _, _, page in rows:
        events = list(html_text.walked(page))
        kinds, roles, parents = html_text.sequence(events)
        roles = html_text.refined(roles, kinds, parents, known[:-1]).tolist()
        texts = [v.strip() for kind, _, v in events if kind == "text" and v.strip()]
        strings |= {v for v, r in zip(texts, [r for r, k in zip(roles, kinds) if k == html_text.TEXT]) if r in known[-1]}
        around = []
        for member in (known[-1][r] for r in roles if r in known[-1]):
            if member.rank == 0:
                around.append(0)
            assert around[-1] == member.rank
            around[-1] += 1
            if member.last:
                around.pop()
        assert not around
    # which of A and B comes first is not the same on all pages: both cannot be in the template
    assert not {"A", "B"} <= strings


def test_token_files(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = new_folder(spark, "test-tokens")
    manifest = token_files.write_token_files(docs, folder, path, shard_chars=50_000)
    got = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted([*range(len(rows())), 4])]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    at = 0
    for r in got:
        text = BASE if r.doc_id is None else rows()[r.doc_id][1] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    name = manifest.filter("shard = 0").first()["name"]
    assert token_files.read_document(folder, name, 5).tolist() == np.frombuffer(next(r for r in got if r.doc_id == 5).ids, "<u4").tolist()
    assert token_files.token_files(spark, none, path).count() == 0


def test_token_files_are_read_by_frames_and_words_are_given_back(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = new_folder(spark, "test-frames")
    manifest = token_files.write_token_files(docs, folder, path)
    read = token_files.read_token_files(manifest, folder)
    assert "binaryFile" not in read._jdf.queryExecution().toString()  # no row holds a whole file
    fs, base = shared.filesystem(folder)
    taken = []

    class Counted(io.BytesIO):
        def read(self, size=-1):
            taken.append(size)
            return super().read(size)

    content = fs.open_input_file(f"{base}/{manifest.first()['name']}").read()
    _, index = token_files.opened(pa.PythonFile(Counted(content), mode="r"))
    assert sum(taken) == len(content) - int(index["size"].sum()) and len(index) == docs.count()
    words = word_encoding.WordEncoder(path, False)
    one = words.encode(LONG)
    words.forget()
    assert not words.known and not words.older and words.encode(LONG) == one


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_of_latin_letters_go_to_the_model(name, spaced):
    words = word_encoding.WordEncoder(public_tokenizers.path(name), spaced)
    text = "Die Stra\u00dfe \u00c9T\u00c9 na\u00efve\nPlain \u00fcber xqzzkvw\n\u00c0 \u00b5 \u00aa\u00ba ANDso"
    whole = words.direct(text)

    class Single:  # no call for many words at a time
        encode = words.tokenizer.encode

    words.tokenizer = Single()
    assert words.straight and words.encode(text) == whole


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_unknown_words_are_encoded_as_one_text(name, spaced):
    words = word_encoding.WordEncoder(public_tokenizers.path(name), spaced)
    whole, asked = words.tokenizer, []
    words.tokenizer = types.SimpleNamespace(
        encode=whole.encode, encode_batch_fast=lambda texts, **k: asked.extend(texts) or whole.encode_batch_fast(texts, **k))
    text = " ".join(f"word{i}" for i in range(word_encoding.CALL - 1)) + " a|b"
    assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(asked) <= 2


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_encode_like_whole_texts(name, spaced, monkeypatch):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    odd = ["ΑΣ ΣΑ.", "it's I'M we'll.", "é́ x", "x\x1cy", "a\n\nb", " a", "a \nb", "İstanbul.", "1 2,3 33. ..", "A.b? c!"]
    odd += ["", "\n", "Foo's &&& 'x'... (A) b.\nNew!? ÉCOLE&&& ǅ#", "a,b,; c1.. 12,3.\n... ...a", "\u0301a ́b&", "<|endoftext|> x", "_a _ a_ `` ~a~", "w\n'S. x's;", "ab " * 3000 + "x"]
    texts = [*odd, *(r[1] or "" for r in rows())]
    whole = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    ids = lambda found: np.frombuffer(found, "<u4").tolist()
    assert [ids(word_encoding.encoder(path, spaced).encode(text)) for text in texts] == whole
    assert list(map(ids, word_encoding.encoder(path, spaced).encode_all(texts))) == whole
    # texts in parts, a small memory of words and small calls change nothing
    for name, value in {"CHARS": 40, "KEPT": 16, "CALL": 3}.items():
        monkeypatch.setattr(word_encoding, name, value)
    small = word_encoding.WordEncoder(path, spaced)
    assert list(map(ids, small.encode_all(texts))) == whole
    assert list(map(ids, small.encode_all(texts[::-1]))) == whole[::-1]


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["a" * n for n in (10, 5000, 3, 9, 2500, 1, 1, 1, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(shared.slices(iter([batch]), 4, 1000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or p.nbytes <= 1000) for p in parts)


def test_class_model(docs, plain, none):
    got = by_id(class_lm.scores(plain))
    texts = {r[0]: (r[1] or "").encode().lower().split() + [b""] for r in rows()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = collections.Counter(w for i, t in texts.items() if not held[i] for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in texts.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert got[i].base_score == pytest.approx(base) and math.isfinite(got[i].score)
    assert class_lm.scores(docs).count() == docs.count() and class_lm.scores(none).count() == 0


def test_class_model_counts_by_arrays(spark, plain):
    texts = [r[1] or "" for r in rows()]
    words, sizes = class_lm.joined_tokens(pa.array(texts))
    assert words == [w for t in texts for w in class_lm.tokens(t)] and sizes == [len(class_lm.tokens(t)) for t in texts]
    number = class_lm.Numbers()
    assert [number.names[k] for k in number.codes(words).tolist()] == words and len(number.names) == len(set(words))
    units = {w: i for i, w in enumerate(sorted(set(words) - {class_lm.END})[:50], 1)}
    want = collections.Counter()
    for t in texts:
        line = [0, *(class_lm.unit_of(w, units) for w in class_lm.tokens(t))]
        want.update(zip(line, line[1:]))
    pairs = class_lm.unit_pairs(plain.select(whole_text().alias("text")), units)
    assert {(int(a), int(b)): int(pairs[a, b]) for a, b in zip(*np.nonzero(pairs))} == want


def test_every_word_has_a_class_of_its_own_neighbours(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "KNOWN", 30)
    generator = np.random.default_rng(3)
    # rare words share one ending, but stand in two kinds of places
    one, two = ([f"{kind}{i}same" for i in range(40)] for kind in "ab")
    texts = [" ".join(w for _ in range(25) for w in ("le", generator.choice([*one, *["p"] * 20]), "x", "un", generator.choice([*two, *["q"] * 20]), "y")) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    training = table.filter(~class_lm.held_out())
    units = {bytes(w): i for i, w in enumerate([b"le", b"p", b"q", b"un", b"x", b"y"], 1)}
    pairs = class_lm.unit_pairs(training, units)
    classes = class_lm.exchange(pairs)
    member = np.eye(class_lm.CLASSES)[classes]
    got = {bytes(r.word): r for r in class_lm.moved(training, units, classes, member.T @ pairs @ member).collect()}
    words = [w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in t.encode().split()]
    assert {w: r.n for w, r in got.items()} == {w: n for w, n in collections.Counter(words).items() if w not in units}
    kinds = [{got[w.encode()]["class"] for w in some if w.encode() in got} for some in (one, two)]
    assert not kinds[0] & kinds[1]
    scored = by_id(class_lm.scores(table))
    held = [r for r in scored.values() if r.held_out]
    assert len(scored) == 60 and held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gains_are_those_of_the_likelihood():
    generator = np.random.default_rng(5)
    size = class_lm.CLASSES
    table = generator.integers(0, 400, (size, size)).astype(float)
    around = np.zeros((30, 2 * size))
    for k in range(30):  # counts on both sides of those that are looked up
        for half in (0, size):
            around[k, half + generator.integers(1, size, 4)] = generator.integers(1, [3, 40, 3 * class_lm.STEPS][k % 3], 4)
    around[:, size + 1] += around[:, :size].sum(1) - around[:, size:].sum(1) + 500
    own = generator.integers(1, size, 30)
    x = lambda a: a * math.log(a) if a > 0 else 0.0
    got = class_lm.Gains(table).best_classes(around, own)
    for k in range(30):
        gains, total = {}, around[k, :size].sum()
        for c in range(1, size):
            parts = [(table[g, c], around[k, g]) for g in range(size)] + [(table[c, g], around[k, size + g]) for g in range(size)]
            change = lambda v, n: (x(v) - x(max(v - n, 0)) if c == own[k] else x(v + n) - x(v)) if n else 0.0
            gains[c] = sum(change(v, n) for v, n in parts) - change(table[c].sum(), total) - change(table[:, c].sum(), total)
        best = max(gains, key=gains.get)
        assert got[k] == (best if gains[best] > gains[own[k]] + 1e-9 else own[k])


def test_words_outside_the_list_meet_their_classes(spark, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 7}" for k in range(20)) + (f" only{i} w1 only{i} rare{i % 3}" if i % 2 else "") for i in range(40)] + ["", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = by_id(class_lm.scores(table))
    monkeypatch.setattr(class_lm, "KNOWN", 3)
    got = by_id(class_lm.scores(table))
    assert got.keys() == wanted.keys() and len(got) == 42
    for i, r in got.items():
        assert (r.n_tokens, r.n_known) == (wanted[i].n_tokens, wanted[i].n_known)
        assert (r.base_score, r.score) == (pytest.approx(wanted[i].base_score), pytest.approx(wanted[i].score))


def test_exchange_raises_the_likelihood():
    generator = np.random.default_rng(0)
    kind = np.array([0, *generator.integers(1, 4, 60)])
    chance = np.array([[0, 9, 1, 1], [1, 1, 9, 1], [1, 1, 1, 9], [5, 9, 1, 1]], float)
    pairs = generator.poisson(chance[kind][:, kind]).astype(float)

    def value(of, classes):
        table = np.zeros((classes, classes))
        np.add.at(table, (of[:, None], of[None]), pairs)
        x = lambda a: (a[a > 0] * np.log(a[a > 0])).sum()
        return x(table) - x(table.sum(0)) - x(table.sum(1))
    found = class_lm.exchange(pairs, classes=4, sweeps=10)
    assert found[0] == 0 and (found[1:] > 0).all()
    assert value(found, 4) > value(np.array([0, *(1 + np.arange(60) % 3)]), 4) and value(found, 4) >= value(kind, 4) - 1


def test_quality_rules(spark, docs, none):
    got = quality_rules.quality(docs).collect()
    assert len(got) == docs.count() and quality_rules.quality(none).count() == 0
    assert quality_rules.repeated_words(b"a b c x a b c".split()) == 6 and quality_rules.repeated_words(b"a a a a".split()) == 4
    words = [f"k{i}" for i in range(80)]
    clean = [(i, " ".join(words[i % 7:] + [f"u{i}"]), "en", "s", 0) for i in range(200)]
    junk = [(1000 + i, " ".join(f"{w}###" for w in words), "en", "s", 0) for i in range(5)]
    kept = by_id(quality_rules.quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")))
    assert all(kept[i].kept for i, *_ in clean) and not any(kept[i].kept for i, *_ in junk)


def test_quality_limits_follow_the_group(spark):
    generator = np.random.default_rng(2)
    made = lambda size: " ".join("".join(generator.choice(list("abcdefgh"), size + generator.integers(0, 2))) for _ in range(90))
    row = lambda i, text, source: (i, text, "en", source, 0)
    table = [row(i, made(5 if i % 2 else 10), "ab"[i % 2 == 0]) for i in range(400)]
    table += [row(1000, made(10), "a"), row(1001, made(5), "b"), row(1002, made(5), "a"), row(1003, made(10), "b"), row(1004, made(16), "small")]
    table += [row(2000 + i, "junk " * i, "a") for i in range(90)]  # fails the base rules, and moves no limit
    got = by_id(quality_rules.quality(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)))
    assert all(got[i].kept for i in (*range(400), 1002, 1003)) and not any(got[i].kept for i in (1000, 1001, *range(2000, 2090)))
    coarse = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    for source, i in (("a", 1), ("b", 0)):
        values = sorted(coarse(1000 * r.word_chars // r.n_words) for r in got.values() if r.source == source and not r.base_failed)
        q1, q2, q3 = (values[math.ceil(q * len(values) / 4) - 1] for q in (1, 2, 3))
        assert (got[i].limit_word_length, got[i].least_word_length) == (q3 + max(8 * (q3 - q2), 500), q1 - max(8 * (q2 - q1), 500))
    # no text repeats a line: no limit, and all pass
    assert got[0].limit_duplicate_lines is None and got[1004].limit_word_length is not None


def test_exact_groups_and_colliding_fingerprints(docs, none):
    weak = lambda chunk, attempt: hashlib.sha256(chunk).digest()[:1 if attempt == 0 else 16]
    for identify in (exact_dedup.fingerprint, weak):
        got = by_id(exact_dedup.exact_groups(docs, identify))
        assert (got[7].keep_id, got[7].group_size, got[7].kept, got[8].kept, got[None].kept) == (8, 3, False, True, False)
        assert (got[0].keep_id, got[12].kept, got[11].kept, got[4].group_size) == (1, True, False, 2)
    assert exact_dedup.exact_groups(none).count() == 0
    data = np.random.default_rng(0).bytes(200_000)
    assert b"".join(exact_dedup.chunks(data)) == data and max(map(len, exact_dedup.chunks(bytes(100_000)))) <= exact_dedup.MOST
    assert len(set(exact_dedup.chunks(data)) & set(exact_dedup.chunks(b"x" + data))) > 50


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline
    functions = dict(corpus_pipeline.STAGES)
    for name, stage in list(functions.items())[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, none, "").count() == 0
    assert {r.doc_id for r in functions["exact dedup"](spark, docs, "").collect()} & {7, 8, 11, 12} == {8, 12}
    assert {r.doc_id for r in functions["n-gram jaccard join"](spark, docs, "").collect()} & {7, 8, 9} == {7}


def test_pipeline_drops_only_the_rows_judged(spark):
    import corpus_pipeline
    functions = dict(corpus_pipeline.STAGES)
    words = [[f"{c}{k}" for k in range(100)] for c in "abcdefg"]
    a, b, c, d, e, f, g = map(" ".join, words)
    near = lambda w, n: " ".join(w[:-n] + [f"z{k}" for k in range(n)])
    run = lambda name, rows: sorted(map(str, ((r.doc_id, r.text) for r in functions[name](
        spark, spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(3), "").collect())))
    sort = lambda rows: sorted(map(str, rows))
    clean = [(None, a), (None, b), (1, c), (2, d)]
    assert run("quality rules", [*clean, (None, "short"), (1, "short"), (1, None), (None, None)]) == sort(clean)
    assert run("exact dedup", [*clean, (9, e), (None, e), (1, e), (9, f)]) == sort([*clean, (9, e), (9, f)])
    # 96 five-word n-grams: ten words replaced leave 86 of 106 (0.811), eleven 85 of 107 (0.794)
    assert run("n-gram jaccard join", [*clean, (3, e), (4, near(words[4], 10)), (4, f), (None, near(words[4], 1)), (5, near(words[3], 11)), (None, g)]) == \
        sort([*clean, (3, e), (4, f), (5, near(words[3], 11)), (None, g)])


def test_pipeline_columns_of_clashing_names_and_repeated_rows(spark):
    import corpus_pipeline
    functions = dict(corpus_pipeline.STAGES)
    names = ["_blob", "_found", "__found", "_gone_doc_id", "_gone_text_sha256", "_gone__sha256", "_kept", "_node", "_sha256", "blob"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    other = " ".join(f"v{i}" for i in range(100)) + " secret = abcdefgh12345678"
    made = lambda *keys: spark.createDataFrame([(*k, "en", "s", *names) for k in keys], schema).repartition(3)
    table = made((1, BASE), (1, BASE), (1, BASE), (2, other), (2, other), (None, "x " * 9), (None, "x " * 9))
    for name, kept in (("quality rules", [1, 1, 1, 2, 2]), ("exact dedup", [1, 2, None]), ("n-gram jaccard join", None), ("secret scan", [1, 1, 1, 2, 2, None, None])):
        got = functions[name](spark, table, "")
        found = got.collect()
        assert got.columns == table.columns and all(list(r)[4:] == names for r in found)
        assert kept is None or sorted(r.doc_id or 9 for r in found) == sorted(i or 9 for i in kept), name
    short = spark.createDataFrame([(1, other, 7), (2, "plain", 7)], "doc_id long, text string, n_chars int")
    sized = secret_scan.redacted(short)
    assert dict(sized.dtypes)["n_chars"] == "int"
    assert {(r.doc_id, r.n_chars == len(r.text), r.n_chars) for r in sized.collect()} == {(1, True, len(other) - len("secret = abcdefgh12345678") + 8), (2, False, 7)}
    assert secret_scan.redacted(short.drop("n_chars")).columns == ["doc_id", "text"]


def test_registered_queries_match_their_sql(spark):
    from ebbtide.llm.queries import ORACLES, QUERIES
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name in ("op3_secret_scan", "op4_warc", "op10_exact_dedup"):
        columns = ", ".join(sorted(QUERIES[name](spark, folder).columns))
        expected = db.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
        got = [tuple(r) for r in QUERIES[name](spark, folder).select(*columns.split(", ")).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected)), name
