"""The filter audit, ranked search and vector links against brute force, with odd input."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import filter_audit, ranked_search, vector_links

DOCS = "doc_id long, text string, source string, n long, mask int, digest string, rank int, score long, terms string, part string"
LABELS = "doc_id long, quality int, toxic int, n long, part string"


def failures(doc_id, text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {f for f, failed in zip("ABCDE", (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), bool(re.search(r"[#$%&*|]", text)),
        doc_id is not None and any(t == text and i is not None and i < doc_id for i, t in smaller))) if failed}


def audit_by_hand(docs, labels):
    texts = [(r[0], r[1] or "") for r in docs]
    rows = {}
    for part in {r[2] or "" for r in docs}:
        mine = [(r[0], failures(r[0], r[1] or "", texts)) for r in docs if (r[2] or "") == part]
        flagged = lambda i, k: i is not None and any(l[0] == i and l[k] == 1 for l in labels)
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(flagged(x[0], 1) for x in gone), sum(flagged(x[0], 2) for x in gone), f]
        for key in [k for k in rows if k[0] == part]:
            rows[key] = tuple(rows[key][:-1]) + (total[rows[key][-1]],)
    return rows


def many(n, seed):
    return " ".join(f"w{(i * seed) % 977}" for i in range(n))


def test_filter_audit_is_that_of_every_order(spark):
    rng = np.random.default_rng(5)
    pool = [None, "", many(250, 7), many(250, 1), many(30, 3), many(220, 5) + " $", "a " * 300, many(240, 11).upper(), "# " + "b " * 250, " \n\t", many(30_000, 13), "É" * 60 + "A"]
    docs = [(i, pool[int(rng.integers(len(pool)))], ["s", "t", None, ""][int(rng.integers(4))]) for i in range(120)]
    docs += [(None, many(250, 7), "s"), (None, None, "s"), (3, many(250, 7), "t"), docs[10], docs[10]]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 120, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2, "d", 3, 4, "t", "p") for d in docs], DOCS).repartition(5)
    known = spark.createDataFrame([(*x, 1, "p") for x in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.STEP) for r in filter_audit.audited(frame, known).collect()}
    assert got == audit_by_hand(docs, labels)


def test_filter_audit_of_nothing(spark):
    assert filter_audit.audited(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(1, None, None, 1, 2, "d", 3, 4, "t", "p")], DOCS)
    assert filter_audit.audited(one, spark.createDataFrame([], LABELS)).filter("part = ''").count() == 600


def test_the_walk_is_the_sum_over_masks():
    masks = np.array([0, 3, 17, 31, 8])
    counts = np.array([[5, 1, 0], [7, 0, 2], [1, 1, 1], [4, 3, 2], [9, 9, 9]])
    states = filter_audit.survivors(masks, counts)
    for active in range(32):
        assert (states[active] == counts[(masks & active) == 0].sum(axis=0)).all()


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def search_by_hand(docs, items):
    cut = [(i, terms(t)) for i, t in docs]
    cut = [(i, w, Counter(w)) for i, w in cut if w]
    total = sum(len(w) for _, w, _ in cut)
    df = Counter(t for _, _, c in cut for t in c)
    rows = set()
    for item, text in set(items):
        scores = []
        for i, words, tf in cut:
            m = 100 - 75 + (75 * len(words) * len(cut)) // total
            score = sum(math.floor(1000 * math.log((2 * len(cut) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scores.append((-score, -(1 << 63) if i is None else i, i))
        rows |= {(item, text or "", k, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:10], 1)}
    return rows


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(11)
    word = lambda: "".join("abcdefgh"[k] for k in rng.geometric(0.35, int(rng.integers(1, 4))) % 8)
    texts = [" ".join(word() for _ in range(int(rng.integers(0, 60)))) for _ in range(700)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900 + i, texts[3]) for i in range(90)]  # a group of copies larger than a leaf
    docs += [(None, texts[5]), (None, "ab ba"), (7, texts[7]), (2000, None), (2001, "  \n"), (2002, "Ünïcode-日本 AB_ba ab"), (2003, "ab " * 30_000)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(25)] + [(30, texts[3]), (31, None), (32, "zzzz"), (33, "AB ab ab"), (33, "AB ab ab"), (None, "日本")]
    return docs, items


@pytest.mark.parametrize("tree, block", [(1 << 20, 16 << 20), (700, 200)])
def test_ranked_search_is_that_of_all_scores(spark, library, monkeypatch, tree, block):
    monkeypatch.setattr(ranked_search, "TREE", tree)
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "LEAF", 8)
    docs, items = library
    frame = spark.createDataFrame([(i, t, "s", 1, 2, "d", 3, 4, "t", "p") for i, t in docs], DOCS).repartition(3)
    got = ranked_search.ranked(frame, spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int"))
    assert {tuple(r) for r in got.select("item_id", "item_text", "rank", "doc_id", "score").collect()} == search_by_hand(docs, items)


def test_the_tree_bounds_its_documents(library, monkeypatch):
    monkeypatch.setattr(ranked_search, "LEAF", 4)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 400)
    found = np.concatenate([rng.choice(40, k, replace=False) for k in sizes])
    tree = ranked_search.Tree(list(range(400)), rng.integers(25, 300, 400), sizes, found, rng.integers(1, 9, sizes.sum()), rng.permutation(40))
    depths = []

    def below(node, depth):
        depths.append(depth)
        if node is None:
            return
        children, terms_of, bounds, starts = node
        assert [c[0] for c in children[1:]] == [c[1] for c in children[:-1]]
        for k, (low, high, child) in enumerate(children):
            end = starts[k + 1] if k + 1 < len(starts) else len(terms_of)
            bound = dict(zip(terms_of[starts[k]:end], bounds[starts[k]:end]))
            span = slice(tree.starts[low], tree.starts[high])
            assert all(bound[t] >= g for t, g in zip(tree.found[span], tree.gains[span]))
            below(child, depth + 1)
    below(tree.root, 0)
    assert tree.root is not None and max(depths) <= 9


def test_ranked_search_of_nothing(spark, library):
    docs, items = library
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")
    some = spark.createDataFrame([(i, t, "s", 1, 2, "d", 3, 4, "t", "p") for i, t in docs[:20]], DOCS)
    assert ranked_search.ranked(none, asked).count() == 0
    assert ranked_search.ranked(some, asked.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, n_links int, digest string, component long, node long"


def links_by_hand(rows):
    """vec_id to set of links per row, and the smallest id reachable."""
    norm = []
    for i, v, label in rows:
        good = i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        norm.append(np.asarray(np.float32(v), np.float64) / np.linalg.norm(np.float32(v).astype(np.float64)) if good else None)
    n, linked = len(rows), [set() for _ in rows]
    for a, b in itertools.combinations(range(n), 2):
        if norm[a] is not None and norm[b] is not None and rows[a][2] == rows[b][2] and len(norm[a]) == len(norm[b]) and norm[a] @ norm[b] >= 0.98:
            linked[a].add(b)
            linked[b].add(a)
    low = {r[0]: r[0] for r in rows if r[0] is not None}
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in linked[a]:
                least = min(low[rows[a][0]], low[rows[b][0]])
                if low[rows[a][0]] != least or low[rows[b][0]] != least:
                    low[rows[a][0]] = low[rows[b][0]] = least
                    changed = True
    return linked, low


def planted(size, rng, n=400):
    rows = [(i, rng.standard_normal(size).tolist(), int(rng.integers(3))) for i in range(n)]
    at = n
    for _ in range(60):  # pairs and chains around the limit
        i, v, label = rows[int(rng.integers(n))]
        for _ in range(int(rng.integers(1, 5))):
            v = (np.array(v) + rng.standard_normal(size) * np.linalg.norm(v) / np.sqrt(size) * rng.uniform(0.02, 0.21)).tolist()
            rows.append((at, v, label))
            at += 1
    middle = rng.standard_normal(size)
    rows += [(at + k, (middle + 0.05 * rng.standard_normal(size)).tolist(), 1) for k in range(150)]  # a dense group
    rows += [(at + 200 + k, middle.tolist(), 1) for k in range(30)]  # of equal ones too
    return rows


@pytest.mark.parametrize("size, block", [(64, 1024), (64, 40), (7, 1024)])
def test_vector_links_find_those_of_brute_force(spark, monkeypatch, size, block):
    monkeypatch.setattr(vector_links, "BLOCK", block)
    rng = np.random.default_rng(size + block)
    rows = planted(size, rng)
    rows += [(5001, None, 1), (5002, [], 1), (5003, [0.0] * size, 1), (5004, [math.nan] + [1.0] * (size - 1), 1), (5005, [None] + [1.0] * (size - 1), 1),
             (5006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (5007, [1.0] * (size + 1), 1), (5008, [1.0] * (size + 1), 1), rows[1]]
    frame = spark.createDataFrame([(*r, 1, "d", 2, 3) for r in rows], VECTORS).repartition(5)
    linked, low = links_by_hand(rows)
    got = vector_links.vector_links(frame).collect()
    assert len(got) == len(rows)
    true = sum(map(len, linked))
    assert 0.98 * true <= sum(r.n_links for r in got) <= true
    by_hand = {}
    for (i, _, _), mine in zip(rows, linked):
        by_hand.setdefault(i, []).append(len(mine))
    agree = sum(r.n_links in by_hand[r.vec_id] and r.component_id == low.get(r.vec_id) for r in got)
    assert agree >= 0.98 * len(rows)
    assert all(r.n_links <= max(by_hand[r.vec_id]) for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_links_do_not_depend_on_partitioning(spark):
    rows = [(*r, 1, "d", 2, 3) for r in planted(16, np.random.default_rng(1), 150)]
    one, other = (sorted(map(tuple, vector_links.vector_links(spark.createDataFrame(rows, VECTORS).repartition(k)).collect())) for k in (1, 6))
    assert one == other


def test_vector_links_of_nothing(spark):
    assert vector_links.vector_links(spark.createDataFrame([], VECTORS)).count() == 0
    lone = vector_links.vector_links(spark.createDataFrame([(3, [1.0, 2.0], 1, 1, "d", 2, 3)], VECTORS)).collect()
    assert [tuple(r) for r in lone] == [(3, 0, 3, True)]


def test_codes_are_balanced():
    rng = np.random.default_rng(3)
    sample = rng.standard_normal((2000, 24)) * np.linspace(0.2, 2, 24) + 0.3
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    made = vector_links.Quantiser(sample, 24, 0.98)
    ones = ((sample - made.centre) @ made.rotations(48) >= 0).mean(axis=0)
    assert ones.min() > 0.4 and ones.max() < 0.6
