import random
import re

import numpy as np
import pytest

from stockflow.llm import near_dup as nd

SCHEMA = "doc_id long, text string, key long, rep long, component string"


def word_sets(rows, words):
    out = {}
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[doc_id] = {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
    return out


def brute(rows, words, percent=80):
    """doc_id -> (size of its set, least doc_id reachable), every pair compared."""
    sets = word_sets(rows, words)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, words):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs, words).collect()}
    assert got == brute(rows, words)


def test_small_cases(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "Two one"), (7, "é É"), (8, "é é"), (9, "a b"), (10, "a b")]
    for i in range(40):  # a chain of copies, each a few words from the one before, so that ends are joined only by way of others
        base[rng.randrange(120)] = rng.choice(words)
        rows.append((100 + i, " ".join(base)))
    rows += [(200 + i, " ".join(base[:60] + [w.upper() for w in base[60:]])) for i in range(5)]
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(50))) for i in range(10)]
    rows += [(400, "x " * 30_000), (401, "x " * 29_000), (402, "x y " * 20_000)]
    for n in (2, 5):
        check(spark, rows, n)


def test_blocks(spark, monkeypatch):
    """A large group with strays, some of which are joined to others only, in blocks of a few documents."""
    monkeypatch.setattr(nd, "BLOCK_DOCS", 7)
    monkeypatch.setattr(nd, "SMALL", 2)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([2, 4, 8, 12, 14])):
            own[at] = rng.choice(words)
        rows.append((i, " ".join(own)))
    check(spark, rows, 2)


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 2)
    check(spark, rows, 5)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(empty).count() == 0 and nd.without_near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True)], key=str)
    left = nd.without_near_duplicates(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, gone long"))
    assert left.columns == ["doc_id", "text", "gone"] and sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 1, None, 3], key=str)


def test_components_against_brute_force(spark):
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(200, 200 + i) for i in range(1, 30)]
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in links)}


@pytest.mark.parametrize("n", [1, 3, 40, 3000])
def test_sketch_estimates_likeness(n):
    """Every coordinate is filled, and the share of equal ones is near the similarity."""
    rng = np.random.default_rng(n)
    size, trials, share = 256, 12, []
    both = max(1, n * 8 // 10)
    for _ in range(trials):
        x = np.unique(rng.integers(0, 1 << 63, n + (n - both), dtype=np.int64).astype(np.uint64))
        a, b = nd.sketch(x[:n], size), nd.sketch(x[n - both :], size)
        assert (a > 0).all() and (b > 0).all()
        true = len(np.intersect1d(x[:n], x[n - both :])) / len(np.union1d(x[:n], x[n - both :]))
        share.append((a == b).mean() - true)
    assert abs(np.mean(share)) < 0.05


def test_ids_that_recur_with_unlike_texts(spark, monkeypatch):
    """Rows of one id: copies of each other, and others unlike them. Each text counts, none as many times as it comes."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    one, two, other = (" ".join(rng.choices(words, k=80)) for _ in range(3))
    near = lambda t: t + " end"
    rows = [(1, one)] * 30 + [(1, other)] * 30 + [(2, near(one))] * 30 + [(3, near(other)), (4, two), (5, near(two)), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    asked = []
    real = nd.confirmed
    monkeypatch.setattr(nd, "confirmed", lambda pairs, docs, *more: asked.append(docs.count()) or real(pairs, docs, *more))
    got = nd.near_duplicates(docs, 2).collect()
    assert len(got) == len(rows) and set(asked) == {8}
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)}
