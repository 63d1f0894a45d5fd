import math
import random

import numpy as np
import pytest
from conftest import canonical

from stockflow.llm import inner_products as ip

SCHEMA = "vec_id long, embedding array<float>, norm int, chunk string, query string, row int, least string"


def brute(rows, top=5, every=50):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(good):
        if i is not None and i % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63) + 1), 2**63 - 1), j is None, j or 0, j) for other, (j, v) in enumerate(good) if other != at)
            out += [(i, rank, j, -score) for rank, (score, _, _, j) in enumerate(scores[:top], 1)]
    return sorted(out, key=str)


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 1, "x", "y", 2, "z") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in ip.best_products(table, **how).collect()), key=str)


def made(seed, n, size=24, step=0.0, lengths=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        scale = math.exp(rng.gauss(0, lengths))
        out.append((i, [scale * (rng.randrange(-2, 3) * step if step else rng.gauss(0, 1) / (1 + j)) for j in range(size)]))
    return out


@pytest.mark.parametrize("chunk", [7, 100, 40_000])
@pytest.mark.parametrize("rows", [made(1, 600), made(2, 600, step=1 / 256), made(3, 700, lengths=1.5), made(4, 3)], ids=["plain", "ties", "lengths", "few"])
def test_against_brute_force(spark, rows, chunk):
    assert found(spark, rows, chunk=chunk) == brute(rows)


def test_small_tiles_prune_nothing_that_counts(spark, monkeypatch):
    rows = made(5, 500, lengths=0.7)
    for name, value in (("TILE", 16), ("QUERIES", 3), ("PAIRS", 5), ("FIRST_GROUP", 2), ("GROUP", 3)):
        monkeypatch.setattr(ip, name, value)
    assert found(spark, rows, chunk=64) == brute(rows)


def test_search_in_a_chunk_with_small_tiles(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(0, 200, (3000, 32)) * np.linspace(3, 0.2, 32))
    norms = np.sqrt((x**2).sum(axis=1)) * (1 + ip.SLACK)
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    multiplied, plain = [], ip.Chunk.products
    monkeypatch.setattr(ip, "TILE", 200)
    monkeypatch.setattr(ip.Chunk, "products", lambda self, a, b, pairs: multiplied.append(len(a) if pairs else len(a) * len(b)) or plain(self, a, b, pairs))
    chunk = ip.Chunk(list(range(3000)), list(range(3000)), x, norms, turn)
    which, score, _, ids = chunk.search(np.arange(40), x[:40], norms[:40], np.full(40, ip.NONE), 5)
    want = x[:40] @ x.T
    want[np.arange(40), np.arange(40)] = -np.inf
    for q in range(40):
        best = sorted(range(3000), key=lambda j: (-want[q, j], j))[:5]
        assert ids[which == q].tolist() == best and score[which == q].tolist() == [want[q, j] for j in best]
    assert sum(multiplied) < 40 * 3000 / 4


def test_odd_rows(spark):
    rows = made(6, 200, step=1 / 256) + [(50, [1 / 256] * 24), (50, [1 / 256] * 24), (100, [0.0] * 24), (None, [1.0] * 24), (None, [1.0] * 24), (-50, [-1.0] * 24), (7, [1.0] * 24)]
    rows += [(1000, None), (1050, [None] * 24), (1100, [math.nan] * 24), (1150, [math.inf] * 24)]
    rows += [(2000 + i, [0.5] * 24) for i in range(150)]
    for chunk in (20, 10_000):
        assert found(spark, rows, chunk=chunk) == brute(rows)
    assert found(spark, rows + [(1200, [1.0] * 5), (1250, [])]) == brute(rows)


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e34])
def test_large_numbers(spark, scale):
    rows = [(i, [x * scale for x in v]) for i, v in made(7, 120, size=8)]
    assert found(spark, rows, chunk=30) == brute(rows)


def test_empty_and_unusable(spark):
    assert found(spark, []) == found(spark, [(0, None), (50, [])]) == []
    assert found(spark, [(0, [1.0, 2.0])]) == []
    assert found(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []


def test_query(spark, sf, duck):
    assert canonical(ip.op13_inner_products(spark, sf).toPandas()) == canonical(duck.execute(ip.OP13_SQL).df())
