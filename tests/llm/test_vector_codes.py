import hashlib
import math
import random
from collections import defaultdict

import pytest
from conftest import canonical

from stockflow.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, of int, codes string"


def brute(rows, rounds=6, k=16, parts=8):
    """vec_id, code, error, label_error, digest of each row; plain Lloyd, every distance computed."""
    good = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: r[0])
    if not good:
        return []
    size = len(good[0][1]) // parts
    cut = [[v[p * size : p * size + size] for p in range(parts)] for _, v, _ in good]
    books = [[c[p] for c in cut[:k]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (d(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])].append(c[p])
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for (i, _, label), c in zip(good, cut, strict=True):
        codes = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d(c[p], books[p][codes[p]]) for p in range(parts))
        total[label] += error
        out.append((i, "".join(f"{x:02x}" for x in codes), error, label))
    return sorted((i, code, error, total[label], digest) for i, code, error, label in out)


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, label, "a", "b", 1, "c") for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in vc.with_errors(*vc.coded(table, **how)).collect())


def made(seed, n, size=16, spread=1.0, step=0.0):
    rng = random.Random(seed)
    value = lambda: rng.gauss(0, spread) if not step else rng.randrange(-3, 4) * step
    return [(i, [value() for _ in range(size)], rng.choice([None, 0, 1, 1, 1])) for i in rng.sample(range(10_000), n)]


def as_floats(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("rows", [made(1, 300), made(2, 400, step=0.0005), made(3, 5), made(4, 200, spread=1e4)], ids=["plain", "ties", "few", "large"])
def test_against_brute_force(spark, rows):
    rows = as_floats(rows)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = made(5, 100)
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 15, 1), (-3, [math.nan] * 16, 0), (-4, [math.inf] + [0.0] * 15, 0), (20_000, [0.0] * 16, None)]
    rows += [(30_000 + i, rows[0][1], 7) for i in range(150)]  # one vector in most rows
    rows = as_floats(rows)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows + [(50_000, [1.0] * 8, 1), (50_001, [], 1), (50_002, [1.0] * 15, 1)]) == brute(rows)


def test_copies_among_the_first_entries(spark):
    rows = as_floats([(i, [0.25] * 16, 1) for i in range(40)] + [(100 + i, [i / 64] * 16, 2) for i in range(40)])
    assert found(spark, rows) == brute(rows)


def test_beyond_sixty_four_bits(spark):
    rows = as_floats([(i, [1e30 * (i % 7 - 3)] * 8 + [0.5 * i] * 8, i % 2) for i in range(40)])
    got, want = found(spark, rows), brute(rows)
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want]
    assert [r[2:4] for r in got] == [tuple(min(x, 2**63 - 1) for x in r[2:4]) for r in want]


def test_empty_and_unusable(spark):
    assert found(spark, []) == found(spark, [(1, None, 1), (2, [], 2)]) == []


def test_bounds_leave_most_distances_out(spark, monkeypatch):
    import numpy as np

    rng, tested = np.random.default_rng(3), []
    x = np.floor(np.concatenate([rng.normal(c, 30, (500, 8)) for c in rng.normal(0, 4000, (8, 8))]))
    entries = x[::500].tolist()
    part = vc.Part(entries, np.zeros(8))
    entry, upper, lower = part.assign(x, None, None, None)
    plain = vc.distances
    monkeypatch.setattr(vc, "distances", lambda a, b: tested.append(len(a)) or plain(a, b))
    again = part.assign(x, entry.copy(), upper.copy(), lower.copy())
    assert (again[0] == entry).all() and sum(tested) < len(x) / 10


def test_query(spark, sf, duck):
    assert canonical(vc.op12_vector_codes(spark, sf).toPandas()) == canonical(duck.execute(vc.OP12_SQL).df())
