import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import canonical

from stockflow.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, score string, a string, bundle int"


def brute(rows, least, percent=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score), every occurrence counted."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= percent * cand[p[i : i + k]]}
        found = []
        for p, a in cand.items():
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if p not in gone:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i % 3, t, lang, "x", "y", "z", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in co.collocations(docs, **how).collect())


def made(seed, n=400):
    """Texts with phrases of two to four words, in pieces, and one word in a third of all places."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "É", "ß", "x y"]
    phrases = [" ".join(rng.choices(words, k=rng.choice([2, 3, 3, 4]))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(["the", rng.choice(words), rng.choice(words).upper(), rng.choice(phrases)]) for _ in range(rng.randrange(0, 60))]
        out.append(("".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r\n", "\x0b", ";"]) for p in parts), rng.choice(["en", "en", None, "und", "", "DE"])))
    return out


@pytest.mark.parametrize("least", [3, 30, 300])
def test_against_brute_force(spark, least):
    rows = made(least) + [(None, "en"), ("", None), (" \t. ,", "fr"), ("a b a b a b a b " * 400, "en"), ("word", "en")]
    rows += rows[:20]
    assert found(spark, rows, least=least) == brute(rows, least)


def test_many_bundles_and_slices(spark, monkeypatch):
    monkeypatch.setattr(co, "SLICE_BYTES", 50)
    rows = made(7, 300) + [("one two three four. " * 500, "en"), ("five six " * 700, "en"), ("z" * 100_000, "en")]
    assert found(spark, rows, least=5, bundle_bytes=700) == brute(rows, 5)


def test_few_are_reported_and_ties_stand_by_bytes(spark):
    rows = [(f"{a} {b}", "en") for a, b in [("b", "c"), ("ä", "b"), ("a", "z"), ("a-", "x"), ("\U0001f600", "q"), ("￮", "q2")] for _ in range(4)]
    assert found(spark, rows, least=4, top=4) == brute(rows, 4, top=4)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None)]) == []


def test_sketch_never_counts_too_little():
    import numpy as np

    x = np.unique(np.random.default_rng(1).integers(0, 1 << 20, 5000)).astype(np.uint32)
    assert (co.unpacked(len(x), co.packed(x)) == x).all()
    assert (co.numbers(len(x), co.planes(x[::-1])) == x[::-1]).all()


def test_query(spark, sf, duck):
    assert canonical(co.op11_collocations(spark, sf).toPandas()) == canonical(duck.execute(co.OP11_SQL).df())
