import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stockflow.llm import lm_score as lm


def base_by_hand(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i in words if not held[i] for w in [*words[i], None])
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for i, found in words.items():
        tokens = [*found, None]
        out[i] = (held[i], len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens))
    return out


def compare(rows, got):
    want = base_by_hand(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], abs=1e-6) and r.score < 0


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = lm.op7_lm_score(spark, sf).collect()
    compare(rows, got)
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    held = [r for r in got if r.held_out and size[r.doc_id] > 200]
    bits = sum(-r.score for r in held) * math.log2(10) / sum(size[r.doc_id] for r in held)
    assert bits < 2.8


def test_words_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog", None, "", "mat mat mat \x0b cat", "é É ß", "a " * 5000] + [f"word{i} the" for i in range(30)])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string")
    compare(rows, lm.score_texts(docs).collect())


def test_runs_of_words(monkeypatch):
    monkeypatch.setattr(lm.slices, "MOST", 40)
    rng = random.Random(3)
    texts = [b"".join(rng.choice([b"ab", b"c", b" ", b"\n", b"x" * 70, b"\xc3\xa9", b"  \t"]) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    got = [[] for _ in texts]
    for places, run, starts, ends, own in lm.runs_of(texts):
        first, kind = lm.slices.alike(np.frombuffer(run, np.uint8), starts, ends)
        each = [run[a:b] for a, b in zip(starts[first], ends[first])]
        assert len(set(each)) == len(each)
        for k, o, a, b in zip(kind, own, starts, ends):
            assert each[k] == run[a:b]
            got[places[o]].append(each[k])
    assert got == [t.split() for t in texts]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score_texts(spark.createDataFrame([(held, "only held out"), (None, None)], "doc_id long, text string")).where("doc_id is not null").first()
    assert row.train_tokens in (0, 1) and row.n_tokens == 4 and math.isfinite(row.base_score) and math.isfinite(row.score)


def odds_by_hand(texts, counted):
    """(bytes, predictors, 8) for each text, by counts of the bits of each context under its own bytes, none of them hashed."""

    def keys(data, at):
        word = at
        while word and data[word - 1] > 32:
            word -= 1
        return [data[at - k : at] for k in range(1, lm.LONGEST + 1)] + [b"w" + data[word:at]]

    whole = lambda t: b" " * lm.CONTEXT + lm.lowered(t) + bytes([lm.END])
    counts = [Counter() for _ in range(lm.PREDICTORS)]
    for data in map(whole, counted):
        for at in range(lm.CONTEXT, len(data)):
            for p, key in enumerate(keys(data, at)):
                for bit in range(9):
                    counts[p][key, bit, data[at] >> (8 - bit)] += 1
    out = []
    for data in map(whole, texts):
        x = np.empty((len(data) - lm.CONTEXT, lm.PREDICTORS, 8), np.int8)
        for at in range(len(x)):
            byte = data[at + lm.CONTEXT]
            for p, key in enumerate(keys(data, at + lm.CONTEXT)):
                for bit in range(8):
                    same, both = counts[p][key, bit + 1, byte >> (7 - bit)], counts[p][key, bit, byte >> (8 - bit)]
                    x[at, p, bit] = np.clip(np.rint((np.log(np.float32(same + lm.DELTA)) - np.log(np.float32(both - same + lm.DELTA))) * np.float32(lm.SCALE)), -127, 127)
        out.append(x)
    return out


def nats_by_hand(x, start):
    """One text, bit by bit: weights and the refining table follow at the ends of steps."""
    weights, came, seen, total = start.weights.astype(float), start.came.copy(), np.zeros(lm.GATES), 0.0
    for a, b in zip(lm.STEPS, lm.STEPS[1:]):
        slopes, fresh, read = np.zeros_like(weights), np.zeros_like(came), np.zeros(lm.GATES)
        for byte in x[a:b]:
            gate = np.count_nonzero(byte[2 : lm.LONGEST, 0])
            read[gate] += 1
            for bit in range(8):
                half = bit // 4
                dot = np.clip(weights[half, :, gate] @ byte[:, bit], -8, 8)
                p, bucket = 1 / (1 + np.exp(-dot)), round(dot * lm.FINE) + lm.BUCKETS // 2
                total -= np.log((p + came[half, bucket] / (came[half, bucket] + came[half, -1 - bucket])) / 2)
                slopes[half, :, gate] += (1 - p) * byte[:, bit]
                fresh[half, bucket] += 1
        seen += read
        came = came * np.minimum(1, lm.REMEMBERED / (came + came[:, ::-1])) + fresh
        weights += lm.SPEED / lm.SCALE / lm.SCALE / (1 + seen / lm.HALVED) * slopes
        if b >= len(x):
            return total


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def made_texts(n, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 200]))) for _ in range(n)]


def test_scores_by_hand(spark, monkeypatch):
    """Several groups, tables of several parts: the scores are those of counts under whole contexts."""
    monkeypatch.setattr(lm, "CHUNK", 4000)
    monkeypatch.setattr(lm, "SHARE", 1 << 12)
    monkeypatch.setattr(lm, "fitted_start", lambda texts: lm.Start())
    rows = list(enumerate([*made_texts(40), None, "", "Ünïcode 😀 text", "abc \t\n abc"]))
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    odds = odds_by_hand([t for _, t in rows], [t for i, t in rows if not held(i)])
    assert len(got) == len(rows)
    for (i, _), x in zip(rows, odds, strict=True):
        assert got[i] == pytest.approx(-nats_by_hand(x, lm.Start()) / math.log(10), rel=1e-4)


def test_nothing_is_learned_from_a_sample(spark):
    """Counts of all training texts are all that is learned: weights begin alike, whatever texts there are."""
    rows = list(enumerate(made_texts(30, seed=5)))
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    odds = odds_by_hand([t for _, t in rows], [t for i, t in rows if not held(i)])
    for (i, _), x in zip(rows, odds, strict=True):
        assert got[i] == pytest.approx(-nats_by_hand(x, lm.Start()) / math.log(10), rel=1e-4)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 2000)
    monkeypatch.setattr(lm, "fitted_start", lambda texts: lm.Start())
    rows = list(enumerate(made_texts(12, seed=9)))
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), piece=300).collect()}
    odds = odds_by_hand([t for _, t in rows], [t for i, t in rows if not held(i)])
    compare(rows, got.values())
    for (i, _), x in zip(rows, odds, strict=True):
        want = sum(nats_by_hand(x[at : at + 300], lm.Start()) for at in range(0, len(x), 300))
        assert got[i].score == pytest.approx(-want / math.log(10), rel=1e-4)


def test_next_byte_is_a_distribution():
    """The chances of all 256 values of a byte, each from its own bits, sum to 1 in any state of weights and table."""
    counted = ["the cat sat on the mat " * 3, "a cat on a mat", "the dog sat"]
    for before in (b"", b"the c", b"the cat sat on the mat " * 20):
        raw = [b" " * lm.CONTEXT + before + bytes([b]) for b in range(256)]
        odds = lm.local_odds([next(lm.pieces(lm.lowered(t))) for t in counted], [*raw, raw[0][:-1] if before else raw[0]])
        nats = {}
        for some, found, *_ in lm.read(raw, odds, lm.Start()):
            nats |= dict(zip(some, found, strict=True))
        rest = next(lm.read([raw[0][:-1]], odds, lm.Start()))[1][0] if before else 0.0
        assert sum(math.exp(rest - nats[b]) for b in range(256)) == pytest.approx(1, abs=1e-3)


def test_start_is_fitted():
    texts = made_texts(60)
    start = lm.fitted_start(texts)
    raw = [next(lm.pieces(lm.lowered(t))) for t in made_texts(80)[60:]]
    odds = lm.local_odds([next(lm.pieces(lm.lowered(t))) for t in texts], raw)
    cost = lambda s: sum(found.sum() for _, found, *_ in lm.read(raw, odds, s))
    assert cost(start) < cost(lm.Start()) and np.isfinite(start.weights).all()
    assert np.allclose(start.came + start.came[:, ::-1], 30)
    assert (lm.fitted_start([]).weights == lm.Start().weights).all() and np.isfinite(lm.fitted_start([""]).weights).all()


@pytest.mark.parametrize(("side", "read", "batch"), [(1, 70, 300), (7, 1, 5000), (64, 1 << 17, 1 << 18)])
def test_sizes_taken_at_once_change_no_score(monkeypatch, side, read, batch):
    """Steps are cut within runs of a gate, and look-ups between pieces: each piece's nats stay those of a reading bit by bit."""
    for name, size in (("SIDE_BY_SIDE", side), ("READ", read), ("BATCH", batch)):
        monkeypatch.setattr(lm, name, size)
    texts, others = made_texts(20, seed=6), [*made_texts(12, seed=7), "", "a", "Ünïcode 😀 text"]
    raw = [next(lm.pieces(lm.lowered(t))) for t in others]
    odds = lm.local_odds([next(lm.pieces(lm.lowered(t))) for t in texts], raw)
    nats = {}
    for some, found, *_ in lm.read(raw, odds, lm.Start()):
        nats |= dict(zip(some, found, strict=True))
    for i, x in enumerate(odds_by_hand(others, texts)):
        assert nats[i] == pytest.approx(nats_by_hand(x, lm.Start()), rel=1e-4)


def test_places_of_crowded_buckets(monkeypatch):
    """Numbers alone in their buckets are found uncompared, others by comparison."""
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 56, 3000, dtype=np.uint64))
    wanted = np.random.default_rng(3).integers(0, len(keys), 9000)
    assert (lm.Places(keys).of(keys[wanted]) == wanted).all()
    monkeypatch.setattr(lm.Places, "hashed", staticmethod(lambda x: x << lm.U(53)))  # eight buckets
    assert (lm.Places(keys).of(keys[wanted]) == wanted).all()


def test_numbers_of_bytes_by_hand():
    """Those of the six bytes before and the byte itself, and each once as scoring reads them: the ones that counting finds."""
    raw = [next(lm.pieces(lm.lowered(t))) for t in [*made_texts(20, seed=8), "", "a", " b\n\tc é"]]
    want = [int.from_bytes(r[at - lm.LONGEST : at + 1], "little") for r in raw for at in range(lm.CONTEXT, len(r))]
    assert lm.Bytes(raw).longest().tolist() == want
    assert lm.read_in(raw, lm.Bytes.longest).tolist() == sorted(set(want))
    assert (lm.read_in(raw, lm.Bytes.words) == lm.counted(raw, np.ones(len(raw), bool), lm.Bytes.words)[0]).all()


def test_names_tell_contexts_apart():
    x = np.arange(1 << 20, dtype=np.uint64) * np.uint64(0x9E3779B9) & lm.LOW48
    assert len(np.unique(lm.mixed(x))) == len(np.unique(x)) and lm.mixed(x).max() <= lm.LOW48


def test_rows_of_counts_and_odds_survive():
    rng = np.random.default_rng(1)
    found = np.unique(rng.integers(0, 1 << 56, 5000, dtype=np.uint64) & ~np.uint64(0xF << 8))
    counts = rng.integers(0, 1 << 33, len(found))
    back, times = lm.found_of((0, 0, 0, *lm.packed(found, counts)))
    assert (back == found).all() and (times == np.minimum(counts, (1 << 32) - 1)).all()
    odds = rng.integers(-60, 60, (777, 8)).astype(np.int8)
    odds[::3] = odds[::3, :1]
    assert (lm.odds_of(777, *lm.odds_packed(odds)) == odds).all()
