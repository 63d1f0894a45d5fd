import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stockflow.llm import packing as pk


def best_by_hand(counts, target):
    sums = {0}
    for length, n in enumerate(counts):
        for _ in range(n if length else 0):
            sums |= {s + length for s in sums if s + length <= target}
    return max(sums)


def test_fill_is_the_best():
    rng = random.Random(1)
    for _ in range(200):
        counts = [rng.choice([0, 0, 1, 2, 5]) for _ in range(rng.randint(1, 25))]
        target = rng.randint(0, 60)
        used = pk.best_fill(counts, target)
        assert sum(x * n for x, n in used.items()) == best_by_hand(counts, target)
        assert all(0 < n <= counts[x] for x, n in used.items())


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    counts = {x: rng.choice([1, 2, 7, 40]) for x in rng.sample(range(1, 65), rng.randint(1, 30))}
    plan = pk.Plan(pk.make_plan(counts, 64))
    used = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            parts = list(plan.places(length, rank))
            assert sum(p[1] for p in parts) == length
            for _, part, sequence, offset in parts:
                used[sequence].append((offset, part))
    sizes = []
    for s in sorted(used):
        at = 0
        for offset, part in sorted(used[s]):
            assert offset == at
            at += part
        sizes.append(at)
    assert sorted(used) == [*range(len(used))] and max(sizes) <= 64 and sum(x < 64 for x in sizes) <= 1


def verify(spark, rows, got, capacity=pk.CAPACITY):
    """Pieces against plain calls of the tokenizer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pk.default_tokenizer())
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for (doc_id, ids), n in want.items():
        if n > 1 or sum(k[0] == doc_id for k in want) > 1:
            continue
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(x <= capacity for x in sizes) and sum(x < capacity for x in sizes) <= 1


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    verify(spark, rows, pk.op6_packing(spark, sf).collect())


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, " "), (3, "  two  spaces \n\t x "), (4, "<|endoftext|>"), (5, "日本語 😀 naïve"), (6, "w" * 20_000), (7, "a b " * 3000), (8, "same"), (8, "same"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, rank long, salt long")
    verify(spark, rows, pk.pack(docs, pk.default_tokenizer()).collect())
    assert pk.pack(docs.where("false"), pk.default_tokenizer()).count() == 0


def test_words_of_an_encoder_are_those_of_whole_texts():
    rng = random.Random(8)
    coder = pk.Encoder(pk.default_tokenizer())
    some = ["a", "b ", " c", "  ", " ", " ", "\n", "é", "'s", "12", ".", " the,", "y..", "Été", "ñandú! ", "\u0250", "ª", "x" * 70, "\u3000", "\x85", "\xa0", "\x1c", "€", "<|endoftext|>", " 日本", "—"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "a "]
    for text, raw in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(raw, coder.kind).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_sequences_can_be_built_from_the_rows(spark):
    """Whole texts come back from ids alone, those of full pieces and of cut ones too."""
    rows = [(i, "some words of a text " * n) for i, n in enumerate([1, 40, 300, 900, 5000, 7])] + [(6, None)]
    coder = pk.Encoder(pk.default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pk.pack(spark.createDataFrame(rows, "doc_id long, text string"), pk.default_tokenizer()).collect():
        ids = np.frombuffer(r.ids, coder.kind).tolist()
        assert len(ids) == r.length
        by_doc[r.doc_id].append((r.start, ids))
        by_sequence[r.sequence_id].append((r.offset, ids))
    for doc_id, text in rows:
        assert [i for _, ids in sorted(by_doc[doc_id]) for i in ids] == [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    assert sum(sum(len(ids) for _, ids in parts) < pk.CAPACITY for parts in by_sequence.values()) <= 1


@pytest.mark.parametrize("most", [pk.BROADCAST_ROWS, 10])
def test_ranks_of_each_length_are_gapless(spark, sf, monkeypatch, most):
    """Whether sums are broadcast, so that ids stay where they are, or too many for it and joined by an exchange."""
    monkeypatch.setattr(pk, "BROADCAST_ROWS", most)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(7)
    found = pk.common.written(pk.pieces(docs, pk.default_tokenizer(), capacity=64), "pieces")
    ranked = pk.ranked(found, found.groupBy("length", "task").agg(pk.F.count("*").alias("n")), "before")
    ranks = defaultdict(list)
    for r in ranked.select("length", "rank").collect():
        ranks[r.length].append(r["rank"])
    assert len(ranks) > 1 and found.count() == sum(map(len, ranks.values()))
    assert all(sorted(x) == [*range(len(x))] for x in ranks.values())
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (most > 10) and ("hashpartitioning" in plan) == (most == 10)
