import random

import public_tokenizers

from stockflow.llm import token_counts as tc


def greedy(word, pieces):
    """Longest piece first, symbol by symbol where no piece fits: (pieces, unknown)."""
    n = unknown = at = 0
    longest = max(map(len, pieces))
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if tuple(word[at : at + k]) in pieces), 0)
        n, unknown, at = (n + 1, unknown, at + size) if size else (n, unknown + 1, at + 1)
    return n, unknown


def test_against_greedy_match():
    rng = random.Random(7)
    for _ in range(60):
        pieces = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        machine = tc.Automaton(sorted(pieces))
        for _ in range(60):
            word = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
            assert machine.count(word) == greedy(word, pieces), (pieces, word)


def test_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces, signs = set(tc.byte_level_vocabulary(path)), tc.byte_signs()
    texts = [None, "", "  \t\n ", "the cat sat", "Straße naïve 東京 \x00", "x" * 5000, "aß" * 300 + " the", "the cat sat"]
    rows = [(i, t, "extra", 1) for i, t in enumerate(texts)] + [(None, "the", "extra", 1)]
    got = tc.count_pieces(spark.createDataFrame(rows, "doc_id long, text string, word string, n_words int"), path).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (("the" if r.doc_id is None else texts[r.doc_id]) or "").encode().split()
        found = [greedy([tc.START, *(signs[b] for b in w)], pieces) for w in words]
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(words), sum(f[0] for f in found), sum(f[1] for f in found))
    assert tc.count_pieces(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_query(spark, sf):
    got = tc.op2_token_counts(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got.where("n_words > 0 and n_pieces < n_words").count() == 0
