import hashlib
import random

import pytest

from stockflow.llm import fingerprints as fp


def texts(seed, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 50, 400, 3000]))) for _ in range(n)]


def plain(data):
    """The fingerprint by one walk over the bytes, for a text of any length."""
    sign = lambda b: int(fp.SIGNS[b])
    window, ends = [0] * fp.REACH, []
    for at, b in enumerate(data):
        window = [*window[1:], sign(b)]
        h = sum(x * pow(0x01000193, fp.REACH - 1 - i, 1 << 32) for i, x in enumerate(window)) & 0xFFFFFFFF
        h = ((h ^ (h >> 16)) * 0x7FEB352D) & 0xFFFFFFFF
        ends.append(h ^ (h >> 15))
    k = 0
    while sum(r % (fp.SMALLEST << k) == 0 for r in ends) >= fp.CHUNKS:
        k += 1

    def signature(size):
        out, start = "", 0
        for at, r in enumerate(ends):
            if r % size == 0 or at == len(data) - 1:
                total = sum((data[i] + 1) * pow(fp.STEP, i - start + 1, 1 << 64) for i in range(start, at + 1)) & fp.MASK
                total = ((total ^ (total >> 29)) * 0xBF58476D1CE4E5B9) & fp.MASK
                out += chr(fp.DIGITS[total >> 58])
                start = at + 1
        return out

    return f"{fp.SMALLEST << k}:{signature(fp.SMALLEST << k)}:{signature(fp.SMALLEST << k + 1)}"


def test_against_a_plain_walk():
    for t in ["", "a", "aaaaaaaaaaaaaaaaaaaa", "\x00\x01", *texts(1, 12)]:
        assert fp.fingerprint(t.encode()) == plain(t.encode())


def test_blocks_do_not_show(monkeypatch):
    long = " ".join(texts(2, 60)).encode()
    whole = fp.fingerprint(long)
    monkeypatch.setattr(fp, "BLOCK", 1000)
    assert fp.fingerprint(long) == whole


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_score_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        b = "".join(c if rng.random() < 0.8 else rng.choice("abc") for c in a) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        x, y = fp.RUN.sub(r"\1\1\1", a), fp.RUN.sub(r"\1\1\1", b)
        got = fp.score(a, b)
        assert got == 1 or got == 0 or got == pytest.approx(1 - distance(x, y) / (len(x) + len(y)))


def test_likeness_of_edits():
    found = [t for t in texts(4, 60) if len(t) > 2000]
    near, far = [], []
    for t, other in zip(found, found[1:], strict=False):
        cut = len(t) // 3
        own = fp.fingerprint(t.encode())
        near.append(fp.likeness(own, fp.fingerprint((t[: len(t) - cut] + other[:cut]).encode())))
        far.append(fp.likeness(own, fp.fingerprint(other.encode())))
    assert min(near) > max(far) and sum(near) / len(near) > 0.5 and all(0 <= x <= 1 for x in near + far)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = (text[: len(text) - cut] + after[:cut]).encode()
        a, b, c = fp.fingerprint(text.encode()), fp.fingerprint(edited), fp.fingerprint(after.encode())
        out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_next_document(spark, n):
    rows = list(enumerate(texts(5, n)))
    if n > 2:
        rows[3], rows[4] = (3, None), (4, "é😀" * 7)
        rows.append((None, "last of all"))
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, part string")
    got = sorted((tuple(r) for r in fp.against_next(docs).collect()), key=str)
    assert got == brute(rows)


def test_repeated_rows(spark):
    rows = [(1, "b"), (1, "b"), (1, "a"), (2, "c")]
    assert fp.against_next(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
    assert fp.fingerprint_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().fingerprint == fp.fingerprint(b"")


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in fp.op5_fingerprints(spark, sf).collect()), key=str) == brute(rows)
