"""Document fingerprints by context-triggered piecewise hashing, and their likeness."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Bytes of text hashed at a time, bytes that the rolling hash sees, size of the smallest blocks, most chunks of a signature.
BLOCK, REACH, SMALLEST, CHUNKS = 1 << 18, 8, 4, 64
#: Symbols in a row that two signatures must share to be like each other at all.
SHARED = 4
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
UNSTEP = pow(STEP, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spread(x: np.ndarray) -> np.ndarray:
    """Well-mixed 32-bit values."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return x ^ (x >> np.uint32(15))


UP, DOWN = powers(STEP, BLOCK + 1), powers(UNSTEP, BLOCK + 1)
SIGNS = spread(np.arange(1, 257, dtype=np.uint32) * np.uint32(0x9E3779B1))
A1, A2, A4 = np.uint32(0x01000193), np.uint32(pow(0x01000193, 2, 1 << 32)), np.uint32(pow(0x01000193, 4, 1 << 32))


def triggers(data: bytes, at: int) -> np.ndarray:
    """A hash of the last REACH bytes at each position of a block; zeros stand before the text."""
    own = np.frombuffer(data[max(0, at - REACH + 1) : at + BLOCK], np.uint8)
    x = SIGNS[own]
    if at == 0:
        x = np.concatenate([np.zeros(REACH - 1, np.uint32), x])
    x = x[1:] + x[:-1] * A1
    x = x[2:] + x[:-2] * A2
    return spread(x[4:] + x[:-4] * A4)


def fingerprint(data: bytes) -> str:
    """size:signature:signature at twice the size.

    A chunk ends where the rolling hash is a multiple of the block size; of the sizes SMALLEST * 2**k
    the first is taken that makes CHUNKS chunks or fewer, so that every byte counts in any text. Each chunk gives one of 64 digits.
    Blocks of the text are hashed one after the other; ends that are too many for a size are dropped on the way.
    """
    k, ends, levels, sums, carry, lift = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), 0, 1
    for at in range(0, len(data), BLOCK):
        r = triggers(data, at)
        hit = np.flatnonzero((r & np.uint32((SMALLEST << k) - 1)) == 0)
        own = np.frombuffer(data[at : at + BLOCK], np.uint8).astype(np.uint64) + np.uint64(1)
        total = np.cumsum(own * UP[: len(own)], dtype=np.uint64)
        low = r[hit].astype(np.int64)
        depth = np.where(low, np.log2((low & -low).clip(1)), 32).astype(np.int64) - 2  # the largest k that ends a chunk here
        ends, levels = np.append(ends, hit + at), np.append(levels, depth)
        sums = np.append(sums, total[hit] * np.uint64(lift) + np.uint64(carry))
        carry, lift = (carry + lift * int(total[-1])) & MASK, lift * int(UP[BLOCK]) & MASK
        while len(ends) >= CHUNKS:
            k += 1
            keep = levels >= k
            ends, levels, sums = ends[keep], levels[keep], sums[keep]
    return f"{SMALLEST << k}:{signature(ends, sums, carry, len(data))}:{signature(ends[levels > k], sums[levels > k], carry, len(data))}"


def signature(ends: np.ndarray, sums: np.ndarray, total: int, n: int) -> str:
    if not n:
        return ""
    if not len(ends) or ends[-1] < n - 1:
        ends, sums = np.append(ends, n - 1), np.append(sums, np.uint64(total))
    starts, before = np.append(0, ends[:-1] + 1), np.append(np.zeros(1, np.uint64), sums[:-1])
    back = DOWN[starts % BLOCK]
    if n > BLOCK:
        back = back * np.array([pow(int(DOWN[BLOCK]), int(s) // BLOCK, 1 << 64) for s in starts], np.uint64)
    h = (sums - before) * back * np.uint64(STEP)
    return DIGITS[(h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(58)].tobytes().decode()


RUN = re.compile(r"(.)\1{3,}")


def score(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) of two signatures over their length; 0 if they share no row of symbols."""
    if a == b:
        return 1.0
    a, b = RUN.sub(r"\1\1\1", a), RUN.sub(r"\1\1\1", b)
    n = min(SHARED, len(a), len(b))
    if not n or {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:  # the bits of a's longest common subsequence with b so far, all of a row at once
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1, from the signatures that two fingerprints have at a common block size; 0 if they have none."""
    if a == b:
        return 1.0
    (size_a, *sigs_a), (size_b, *sigs_b) = a.split(":"), b.split(":")
    if size_a == size_b:
        return max(score(x, y) for x, y in zip(sigs_a, sigs_b, strict=True))
    if int(size_a) == 2 * int(size_b):
        return score(sigs_a[0], sigs_b[1])
    return score(sigs_a[1], sigs_b[0]) if 2 * int(size_a) == int(size_b) else 0.0


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)
PART = T.StructType([*RESULT.fields, T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())])


def compared(doc_id: int | None, text: str, own: str, after: str, next_print: str) -> tuple:
    cut = len(text) // 3
    edited = (text[: len(text) - cut] + after[:cut]).encode()
    new = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, new, likeness(own, new), likeness(own, next_print)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row (doc_id, text); a null text is empty."""
    schema = T.StructType([RESULT["doc_id"], RESULT["fingerprint"]])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield doc_id, fingerprint((text.as_py() or "").encode())

    return common.map_rows(docs.select("doc_id", "text"), schema, rows)


def against_next(docs: DataFrame) -> DataFrame:
    """RESULT of each row: its fingerprint against that of its edited text and that of the next document.

    Next is by descending doc_id (nulls last, rows of one id by text); the first follows the last, and a single row itself. Rows are dealt
    by ranges of doc_id, so that all but the last row of each part find the next one beside them. First and
    last rows of the parts, two for each, meet in a join.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(order[0]).sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, weight, arrow = TaskContext.get().partitionId(), None, [], 0, to_arrow_schema(PART)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                own = fingerprint(text.encode())
                if last is None:
                    held.append((doc_id, None, None, own, None, None, None, "first", part, text))
                else:
                    held.append((*compared(*last, text, own), "done", part, None))
                weight += 600 + len(text) * (last is None)
                last = doc_id, text, own
                if weight >= common.BATCH_BYTES:
                    yield common.to_batch(held, arrow)
                    held, weight = [], 0
        if last is not None:
            held.append((last[0], None, None, last[2], None, None, None, "last", part, last[1]))
        if held:
            yield common.to_batch(held, arrow)

    found = common.written(dealt.mapInArrow(walk, PART), "fingerprints")
    first = found.where("kind = 'first'")
    parts = first.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part"))).alias("next_part"))
    after = first.select(F.col("part").alias("next_part"), F.col("text").alias("after"), F.col("fingerprint").alias("next_print"))
    edge = found.where("kind = 'last'").join(parts, "part").join(after, "next_part").select("doc_id", "text", "fingerprint", "after", "next_print")

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield compared(*row)

    return found.where("kind = 'done'").select(*RESULT.names).unionByName(common.map_rows(edge, RESULT, rows))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(common.table(spark, sf_dir, "documents"))
