"""Packing of tokenized documents into sequences of a fixed length by minimum bin slack."""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import common, slices

CAPACITY = 1024
#: Most words in an encoder's cache; it starts anew beyond that. Most that it keeps from task to task.
CACHE_WORDS, KEPT_WORDS = 1 << 20, 1 << 19
LONG_WORD = 64
#: Code points below this are letters or not for all that know Unicode; marks that stand apart from the letters before them.
SIMPLE, MARKS = 0x250, set(",.;:?!")
#: Most rows of a table of sums that is broadcast, about 160 MB; a larger one is joined by an exchange.
BROADCAST_ROWS = 1 << 20
#: Bytes of texts whose words are looked up together.
RUN_BYTES = 1 << 21
#: White space of two or three bytes, as numbers, and the bytes that begin or end it.
WIDE = [int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 0x3001)) if c.isspace()]
IN_WIDE = np.isin(np.arange(256), [x for c in WIDE for x in (c & 255, c >> (8 if c < 1 << 16 else 16))])
#: task made the piece, after `own` others of that length.
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("own", T.LongType()),
    ]
)
#: ids are little-endian integers, as of Encoder.kind: 2 bytes each in a vocabulary of 65,536 ids or fewer, else 4.
PACKED = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), PIECES.fields[5]])


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, as little-endian integers.

    A byte-level tokenizer starts a new word at each single space between characters that aren't white
    space, so that words can be encoded once and kept: each kind of word of a run of texts is looked up once. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        n = 1 + max(vocabulary.values())
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.starts = np.zeros(n, bool)
        self.starts[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True  # the sign of a leading space
        rules = json.loads(self.tokenizer.to_str())
        step = rules.get("pre_tokenizer") or {}
        self.by_word = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not rules.get("normalizer")
        if self.by_word:
            # the signs of bytes, and the model alone, for what needs no further cutting into words
            signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.signs = {i: signs.pre_tokenize_str(chr(i))[0][0] for i in range(SIMPLE) if i == 32 or not chr(i).isspace()}
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.forget()

    def forget(self) -> None:
        """No words are known. A word is known by its number: ids of words stand one after the other, and spans has where each word's begin and how many they are."""
        self.words: dict[bytes, int] = {}
        self.ids, self.spans, self.n_ids, self.n_words = np.empty(1 << 16, self.kind), np.empty((1 << 14, 2), np.int64), 0, 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def keep(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Adds words of these sizes, whose ids stand one after the other; the numbers of the words."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n_words + len(sizes) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.empty_like(self.spans)])
        new = range(self.n_words, self.n_words + len(sizes))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.spans[new.start : new.stop, 0] = self.n_ids + np.cumsum(sizes) - sizes
        self.spans[new.start : new.stop, 1] = sizes
        self.n_ids += len(ids)
        self.n_words = new.stop
        return new

    def learn(self, words: list[bytes]) -> None:
        """Words of letters after a space, perhaps with a mark at the end, go to the model as they are, other single words after a space through the whole
        tokenizer: many in one text, cut where an id begins with a space. What is left is encoded one by one."""
        letters, others = [], []
        for w in words:
            text = w.decode()
            if w[:1] == b" " and b" " not in w[1:] and len(w) <= LONG_WORD:
                body = text[1:-1] if text[-1] in MARKS else text[1:]
                (letters if body.isalpha() and max(body) < chr(SIMPLE) else others).append(text)
        for some, whole in ((letters, False), (others, True)):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                if whole:
                    ids = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids
                else:
                    apart = "\n".join(t[:-1] + "\n" + t[-1] if t[-1] in MARKS else t for t in part)
                    ids = self.model.encode_batch_fast([apart.translate(self.signs)], add_special_tokens=False)[0].ids
                ids = np.array(ids, self.kind)
                edges = np.append(np.flatnonzero(self.starts[ids]), len(ids))
                if len(edges) != len(part) + 1:
                    continue  # this tokenizer doesn't begin each word at its space: one by one, then
                self.words.update(zip(map(str.encode, part), self.keep(ids, np.diff(edges)), strict=True))
        for w in words:
            if w not in self.words:
                ids = self.plain(w.decode())
                self.words[w] = self.keep(ids, np.array([len(ids)]))[0]

    @staticmethod
    def cuts(run: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where words of a run begin: at the texts' begins, and at each single space with no white space beside it."""
        white = (run == 32) | (run >= 28) & (run < 32) | (run >= 9) & (run <= 13)
        single = np.zeros(len(run), bool)
        single[1:-1] = (run[1:-1] == 32) & ~white[:-2] & ~white[2:]
        maybe = np.flatnonzero(single)
        maybe = maybe[IN_WIDE[run[maybe - 1]] | IN_WIDE[run[maybe + 1]]]
        if len(maybe):  # perhaps beside white space of several bytes
            near = np.concatenate([np.zeros(3, np.uint8), run, np.zeros(3, np.uint8)])[maybe[:, None] + np.arange(7)].astype(np.int64)
            three = [near[:, i] << 16 | near[:, i + 1] << 8 | near[:, i + 2] for i in (0, 4)]
            two = [near[:, i] << 8 | near[:, i + 1] for i in (1, 4)]
            single[maybe[np.any([np.isin(x, WIDE) for x in (*two, *three)], axis=0)]] = False
        single[np.append(begins[1:], len(run)) - 1] = False  # a space at the end of a text goes with what stands before it
        single[begins] = True
        return np.flatnonzero(single)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        data = [t.encode() for t in texts]
        out, held, weight = [], [], 0
        for x in data:
            if held and weight + len(x) > RUN_BYTES:
                out += self.ids_of(held)
                held, weight = [], 0
            held.append(x)
            weight += len(x)
        return out + self.ids_of(held)

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        full = np.array([len(x) for x in texts], np.int64)
        raw = b"".join(texts)
        run, begins = np.frombuffer(raw, np.uint8), (np.cumsum(full) - full)[full > 0]
        if not len(run):
            return [np.empty(0, self.kind) for _ in texts]
        starts = self.cuts(run, begins)
        ends = np.append(starts[1:], len(run))
        first, kind = slices.alike(run, starts, ends)
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if self.n_words > CACHE_WORDS or self.n_ids > 16 * CACHE_WORDS:
            self.forget()
        known = list(map(self.words.get, words))
        if None in known:
            self.learn([w for w, k in zip(words, known, strict=True) if k is None])
            known = list(map(self.words.__getitem__, words))
        at, size = self.spans[known][kind].T
        ends_of = np.cumsum(size)
        ids = self.ids[np.arange(ends_of[-1]) + np.repeat(at - (ends_of - size), size)]
        stops = np.append(0, ends_of)[np.searchsorted(starts, np.cumsum(full))]
        for i in np.flatnonzero((ends - starts)[first] > LONG_WORD).tolist():
            del self.words[words[i]]
        return np.split(ids, stops[:-1])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget(path: str) -> None:
    """The encoder stays, without its words if they are many: few ones are of use to the next task."""
    if encoder.cache_info().currsize and encoder(path).n_words > KEPT_WORDS:
        encoder(path).forget()


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of each document: full sequences, then the remainder, all with their ids. A null text is empty, and has end_id alone."""

    made: defaultdict[tuple[int, int], int] = defaultdict(int)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        coder, task, attempt = encoder(tokenizer), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, len(ids_of), 512):
            part = [t or "" for t in texts[at : at + 512].to_pylist()]
            for doc_id, ids in zip(ids_of[at : at + 512], coder.encode(part), strict=True):
                ids = np.append(ids, coder.kind.type(end_id))
                wide, n = memoryview(ids.astype("<u4").tobytes()), len(ids)
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    own = made[attempt, length]
                    made[attempt, length] += 1
                    yield doc_id, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, ids[start : start + length].tobytes(), task, own

    return common.map_rows(docs.select("doc_id", "text"), PIECES, rows, lambda r: 60 + len(r[5]), lambda: forget(tokenizer))


def best_fill(counts: list[int], target: int) -> dict[int, int]:
    """The multiset of lengths whose sum is closest to target from below: length -> copies.

    Bit s of `reach` is set if some lengths so far sum to s; the copies come from the way back.
    """
    reach, layers, mask, full = 1, [], (1 << (target + 1)) - 1, 1 << target
    for length in range(min(target, len(counts) - 1), 0, -1):
        if left := min(counts[length], target // length):
            layers.append((length, reach))
            k = 1
            while left:
                k = min(k, left)
                reach |= (reach << (length * k)) & mask
                left -= k
                k *= 2
            if reach & full:
                break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        copies = 0
        while not before >> total & 1:
            total -= length
            copies += 1
        if copies:
            used[length] = copies
    return used


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Where each piece goes, by its length and its rank among those of that length.

    Rows (length, shift, first rank, ranks, part, first sequence, offset): of those pieces, the part that
    begins at shift goes to consecutive sequences, at offset. The longest piece left opens a sequence, and
    best_fill closes it; as many sequences are made alike as the lengths last for. If no multiset fills the
    window, the longest piece left over is cut to fill it. Only the last sequence of all may have slack.
    Works on at most `capacity` lengths and counts, whatever the corpus.
    """
    left = [0] * (capacity + 1)
    runs: dict[int, deque] = defaultdict(deque)
    for length, n in sorted(counts.items()):
        left[length] = n
        runs[length].append((length, 0, 0, n))  # length, shift, first rank, ranks
    plan, sequence = [], 0

    def take(length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        left[length] -= n
        while n:
            origin, shift, rank, have = runs[length].popleft()
            if have > n:
                runs[length].appendleft((origin, shift, rank + n, have - n))
            yield origin, shift, rank, min(have, n)
            n -= min(have, n)

    def put(length: int, part: int, n: int, offset: int) -> None:
        at = sequence
        for origin, shift, rank, have in list(take(length, n)):
            plan.append((origin, shift, rank, have, part, at, offset))
            at += have
            if part < length:
                runs[length - part].append((origin, shift + part, rank, have))
                left[length - part] += have

    longest = capacity
    while True:
        longest = max((x for x in range(capacity, 0, -1) if left[x]), default=0)
        if not longest:
            return plan
        left[longest] -= 1
        used = best_fill(left, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        slack = capacity - sum(x * n for x, n in used.items())
        cut = 0
        if slack:
            cut = next((x for x in range(capacity, 0, -1) if left[x] > used.get(x, 0)), 0)
        need = dict(used)
        if cut:
            need[cut] = need.get(cut, 0) + 1
        n = min(left[x] // k for x, k in need.items())
        offset = 0
        for x, k in sorted(used.items(), reverse=True):
            for _ in range(k):
                put(x, x, n, offset)
                offset += x
        if cut:
            put(cut, slack, n, offset)
        sequence += n


class Plan:
    """make_plan's rows, looked up by length, shift and rank."""

    def __init__(self, rows: list[tuple]):
        self.at: dict[tuple[int, int], tuple[list[int], list[tuple]]] = {}
        for row in sorted(rows):
            firsts, found = self.at.setdefault(row[:2], ([], []))
            firsts.append(row[2])
            found.append(row)

    def places(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(shift, part, sequence, offset) of each part of a piece."""
        shift = 0
        while shift < length:
            firsts, found = self.at[length, shift]
            _, _, first, _, part, sequence, offset = found[bisect.bisect_right(firsts, rank) - 1]
            yield shift, part, sequence + rank - first, offset
            shift += part


def ranked(found: DataFrame, sizes: DataFrame, label: str) -> DataFrame:
    """found with `rank`, from 0, among the rows of a length. sizes: n, the rows of each length that each task made.

    Those made by tasks before it, and those that its own task made before it, come before a row. So no ids are exchanged while the table of sums has at most
    BROADCAST_ROWS rows.
    """
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = common.written(base, label)
    return found.join(base.hint("broadcast" if base.count() <= BROADCAST_ROWS else "merge"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("own"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Packs documents (doc_id, text) into sequences; PACKED rows, one per piece, with its ids.

    Tokenizes once, into a table in the shared folder. The driver sees the number of pieces of each length only.
    Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    found = common.written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    sizes = common.written(found.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(make_plan(counts, capacity))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, start, length, crc, tokens, ids, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for shift, part, sequence, offset in plan.places(length, rank):
                if part < length:
                    own = np.frombuffer(ids, f"<u{len(ids) // length}")[shift : shift + part]  # 2 or 4 bytes an id, as Encoder.kind has it
                    yield doc_id, start + shift, part, zlib.crc32(own.astype("<u4").tobytes()), tokens, sequence, offset, own.tobytes()
                else:
                    yield doc_id, start, length, crc, tokens, sequence, offset, ids

    # full pieces apart: theirs is one sum for each task, a small table whatever the corpus
    full = F.col("length") == capacity
    placed = ranked(found.where(full), sizes.where(full), "full-before").unionByName(ranked(found.where(~full), sizes.where(~full), "rests-before"))
    return common.map_rows(placed.select(*PIECES.names[:6], "rank"), PACKED, rows, lambda r: 80 + len(r[7]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests of the pieces; their ids are in pack's rows."""
    return pack(common.table(spark, sf_dir, "documents"), default_tokenizer()).drop("ids")
