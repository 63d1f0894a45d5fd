"""Scores of texts by logistic context mixing of bit predictors whose counts are a table that grows with the corpus, beside a smoothed unigram base."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common, slices

SPACES = [bytes([c]) for c in (*range(9, 14), 32)]
END = 0xFF  # no byte of UTF-8: the end of a text
#: Predictors: by the 1 to LONGEST bytes before, and by those of the word so far.
LONGEST = 6
PREDICTORS = LONGEST + 1
#: Stands in the predictor's place for whole words and their counts.
WHOLE = PREDICTORS
#: Sets of weights that a byte chooses from: one for each number of predictors beyond the second that know what stands before it.
GATES = LONGEST - 1
#: Bytes of context kept before a text or a piece of one; bytes of the pieces that a longer text is cut into; bytes of pieces mixed side by side, how many
#: of these are taken at once, and how many are looked up at once: few enough for a processor's own cache.
CONTEXT, PIECE, BATCH, SIDE_BY_SIDE, READ = 64, 1 << 19, 1 << 18, 1 << 12, 1 << 17
#: Bytes of texts whose contexts are looked up together; bytes of the corpus for each part of a predictor's table, and the most parts of the tables of short contexts.
CHUNK, SHARE, MOST_PARTS = 12 << 20, 1 << 24, {0: 1 << 5, 1: 1 << 8, 2: 1 << 11}
#: Count added to either side of a bit; steps of a log-odd in 1; start and speed of the weights, and after how many bytes that is halved.
DELTA, SCALE, WEIGHT, SPEED, HALVED = 0.1, 2.0, 0.25, 0.02, 64
#: Buckets of the table that refines probabilities, how many of them are 1 wide in log-odds, and the most that a bucket remembers.
BUCKETS, FINE, REMEMBERED = 25, 1.5, 400
#: Bytes of text that a task takes in at a time, and that it holds before it passes them on by groups.
PORTION, HELD_BYTES = 1 << 22, 1 << 25
#: Most tasks of an exchange; beyond that a task has several groups, or parts of tables, and takes them one at a time.
MOST_TASKS = 1 << 15

U = np.uint64
LOW48 = U((1 << 48) - 1)
BLOCK = 1 << 17
#: Times a byte: eight of it.
ALIKE = U(0x0101010101010101)


def step_ends() -> np.ndarray:
    """Where the bytes of a text are cut into steps: weights follow each of the first bytes alone, and later ones once an eighth more has been read."""
    ends = [0]
    while ends[-1] < PIECE:
        ends.append(ends[-1] + max(1, ends[-1] // 8))
    return np.array(ends)


STEPS = step_ends()
STEP_OF = (np.searchsorted(STEPS, np.arange(PIECE), side="right") - 1).astype(np.uint8)


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text and its END, size bytes at a time, each piece after the CONTEXT bytes before it; spaces stand before the first."""
    whole = b" " * CONTEXT + data + bytes([END])
    for at in range(CONTEXT, len(whole), size):
        yield whole[at - CONTEXT : at + size]


def mixed(x: np.ndarray) -> np.ndarray:
    """Other numbers below 2**48, each its own."""
    x = x ^ (x >> U(24))
    x = (x * U(0xD6E8FEB86659)) & LOW48
    x ^= x >> U(27)
    x = (x * U(0xA0761D6478BD)) & LOW48
    return x ^ (x >> U(25))


class Bytes:
    """The bytes of some pieces side by side, each but for the CONTEXT bytes that it stands after."""

    def __init__(self, raw: list[bytes]):
        stream = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(r) for r in raw], np.int64) - CONTEXT
        starts = np.cumsum(self.sizes + CONTEXT) - self.sizes - CONTEXT
        own = np.ones(len(stream), bool)
        own[(starts[:, None] + np.arange(CONTEXT)).ravel()] = False
        self.stream, self.own, self.starts, self.total = stream, own, starts, None

    def sums(self) -> np.ndarray:
        if self.total is None:
            self.total = slices.sums(self.stream)
        return self.total

    def longest(self) -> np.ndarray:
        """Each byte and the LONGEST before it in one number, the byte itself the highest."""
        padded = np.append(self.stream, np.zeros(8, np.uint8))
        runs = np.ndarray(len(self.stream), "<u8", padded, strides=(1,))  # at each byte, eight from there on
        return runs[:-LONGEST][self.own[LONGEST:]] & U((1 << 8 * (LONGEST + 1)) - 1)  # CONTEXT is longer, so that no piece's own bytes are cut

    def words(self) -> np.ndarray:
        """A hash of 48 bits of the word so far, and the byte that follows, in one number."""
        total = self.sums()
        starts = np.append(0, np.flatnonzero(self.stream[:-1] <= 32) + 1)
        runs = np.diff(starts, append=len(self.stream))
        context = total[:-1] - np.repeat(total[starts], runs)
        context *= np.repeat(slices.FALL[starts], runs)
        context ^= context >> U(29)
        context *= U(0xBF58476D1CE4E5B9)
        context >>= U(16)
        context <<= U(8)
        context |= self.stream
        return context[self.own]

    def whole_words(self) -> tuple[np.ndarray, np.ndarray]:
        """The name of each whole word (56 bits of slices.hashes), and the place of its piece."""
        starts, ends = slices.words(np.where(self.stream == END, np.uint8(32), self.stream))
        name = slices.spread((self.sums()[ends] - self.sums()[starts]) * slices.FALL[starts] + (ends - starts).astype(np.uint64)) >> U(8)
        return name, np.searchsorted(self.starts, starts, side="right") - 1


def batches_of(raw: list[bytes], most: int) -> Iterator[list[int]]:
    """Places of pieces of so many bytes together, the longest first."""
    held, weight = [], 0
    for i in sorted(range(len(raw)), key=lambda i: -len(raw[i])):
        if held and (weight + len(raw[i]) > most or len(held) == 4096):
            yield held
            held, weight = [], 0
        held.append(i)
        weight += len(raw[i])
    if held:
        yield held


def kinds_of(keys: np.ndarray) -> np.ndarray:
    """Numbers, ascending, each once. Sorts keys in place; looks through them a block at a time."""
    keys.sort()
    out = [keys[:1]]
    for at in range(1, len(keys), BLOCK):
        some = keys[at : at + BLOCK]
        out.append(some[some != keys[at - 1 : at - 1 + len(some)]])
    return np.concatenate(out)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, ascending, and how often each occurs with a 1 after it. Sorts keys in place; looks through them a block at a time."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    keys.sort()
    edges = [np.zeros(1, np.int64)]
    for at in range(1, len(keys), BLOCK):
        some = keys[at : at + BLOCK]
        edges.append(np.flatnonzero(some != keys[at - 1 : at - 1 + len(some)]) + at)
    edges = np.concatenate(edges)
    kinds, times = keys[edges], np.diff(edges, append=len(keys))
    times *= (kinds & U(1)).view(np.int64)
    kinds >>= U(1)
    first = np.flatnonzero(np.diff(kinds, prepend=~kinds[:1]))  # of a number without and with a 1
    return kinds[first], np.add.reduceat(times, first)


def counted(raw: list[bytes], train: np.ndarray, kind: Callable[[Bytes], np.ndarray], look_at: Callable[[Bytes, list[int]], None] = lambda read, some: None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a kind, Bytes.longest or Bytes.words, each with its occurrences in those pieces that train marks. look_at sees each batch, and the places of its pieces."""
    keys, at = np.empty(sum(map(len, raw)) - CONTEXT * len(raw), np.uint64), 0
    for some in batches_of(raw, READ):
        read = Bytes([raw[i] for i in some])
        end = at + int(read.sizes.sum())
        np.bitwise_or(kind(read) << U(1), np.repeat(train[some].astype(np.uint64), read.sizes), out=keys[at:end])
        look_at(read, some)
        at = end
    return distinct(keys)


def read_in(raw: list[bytes], kind: Callable[[Bytes], np.ndarray], look_at: Callable[[Bytes, list[int]], None] = lambda read, some: None) -> np.ndarray:
    """The distinct numbers of counted, without their occurrences."""
    keys = [np.zeros(0, np.uint64)]
    for some in batches_of(raw, READ):
        read = Bytes([raw[i] for i in some])
        keys.append(kinds_of(kind(read)))
        look_at(read, some)
    return kinds_of(np.concatenate(keys))


def shorter(longest: np.ndarray, counts: np.ndarray, placed: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For contexts of LONGEST bytes down to 1: the predictor, its distinct numbers, their counts, and, if placed, where each of `longest` is among them."""
    keys, place = longest, np.arange(len(longest), dtype=np.int32) if placed else None
    for k in range(LONGEST, 0, -1):
        if k < LONGEST:
            cut = keys >> U(8)
            new = np.diff(cut, prepend=~cut[:1]) != 0
            edges = np.flatnonzero(new)
            keys, counts = cut[edges], np.add.reduceat(counts, edges)
            place = (np.cumsum(new, dtype=np.int32) - 1)[place] if placed else None
        yield k - 1, keys, counts, place


def names(keys: np.ndarray, predictor: int) -> np.ndarray:
    """The 56-bit name of each context with its byte: contexts spread out, each under its own number, and then the byte. Those of words are their names."""
    if predictor >= LONGEST:
        return keys
    bits = U(8 * (predictor + 1))
    return mixed(keys & ((U(1) << bits) - U(1))) << U(8) | keys >> bits


class Places:
    """Where known numbers are in a list that has each once, by buckets of their hashes. Only in a bucket of several are they compared."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 2
        self.shift = U(64 - bits)
        h = self.hashed(keys)
        self.order = slices.ranked(h).astype(np.int32)
        self.keys = keys[self.order]
        bucket = (h[self.order] >> self.shift).view(np.int64)
        begin = np.flatnonzero(np.diff(bucket, prepend=-1))
        #: A bucket's one place, or where its several begin in `keys`, inverted. Empty buckets are never asked for.
        self.first = np.empty(1 << bits, np.int32)
        self.first[bucket[begin]] = np.where(np.diff(begin, append=len(keys)) == 1, self.order[begin], ~begin)

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        return (keys ^ (keys >> U(29))) * U(slices.GROW)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        at = self.first[(self.hashed(wanted) >> self.shift).view(np.int64)]
        several = np.flatnonzero(at < 0)
        wanted, near = wanted[several], ~at[several]
        open_ = np.flatnonzero(self.keys[near] != wanted)
        while len(open_):
            near[open_] += 1
            open_ = open_[self.keys[near[open_]] != wanted[open_]]
        at[several] = self.order[near]
        return at


#: What a row of TEXTS has: a text with the CONTEXT bytes before it and its END; a piece of a longer one's bytes; a stretch of a longer one's words.
TEXT, PIECE_OF, WORDS_OF = 0, 1, 2
TEXTS = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_parts", T.LongType()),
        T.StructField("what", T.IntegerType()),
        T.StructField("bytes", T.BinaryType()),
    ]
)
#: Texts of one of the groups of about CHUNK bytes that a corpus is dealt into: rows of TEXTS as a compressed stream.
BUNDLE = T.StructType([T.StructField("group", T.LongType()), T.StructField("texts", T.BinaryType())])
#: Names of a group in one part of a predictor's table, ascending: steps between contexts, bytes of each beyond the first, bytes, and occurrences in training texts. Compressed.
FOUND = T.StructType(
    [
        T.StructField("predictor", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("group", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("n_contexts", T.IntegerType()),
        T.StructField("contexts", T.BinaryType()),
        T.StructField("more", T.BinaryType()),
        T.StructField("bytes", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
    ]
)
#: The log-odds of the eight bits of each of those names, by the counts of the whole corpus; of whole words the counts, in `unlike`. Compressed.
ODDS = T.StructType([*FOUND.fields[:4], T.StructField("n_unlike", T.IntegerType()), *(T.StructField(x, T.BinaryType()) for x in ("unlike", "first", "steps"))])


def bundled(rows: list[tuple]) -> bytes:
    out, arrow = pa.BufferOutputStream(), to_arrow_schema(TEXTS)
    with pa.ipc.new_stream(out, arrow, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(common.to_batch(rows, arrow))
    return out.getvalue().to_pybytes()


def unbundled(bundles: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in bundles["texts"])


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch whose second column is text, some MB of it at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, side="right")))
        yield batch.slice(at, end - at)
        at = end


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bytes, all first bytes first: compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def packed(found: np.ndarray, counts: np.ndarray) -> tuple:
    """The last six fields of FOUND."""
    contexts = found >> U(8)
    first = np.flatnonzero(np.diff(contexts, prepend=~contexts[:1]))
    more = np.diff(np.append(first, len(found))) - 1
    return len(found), len(first), planes(np.diff(contexts[first], prepend=U(0)), 6), planes(more, 1), planes(found & U(255), 1), planes(np.minimum(counts, (1 << 32) - 1), 4)


def found_of(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Names and counts of a row of FOUND."""
    n, m, contexts, more, own, counts = row[3:]
    contexts = np.repeat(np.cumsum(unpacked(contexts, m, 6), dtype=np.uint64), unpacked(more, m, 1).astype(np.int64) + 1)
    return contexts << U(8) | unpacked(own, n, 1), unpacked(counts, n, 4).astype(np.int64)


def found_names(texts: DataFrame, bits: int) -> DataFrame:
    """FOUND of BUNDLE rows, for tables of 2**bits parts at most."""
    arrow = to_arrow_schema(FOUND)

    def find(bundles: pa.Table) -> pa.Table:
        group, rows = bundles["group"][0].as_py(), unbundled(bundles)
        data, what, train, out = rows["bytes"].to_pylist(), rows["what"].to_numpy(), ~np.array(rows["held_out"].to_pylist(), bool), []
        del rows

        def add(p: int, keys: np.ndarray, times: np.ndarray) -> None:
            name = names(keys, p)
            order = slices.ordered(name, 56) if p < LONGEST else slice(None)
            name, times, own = name[order], times[order], min(bits, MOST_PARTS.get(p, 1 << 30).bit_length() - 1)
            edges = np.searchsorted(name, np.arange(1, 1 << own, dtype=np.uint64) << U(56 - own)) if own else []
            edges = np.concatenate([[0], edges, [len(name)]]).astype(np.int64)
            for part in np.flatnonzero(np.diff(edges)):
                a, b = edges[part], edges[part + 1]
                out.append((p, int(part), group, *packed(name[a:b], times[a:b])))

        words = WholeWords(data, what)
        if len(of := words.of):
            raw = [data[i] for i in of.tolist()]
            for p, keys, times, _ in shorter(*counted(raw, train[of], Bytes.longest)):
                add(p, keys, times)
            add(LONGEST, *counted(raw, train[of], Bytes.words, words.look_at))
        name, row = words.all()
        add(WHOLE, *distinct(name << U(1) | train[row].astype(np.uint64)))
        return pa.Table.from_batches([common.to_batch(out, arrow)])

    return texts.groupBy("group").applyInArrow(find, FOUND)


def bit_odds(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of ascending names, the log-odds of each bit of the byte as it came, in steps of 1/SCALE: (names, 8)."""

    def sums(shift: int) -> np.ndarray:
        edges = np.flatnonzero(np.diff(found >> U(shift), prepend=~(found[:1] >> U(shift))))
        return np.repeat(np.add.reduceat(counts, edges), np.diff(np.append(edges, len(found))))

    out, all_of = np.empty((len(found), 8), np.int8), sums(8)
    for bit in range(8):
        same = sums(7 - bit)
        odds = np.log((same + DELTA).astype(np.float32)) - np.log((all_of - same + DELTA).astype(np.float32))
        out[:, bit] = np.clip(np.rint(odds * np.float32(SCALE)), -127, 127)
        all_of = same
    return out


def odds_packed(odds: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """How many rows have eight odds that aren't alike; which ones; the first of each row; and what each other adds to the one before it. Compressed, as the last fields of ODDS."""
    rows = np.ascontiguousarray(odds).view(np.uint64).ravel()
    unlike = rows != odds[:, 0].astype(np.uint8) * ALIKE
    some = np.diff(np.ascontiguousarray(rows[unlike].view(np.int8).reshape(-1, 8).T), axis=0)
    return some.shape[1], *(pa.compress(x.tobytes(), "zstd", asbytes=True) for x in (np.packbits(unlike), odds[:, 0], some))


def odds_of(n: int, m: int, unlike: bytes, first: bytes, steps: bytes) -> np.ndarray:
    """(n, 8) odds of what odds_packed gave."""
    unpack = lambda x, size, kind: np.frombuffer(pa.decompress(x, size, "zstd", asbytes=True), kind)
    first = unpack(first, n, np.uint8)
    out = first * ALIKE
    unlike = np.unpackbits(unpack(unlike, -(-n // 8), np.uint8), count=n).view(bool)
    some = np.concatenate([first[unlike].view(np.int8), unpack(steps, 7 * m, np.int8)]).reshape(8, m)
    out[unlike] = np.ascontiguousarray(np.add.accumulate(some, axis=0, dtype=np.int8).T).view(np.uint64).ravel()
    return out.view(np.int8).reshape(n, 8)


def looked_up(found: DataFrame, partitions: int, totals: int) -> DataFrame:
    """ODDS of FOUND. A part of a table is summed where it is looked up; a task holds one part at a time. How many whole words of a part occur in
    training texts is n of a row of group `totals`.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held, weight = to_arrow_schema(ODDS), [], 0
        for rows in runs(batches):
            each, counts = zip(*map(found_of, rows), strict=True)
            every = np.sort(np.concatenate(each))
            every = every[np.diff(every, prepend=~every[:1]) != 0]
            places, total = [np.searchsorted(every, x) for x in each], np.zeros(len(every), np.int64)
            for place, n in zip(places, counts, strict=True):
                total[place] += n  # a row has each name once
            whole = rows[0][0] == WHOLE
            odds = None if whole else bit_odds(every, total)
            if whole:
                held.append((*rows[0][:2], totals, int(np.count_nonzero(total)), 0, b"", b"", b""))
            for r, place in zip(rows, places, strict=True):
                held.append((*r[:4], *((0, planes(total[place], 6), b"", b"") if whole else odds_packed(odds[place]))))
                weight += 100 + sum(map(len, held[-1][-3:]))
                if weight >= common.BATCH_BYTES:
                    yield common.to_batch(held, arrow)
                    held, weight = [], 0
        if held:
            yield common.to_batch(held, arrow)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:2] != r[:2]:
                    yield rows
                    rows = []
                rows.append(r)
        if rows:
            yield rows

    return found.repartition(partitions, "predictor", "part").sortWithinPartitions("predictor", "part").mapInArrow(look, ODDS)


class Odds:
    """The log-odds that each predictor gives the bits of the bytes of some pieces. odds: for each predictor, those of its names, ascending; they are taken."""

    def __init__(self, longest: np.ndarray, words: np.ndarray, odds: list[np.ndarray]):
        self.longest, self.words = Places(longest), Places(words)
        self.table = np.empty((len(longest), 2, LONGEST), np.uint32)  # a byte's first four bits, of all predictors, before its last four
        for p, keys, _, place in shorter(longest, np.zeros(len(longest), np.int64), placed=True):
            own = np.empty(len(keys), np.uint64)
            own[slices.ordered(names(keys, p), 56)] = odds[p].view(np.uint64).ravel()
            odds[p] = None  # no longer needed, and large
            self.table[:, :, p] = own[place].view(np.uint32).reshape(-1, 2)
        # a byte's gate: how many contexts of more than two bytes training texts have, which their odds of the first bit tell
        self.gates = (self.table[:, 0, 2:] & np.uint32(255) != 0).sum(axis=1, dtype=np.uint8)
        self.by_word = odds[LONGEST].view(np.uint64).ravel()

    def of(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces by size descending, the order of the bytes by step and gate; in that order, each one's step and gate in one number, and its places in table and by_word."""
        each = []
        for some in batches_of(raw, READ):
            read = Bytes([raw[i] for i in some])
            each.append((self.longest.of(read.longest()), self.words.of(read.words()), *(STEP_OF[:n] for n in read.sizes.tolist())))
        longest, words = (np.concatenate([x[i] for x in each]) for i in range(2))
        at = np.concatenate([step for x in each for step in x[2:]]).astype(np.uint16)
        at *= np.uint16(GATES)
        at += self.gates[longest]
        order = np.argsort(at, kind="stable")
        return order, at[order], longest[order], words[order]

    def put(self, longest: np.ndarray, words: np.ndarray, out: np.ndarray) -> None:
        """(halves, PREDICTORS, bytes * 4) odds of the bytes at these places."""
        rows = np.empty((2, PREDICTORS, len(longest)), np.uint32)
        rows[:, :LONGEST] = self.table.take(longest, axis=0).transpose(1, 2, 0)
        rows[:, LONGEST] = self.by_word.take(words).view(np.uint32).reshape(-1, 2).T
        out[:] = rows.view(np.int8)


class Start:
    """The weights (halves of a byte, predictors, gates) and the counts of the refining table (halves, buckets) that every piece begins with."""

    def __init__(self):
        self.weights = np.full((2, PREDICTORS, GATES), WEIGHT / SCALE, np.float32)
        centre = (np.arange(BUCKETS) - BUCKETS // 2) / FINE
        self.came = np.tile(30 / (1 + np.exp(-centre)), (2, 1))


def mix(odds: Odds, raw: list[bytes], start: Start) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nats of each piece, pieces by size descending; their weights at the end, the bytes that each gate has had, and the refining tables.

    Pieces are read side by side, each on its own: all take their next step at once, and the bytes of a step stand by gate and piece. In a step a byte's bits are
    mixed by the weights of its piece and gate, and refined by how often bits of such odds have come in the piece; then weights and table follow
    what came. Log-odds are those of the bit that came, so ones and zeros are alike: a bucket and its mirror image sum to 1.
    Within a step, SIDE_BY_SIDE bytes at a time are taken from their odds to what they add to weights and table: few enough for a processor's own cache.
    """
    order, at, longest, words = odds.of(raw)
    n, sizes = len(raw), np.array([len(r) - CONTEXT for r in raw])
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    step, gate = np.divmod(at, np.uint16(GATES))
    which = doc * GATES + gate
    del order, gate
    weights = np.tile(start.weights, (1, 1, n))  # (2, PREDICTORS, n * GATES)
    came = np.tile(start.came, (n, 1)).ravel()  # (n * 2 * BUCKETS)
    seen, nats = np.zeros(n * GATES), np.zeros(n)
    edges = np.append(0, np.cumsum(np.bincount(step)))
    cuts = np.concatenate([np.arange(a, b, SIDE_BY_SIDE) for a, b in zip(edges, edges[1:], strict=False)])  # where what is taken at once begins
    new = np.empty(len(which), bool)  # where a piece's bytes of a gate begin
    np.not_equal(which[1:], which[:-1], out=new[1:])
    new[edges[:-1]] = True
    first = np.append(np.flatnonzero(new), len(which))
    groups = np.searchsorted(first, edges).tolist()  # each step's first
    both = new.copy()
    both[cuts] = True
    begins = np.flatnonzero(both)
    lengths, group = np.diff(begins, append=len(which)), np.cumsum(new[begins]) - 1
    del at, step, new, both
    taken = zip(cuts.tolist(), np.append(cuts[1:], len(which)).tolist(), *(np.append(x, len(begins)).tolist() for x in (np.searchsorted(begins, cuts), np.searchsorted(begins, cuts[1:]))), strict=False)
    half = (np.arange(2) * BUCKETS + BUCKETS // 2).astype(np.float32)[:, None]
    room = np.empty(8 * PREDICTORS * SIDE_BY_SIDE, np.float32)
    alive = n - np.searchsorted(sizes[::-1], STEPS, side="right")  # pieces with a byte after the step's begin
    for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        here, some, runs = int(alive[i]), which[first[groups[i] : groups[i + 1]]], np.diff(first[groups[i] : groups[i + 1] + 1])
        own, slopes, logs = weights[:, :, some], np.zeros((2, PREDICTORS, len(some)), np.float32), np.zeros(len(some))
        four = np.repeat(own, 4, axis=2).view(np.complex128)  # a weight for each bit of a half: 16 bytes that are moved as one
        row = (some // GATES * (2 * BUCKETS)).astype(np.float32)  # whole numbers of less than 2**24, so exact
        table = came[: here * 2 * BUCKETS].reshape(-1, BUCKETS)
        total = table + table[:, ::-1]
        chance, fresh = (table / total).astype(np.float32), np.zeros(table.size, np.int64)
        for c, d, v, w in itertools.islice(taken, -(-(b - a) // SIDE_BY_SIDE)):
            begin, each, l, r = begins[v:w] - c, lengths[v:w], group[v] - groups[i], group[w - 1] + 1 - groups[i]
            x = room[: 8 * PREDICTORS * (d - c)].reshape(2, PREDICTORS, -1)
            odds.put(longest[c:d], words[c:d], x)
            dot = np.einsum("hpk,hpk->hk", x, np.repeat(four[:, :, l:r], each, axis=2).view(np.float32))
            dot.clip(-8, 8, out=dot)
            bucket = np.rint(dot * np.float32(FINE))
            bucket += half
            bucket += np.repeat(row[l:r], each * 4)
            bucket = bucket.ravel().astype(np.int64)
            p = np.exp(np.negative(dot, out=dot), out=dot)
            p += 1
            np.reciprocal(p, out=p)
            refined = chance.take(bucket).reshape(2, -1)
            refined += p
            both = refined[0] * refined[1]
            both = both[0::2] * both[1::2]
            both = both[0::2] * both[1::2]
            logs[l:r] += np.add.reduceat(np.log(both * np.float32(1 / 256)), begin, dtype=np.float64)
            fresh += np.bincount(bucket, minlength=len(fresh))
            x *= np.subtract(1, p, out=p)[:, None]
            slopes[:, :, l:r] += np.add.reduceat(x, begin * 4, axis=2)
        np.subtract.at(nats, some // GATES, logs)
        table *= np.minimum(1, REMEMBERED / total)
        came[: here * 2 * BUCKETS] += fresh
        seen[some] += runs
        rate = (SPEED / SCALE / SCALE) / (1 + seen[some] / HALVED)
        weights[:, :, some] += rate * slopes
    return nats, weights.reshape(2, PREDICTORS, n, GATES), seen.reshape(n, GATES), came.reshape(n, 2, BUCKETS)


def read(raw: list[bytes], odds: Odds, start: Start) -> Iterator[tuple]:
    """What mix gives, batch by batch, after the places of the batch's pieces."""
    for some in batches_of(raw, BATCH):
        yield some, *mix(odds, [raw[i] for i in some], start)


def local_odds(counts_of: list[bytes], of: list[bytes]) -> Odds:
    """Odds for the bytes of some pieces by the counts of others."""
    train = np.arange(len(counts_of) + len(of)) < len(counts_of)
    longest, times = counted(counts_of + of, train, Bytes.longest)
    words, word_times = counted(counts_of + of, train, Bytes.words)
    odds = [None] * LONGEST + [bit_odds(words, word_times)]
    for p, keys, counts, _ in shorter(longest, times):
        name = names(keys, p)
        order = slices.ordered(name, 56)
        odds[p] = bit_odds(name[order], counts[order])
    return Odds(longest, words, odds)


def fitted_start(texts: list[str]) -> Start:
    """Where weights and table of a text end, on average, if two thirds of the texts are counted and the others read; read twice, the second time from there."""
    raw = [next(pieces(lowered(t))) for t in texts]
    counted_, others, start = [r for i, r in enumerate(raw) if i % 3], raw[::3], Start()
    if not counted_:
        return start
    odds = local_odds(counted_, others)
    for _ in range(2):
        total, weight, came = np.zeros((2, PREDICTORS, GATES)), np.zeros(GATES), np.zeros((2, BUCKETS))
        for _, _, weights, seen, tables in read(others, odds, start):
            total += (weights * seen).sum(axis=2)
            weight += seen.sum(axis=0)
            came += (tables - start.came).sum(axis=0)
        start.weights = np.where(weight > 0, total / np.maximum(weight, 1), start.weights).astype(np.float32)
        came = np.maximum(came, 0) + Start().came
        start.came = 30 * came / (came + came[:, ::-1])
    return start


SCORED = T.StructType([*TEXTS.fields[:4], T.StructField("n_words", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])


def runs_of(texts: list[bytes]) -> Iterator[tuple[list[int], bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in runs of about slices.MOST bytes: their places, the run, starts and ends of its words, and the place of each word's text among them.

    A text longer than that comes in several runs, cut at white space; only a word longer than that makes a longer run.
    """

    def whole(held: list[tuple[int, bytes]]) -> tuple:
        run = b"".join(x + b" " for _, x in held)
        starts, ends = slices.words(np.frombuffer(run, np.uint8))
        begins = np.cumsum([0] + [len(x) + 1 for _, x in held[:-1]])
        return [i for i, _ in held], run, starts, ends, np.searchsorted(begins, starts, side="right") - 1

    held, weight = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + slices.MOST - 1)
            if end < len(text):
                end = 1 + max(text.rfind(c, at, end) for c in SPACES) or min((text.find(c, end) + 1 or len(text) for c in SPACES))
            if held and weight + end - at + 1 > slices.MOST:
                yield whole(held)
                held, weight = [], 0
            held.append((i, text[at:end]))
            weight += end - at + 1
            at = end
    if held:
        yield whole(held)


class WholeWords:
    """Names of the whole words of TEXTS rows, and the row of each: of texts as batches of their bytes are looked at, of longer ones from their stretches."""

    def __init__(self, data: list[bytes], what: np.ndarray):
        self.data, self.what, self.of = data, what, np.flatnonzero(what != WORDS_OF)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]

    def look_at(self, read: Bytes, some: list[int]) -> None:
        name, own = read.whole_words()
        row = self.of[np.array(some)[own]].astype(np.int32)
        text = self.what[row] == TEXT
        self.found.append((name[text], row[text]))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        stretches = np.flatnonzero(self.what == WORDS_OF)
        for places, run, starts, ends, own in runs_of([self.data[i] for i in stretches.tolist()]):
            self.found.append((slices.hashes(np.frombuffer(run, np.uint8), starts, ends) >> U(8), stretches[np.array(places)[own]].astype(np.int32)))
        return tuple(map(np.concatenate, zip(*self.found, strict=True)))


def held_out(doc_id: str = "doc_id"):
    """A tenth of the documents, by a checksum of the id as text; a null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def score_texts(docs: DataFrame, piece: int = PIECE, start: Start | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row (doc_id, text).

    Learns from rows that aren't held out. Tokens are the words of the text, A-Z lowered, and an end. score is log10 of the
    probability of the lowered text's bytes and its end, so that those of all texts sum to 1 at most; a null text is empty. Repeated rows are
    counted and scored each; an empty table gives no rows.
    Counts of words and of contexts cover all training texts; texts meet them in joins by name. Contexts of up to LONGEST bytes are told apart
    exactly, words so far by 48 bits of a hash, whole words by 56. Weights begin as `start` has them, by default all alike, so that what is
    learned of the corpus are counts of all of it, and anew after `piece` bytes of a text, PIECE at most.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    begun, n_groups = start or Start(), max(1, -(-size // CHUNK))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, arrow, held, weight = TaskContext.get().partitionId() << 33, to_arrow_schema(BUNDLE), defaultdict(list), 0
        for batch in (part for whole in batches for part in portions(whole)):
            for doc_id, text, out, group in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                data = lowered(text.as_py())
                parts = [(TEXT, x) for x in pieces(data, piece)]
                if len(parts) > 1:
                    parts = [(PIECE_OF, x) for _, x in parts] + [(WORDS_OF, run) for _, run, *_ in runs_of([data])]
                for i, (what, part) in enumerate(parts):
                    held[(group + i) % n_groups].append((row, doc_id, out, len(parts), what, part))
                    weight += 100 + len(part)
                row += 1
            if weight >= HELD_BYTES:
                yield common.to_batch([(g, bundled(rows)) for g, rows in held.items()], arrow)
                held, weight = defaultdict(list), 0
        if held:
            yield common.to_batch([(g, bundled(rows)) for g, rows in held.items()], arrow)

    def score(bundles: pa.Table, odds: pa.Table) -> pa.Table:
        arrow = to_arrow_schema(SCORED)
        if not len(bundles):  # the group of totals
            return pa.Table.from_batches([common.to_batch([(-1, None, None, 0, 0, sum(odds["n"].to_pylist()), 0.0, 0.0)], arrow)])
        texts = unbundled(bundles)
        data, what = texts["bytes"].to_pylist(), texts["what"].to_numpy()
        texts = texts.drop_columns("bytes")
        own: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(PREDICTORS + 1)]
        for p, part, _, n, *some in zip(*(odds[f.name].to_pylist() for f in ODDS), strict=True):
            own[p].append((part, unpacked(some[1], n, 6).astype(np.int64) if p == WHOLE else odds_of(n, *some)))
        *own, counts = [np.concatenate([x for _, x in sorted(p, key=lambda x: x[0])]) if p else np.zeros(0, np.int64) for p in own]
        words, scores = WholeWords(data, what), np.zeros(len(data))
        if len(of := words.of):
            raw = [data[i] for i in of.tolist()]
            whole = Odds(read_in(raw, Bytes.longest), read_in(raw, Bytes.words, words.look_at), own)
            for some, nats, *_ in read(raw, whole, begun):
                scores[of[some]] = -nats / math.log(10)
        name, row = words.all()
        n = counts[slices.kinds(name)[1]]
        sums = (np.bincount(row, x, len(data)) for x in (np.ones(len(row)), n > 0, np.log10(n + 0.1)))
        n_words, n_known, base = next(sums).astype(np.int64), next(sums).astype(np.int64), next(sums)
        columns = [texts[f.name].combine_chunks() for f in SCORED.fields[:4]]
        return pa.Table.from_arrays([*columns, *map(pa.array, (n_words, n_known, base, scores))], schema=arrow)

    # rows that are alike in all are dealt by the task that reads them
    dealt = docs.withColumn("group", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_groups)))
    texts = dealt.mapInArrow(gather, BUNDLE).repartition(min(n_groups, MOST_TASKS), "group")  # moved once: Spark uses this exchange for both of its readers
    bits, least_tasks = max(0, (size // SHARE).bit_length()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    look_tasks = min(max(least_tasks, (PREDICTORS << bits) // 8), max(least_tasks, MOST_TASKS))
    odds = looked_up(found_names(texts, bits), look_tasks, n_groups).repartition(min(n_groups, MOST_TASKS), "group")
    scored = common.written(texts.groupBy("group").cogroup(odds.groupBy("group")).applyInArrow(score, SCORED), "scored")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_known", "base", "score")]
    cut = scored.where("n_parts > 1").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *sums)
    whole = scored.where("n_parts = 1").select(*cut.columns).unionByName(cut)
    known = scored.where("row = -1").agg(F.sum("n_known")).first()[0] or 0
    training = whole.where(~F.col("held_out")).agg(F.count("*").alias("texts"), F.sum("n_words").alias("words")).first()
    ends, total = training["texts"], training["texts"] + (training["words"] or 0)
    below = total + 0.1 * (known + (ends > 0) + 1)
    end = math.log10((ends + 0.1) / below)
    return whole.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_words") * F.lit(math.log10(below)) + F.lit(end)).alias("base_score"),
        "score",
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.table(spark, sf_dir, "documents"))
