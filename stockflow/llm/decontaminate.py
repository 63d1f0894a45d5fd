"""Benchmark passages in documents, also with small edits: pieces by pigeonhole, confirmed by bit-parallel edit distance."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

#: Edits allowed for a character of an item; characters of the shortest item that may have any; characters of items in one pass over the documents, about.
RATE, SHORTEST, BLOCK_CHARS = 0.08, 20, 4_000_000
LEAK = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("distance", T.LongType()),
        T.StructField("budget", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def plain(text: str | None) -> str:
    """Lowered, white space as single spaces."""
    return " ".join((text or "").lower().split())


def budget_of(item: str, rate: float) -> int:
    """Edits allowed; none in an item under SHORTEST characters."""
    return int(len(item) * rate) if len(item) >= SHORTEST else 0


def pieces(item: str, budget: int) -> list[tuple[str, int]]:
    """budget + 1 pieces with their places: so many edits leave one of them whole."""
    edges = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(item[a:b], a) for a, b in zip(edges, edges[1:], strict=False)]


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word goes on before start or after end."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


class Pattern:
    """An item for Myers' algorithm: a bit for each of its characters."""

    def __init__(self, item: str):
        self.size, self.where = len(item), defaultdict(int)
        for i, c in enumerate(item):
            self.where[c] |= 1 << i
        self.where = dict(self.where)

    def nearest(self, text: str, least: int) -> tuple[int, int]:
        """(distance, end) of the stretch of text nearest to the item, the first such; least + 1 and 0 if none is within least."""
        size, where = self.size, self.where
        mask, high = (1 << size) - 1, 1 << (size - 1)
        up, down, score, best, end = mask, 0, size, min(size, least + 1), 0
        for at, c in enumerate(text, 1):
            eq = where.get(c, 0)
            across = (((eq & up) + up) ^ up) | eq | down
            more, less = down | (~(across | up) & mask), up & across
            if more & high:
                score += 1
            elif less & high:
                score -= 1
            more, less = more << 1 & mask, less << 1 & mask
            up, down = less | (~((eq | down) | more) & mask), more & (eq | down)
            if score < best:
                best, end = score, at
        return best, end


class Finder:
    """All items of a block, by one automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(item_id, Pattern(text), budget_of(text, rate)) for item_id, text in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            for piece, at in pieces(text, budget_of(text, rate)):
                places[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def leaks(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, budget, end) of each item within its budget: its nearest stretch, the first of equal ones."""
        if not self.automaton:
            return
        starts: dict[int, list[int]] = defaultdict(list)
        for last, (size, found) in self.automaton.iter(text):
            for i, at in found:
                if self.items[i][1].size >= SHORTEST or whole_words(text, last + 1 - size, last + 1):
                    starts[i].append(last + 1 - size - at)
        for i, found in starts.items():
            item_id, pattern, budget = self.items[i]
            if pattern.size < SHORTEST:
                yield item_id, 0, 0, found[0] + pattern.size
                continue
            best, end = budget + 1, 0
            for low, high in self.windows(sorted(set(found)), budget, pattern.size, len(text)):
                distance, at = pattern.nearest(text[low:high], best - 1)
                if distance < best:
                    best, end = distance, low + at
            if best <= budget:
                yield item_id, best, budget, end

    @staticmethod
    def windows(starts: list[int], budget: int, size: int, n: int) -> Iterator[tuple[int, int]]:
        """Stretches that hold every match that begins near the starts; those that overlap are one."""
        low = high = None
        for s in starts:
            a, b = max(0, s - budget), min(n, s + size + budget)
            if high is None or a > high:
                if high is not None:
                    yield low, high
                low, high = a, b
            else:
                high = max(high, b)
        if high is not None:
            yield low, high


def item_blocks(benchmark: DataFrame, block_chars: int, least: int = 1) -> Iterator[list[tuple[int, str]]]:
    """The items of `least` characters or more, by their plain text, in blocks of about block_chars characters, dealt by hash: the driver holds a block at a time."""
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    rows = lambda batch: ((i, text) for i, text in zip(batch.column(0).to_pylist(), map(plain, batch.column(1).to_pylist()), strict=True) if len(text) >= max(1, least))
    items = common.written(common.map_rows(benchmark.select(F.col("item_id").cast("long"), "text"), schema, rows, lambda r: 50 + 4 * len(r[1])), "benchmark-items")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // block_chars)
    for block in range(n):
        yield sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).toLocalIterator())


FINDERS: dict[str, Finder] = {}


def finder(name: str, block: Broadcast, rate: float) -> Finder:
    """A block's automaton, made once in each worker and kept until the next block comes."""
    if name not in FINDERS:
        FINDERS.clear()
        FINDERS[name] = Finder(block.value, rate)
    return FINDERS[name]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, least: int = 1) -> DataFrame:
    """LEAK for each document (doc_id, text) and item (item_id, text) of which it holds a stretch within the item's edit budget.

    Letters are lowered and white space is one space, in both; the budget is rate times the item's length. Items under SHORTEST characters are found
    as they are, as whole words, without edits; those without a character, or with fewer than `least`, aren't looked for. Each document is read once for a block of items of
    bounded size, whole, whatever its length; no document meets another. Null and empty texts have no leak. Rows of an item_id that recur count each.
    """
    found = []
    for block in item_blocks(benchmark, block_chars, least):
        given = docs.sparkSession.sparkContext.broadcast(block)

        def rows(batch: pa.RecordBatch, name=uuid.uuid4().hex, given=given) -> Iterator[tuple]:
            own = finder(name, given, rate)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for leak in own.leaks(plain(text.as_py())):
                    yield doc_id, *leak

        found.append(common.written(common.map_rows(docs.select("doc_id", "text"), LEAK, rows, lambda r: 60), "leaks"))
        given.unpersist()
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], LEAK)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = 1) -> DataFrame:
    """Rows (doc_id, text, and any others) but those of documents with a leak; rows of one doc_id stay or go together.

    Where a benchmark has items that stand in clean documents too, single words and figures, `least` tells how many characters, as plain() gives them, one
    has to have to take a document away. Unless given, all do.
    """
    gone = common.fresh("gone", docs.columns)
    rejected = leaks(docs, benchmark, rate, least=least).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected[gone]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
