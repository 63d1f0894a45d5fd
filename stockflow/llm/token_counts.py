"""Greedy word-piece counts of whole texts, by a longest-match automaton that builds no pieces."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from . import common

#: Most words in a task's memory of counts; it starts anew beyond that.
CACHE_WORDS = 1 << 18
LONG_WORD = 64
START = "Ġ"  # the byte-level sign of a space, with which each word begins
COUNTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("n_unknown", T.LongType())])


class Automaton:
    """Trie of a vocabulary with failure links, for greedy longest match in time linear in the word.

    pop[v]: how many pieces greedy match cuts off the string of node v before the rest is that of fail[v].
    fail[v] is -1 where greedy match has no piece to cut off. A piece is a tuple of symbols.
    A symbol that no piece begins with is skipped and counts as unknown.
    """

    def __init__(self, pieces: list[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        ends, self.depth = [False], [0]
        for piece in pieces:
            v = 0
            for c in piece:
                if (w := self.next[v].get(c)) is None:
                    w = self.next[v][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                    self.depth.append(self.depth[v] + 1)
                v = w
            ends[v] = v > 0
        self.ends = ends
        self.fail, self.pop = [-1] * len(self.next), [0] * len(self.next)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if ends[v]:
                    self.fail[v], self.pop[v] = 0, 1
                    continue
                z, pops = self.fail[u], self.pop[u]
                while z >= 0 and c not in self.next[z]:
                    pops += self.pop[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pop[v] = self.next[z][c], pops

    def count(self, symbols: tuple[str, ...] | list[str]) -> tuple[int, int]:
        """(pieces, unknown symbols) of a word. Each symbol is read once, but for those about an unknown one."""
        following, fail, pop, size = self.next, self.fail, self.pop, len(symbols)
        v = n = unknown = at = start = 0  # v's string is what lies from start to at
        while at < size or v:
            if at < size and (w := following[v].get(symbols[at])) is not None:
                v, at = w, at + 1
            elif v and fail[v] >= 0:
                n += pop[v]
                v = fail[v]
                start = at - self.depth[v]
            else:  # greedy match gets stuck in this string: cut its first piece off, or skip its first symbol
                longest = self.first_piece(symbols, start)
                n, unknown, start = n + (longest > 0), unknown + (longest == 0), start + (longest or 1)
                v, at = 0, start
            if not v:
                start = at
        return n, unknown

    def first_piece(self, symbols: tuple[str, ...] | list[str], start: int) -> int:
        v = longest = 0
        for i in range(start, len(symbols)):
            if (v := self.next[v].get(symbols[i], 0)) == 0:
                break
            if self.ends[v]:
                longest = i + 1 - start
        return longest


def byte_signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies: its own where it is printable, else from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level_vocabulary(path: str) -> list[tuple[str, ...]]:
    """The pieces of a byte-level tokenizers file: those that begin a word begin with START, the others go on within one."""
    with open(path) as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    return [tuple(token) for token in model["model"]["vocab"] if token not in special]


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(byte_level_vocabulary(path))


def count_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """n_words, n_pieces and n_unknown of each row (doc_id, text).

    Words are runs of characters other than space and U+0009-U+000D; a word is START, then its UTF-8 bytes. A null or empty text has 0 of each. Repeated rows count each for itself.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        machine, sign = automaton(vocabulary), byte_signs()
        if not hasattr(machine, "known"):
            machine.known = {}
        known = machine.known
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode().split()
            n = unknown = 0
            for word in words:
                if (got := known.get(word)) is None:
                    got = machine.count([START, *map(sign.__getitem__, word)])
                    if len(word) <= LONG_WORD:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        known[word] = got
                n += got[0]
                unknown += got[1]
            yield doc_id, len(words), n, unknown

    return common.map_rows(docs.select("doc_id", "text"), COUNTED, rows, lambda r: 40)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents, by a byte-level vocabulary."""
    import public_tokenizers

    return count_pieces(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
