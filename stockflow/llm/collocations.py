"""Phrases whose words stand together: count-min sketches find what may be frequent, a second pass counts it exactly, then it is scored and subsumed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Occurrences that make a phrase a candidate; words of the longest phrase; what a longer candidate needs of a shorter one's occurrences, in percent, to take
#: its place; phrases reported for each language; scale of scores.
LEAST, LONGEST, PERCENT, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Bytes of text in a bundle, and in a slice of a text that is split into words at once; counters of a sketch's row for each 16 words, as a power of two;
#: counters of a shard at least, and shards of a row at most.
BUNDLE_BYTES, SLICE_BYTES, SPARSE, SHARD, SHARDS = 4 << 20, 1 << 20, 2, 1 << 18, 4096
#: Bundles whose phrases are counted in one task, about, so that counts of one phrase meet there before they are exchanged.
COUNTED = 24
#: Rows of a sketch. The first takes the high bits of a phrase's hash, the second the low ones.
ROWS = 2
#: Separators of pieces all become one of them; tabs become spaces; A-Z are lowered.
PLAIN = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t" + bytes(range(65, 91)), b"." * 9 + b" " + bytes(range(97, 123)))
U = np.uint64
#: Texts as numbers of words, packed: so many ids, and so many bytes of words, which spaces part.
BUNDLE = T.StructType(
    [
        T.StructField("bundle", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("langs", T.ArrayType(T.StringType())),
        T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("words", T.BinaryType()),
        T.StructField("lang_of", T.BinaryType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
#: What a bundle has in a shard of a row of the sketch: n counters, by the gaps between them, and what it adds to each, as much as decides at most.
PART = T.StructType(
    [
        T.StructField("bundle", T.LongType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("gaps", T.BinaryType()),
        T.StructField("adds", T.BinaryType()),
    ]
)
KEPT = T.StructType(PART.fields[:-1])
COUNT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("n", T.LongType())])


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Ids(dict):
    """Numbers of the words of one language in a bundle, given as words come up."""

    def __init__(self, bundle: Bundle, lang: int):
        self.bundle, self.lang = bundle, lang

    def __missing__(self, word: bytes) -> int:
        words = self.bundle.words
        words.append(word)
        self.bundle.lang_of.append(self.lang)
        n = self[word] = len(words)
        return n


class Bundle:
    """Texts as numbers of words; 0 stands between pieces."""

    def __init__(self):
        self.words, self.lang_of, self.langs, self.n_words, self.ids, self.size = [], [], {}, [], [], 0

    def add(self, lang: str, piece: bytes) -> None:
        """piece: of a text, after PLAIN, cut where a piece ends."""
        if lang not in self.langs:
            self.langs[lang] = Ids(self, len(self.langs))
            self.langs[lang][b"."] = 0
            self.n_words.append(0)
        found = piece.replace(b".", b" . ").split(b" ")
        ids = np.fromiter(map(self.langs[lang].__getitem__, filter(None, found)), np.int32)
        self.ids += [ids, np.zeros(1, np.int32)]
        self.n_words[self.langs[lang].lang] += int(np.count_nonzero(ids))
        self.size += len(piece)

    def row(self, number: int) -> tuple:
        ids = np.concatenate(self.ids)
        ids = ids[(ids != 0) | np.append(ids[1:] != 0, False)]  # one 0 between pieces is enough
        words = b" ".join(self.words)
        return number, len(ids), len(words), list(self.langs), self.n_words, pa.compress(words, "zstd", asbytes=True), planes(np.array(self.lang_of)), planes(ids)


def slices(text: bytes) -> Iterator[bytes]:
    """A text, after PLAIN, cut at ends of pieces. A piece is never cut, whatever its length."""
    start = 0
    while start < len(text):
        end = text.find(b".", start + SLICE_BYTES)
        end = len(text) if end < 0 else end + 1
        yield text[start:end]
        start = end


def bundles(docs: DataFrame, bundle_bytes: int) -> DataFrame:
    """BUNDLE of rows (lang, text)."""
    arrow = to_arrow_schema(BUNDLE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, Bundle()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in slices((text.as_py() or "").encode().translate(PLAIN)):
                    held.add("und" if lang is None else lang, piece)
                    if held.size >= bundle_bytes:
                        yield common.to_batch([held.row(number)], arrow)
                        number, held = number + 1, Bundle()
        if held.ids:
            yield common.to_batch([held.row(number)], arrow)

    return docs.select("lang", "text").mapInArrow(rows, BUNDLE)


class Grams:
    """Hashes of the phrases at each place of a bundle's texts, and which of them count."""

    def __init__(self, n_ids: int, n_bytes: int, langs: list[str], words: bytes, lang_of: bytes, ids: bytes):
        self.langs, self.words = langs, pa.decompress(words, n_bytes, "zstd", asbytes=True).split(b" ") if n_bytes else []
        self.lang_of, self.ids = numbers(len(self.words), lang_of), numbers(n_ids, ids)
        seeds = [xxhash.xxh3_64_intdigest(lang.encode()) for lang in langs]
        own = np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[at]) for w, at in zip(self.words, self.lang_of.tolist(), strict=True)), np.uint64, len(self.words))
        self.hash = np.append(U(0), own)[self.ids]
        self.there = {1: self.ids != 0}
        self.hashes = {1: spread(self.hash)}

    def of(self, size: int) -> np.ndarray:
        if size not in self.hashes:
            self.hashes[size] = spread(self.of(size - 1)[:-1] + self.hash[size - 1 :] * U(0x9E3779B97F4A7C15) + U(size)) if len(self.ids) >= size else np.zeros(0, np.uint64)
        return self.hashes[size]

    def allow(self, size: int) -> None:
        """Phrases of this many words count where both that are a word shorter do."""
        shorter = self.there[size - 1]
        self.there[size] = shorter[:-1] & shorter[1:]

    def keep(self, size: int, bits: int, kept: list[np.ndarray]) -> None:
        """Those phrases stay whose counters are among kept, in every row."""
        places = np.flatnonzero(self.there[size])
        for row in range(ROWS):
            at = counters(self.of(size)[places], row, bits)
            found = np.searchsorted(kept[row], at)
            places = places[kept[row][np.minimum(found, len(kept[row]) - 1)] == at] if len(kept[row]) else places[:0]
        self.there[size] = np.zeros(len(self.there[size]), bool)
        self.there[size][places] = True

    def counts(self, size: int) -> Iterator[tuple]:
        """COUNT of the phrases of so many words that count."""
        places = np.flatnonzero(self.there[size])
        if not len(places):
            return
        key = self.of(size)[places]
        order = np.lexsort([*(self.ids[places + i] for i in range(size)), key])
        places = places[order]
        rows = np.stack([self.ids[places + i] for i in range(size)])
        first = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)))
        for *ids, n in zip(*rows[:, first].tolist(), np.diff(np.append(first, len(places))).tolist(), strict=True):
            yield self.langs[self.lang_of[ids[0] - 1]], b" ".join(self.words[i - 1] for i in ids).decode(), size, n


def counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes >> U(64 - bits)) if row == 0 else (hashes & U((1 << bits) - 1))).astype(np.uint32)


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed; a plane for each byte of a number."""
    return pa.compress(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def numbers(n: int, data: bytes) -> np.ndarray:
    found = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(found.T).view(np.uint32).ravel()


def packed(ascending: np.ndarray) -> bytes:
    """Ascending numbers by the gaps between them."""
    return planes(np.diff(ascending, prepend=np.uint32(0)))


def unpacked(n: int, data: bytes) -> np.ndarray:
    return np.cumsum(numbers(n, data), dtype=np.uint32)


def sketched(found: Grams, sizes: tuple[int, ...], number: int, bits: int, shard_bits: int, least: int) -> Iterator[tuple]:
    """PART of a bundle's sketch of its phrases of these sizes."""
    hashes = np.concatenate([found.of(s)[found.there[s]] for s in sizes])
    for row in range(ROWS):
        at, n = np.unique(counters(hashes, row, bits), return_counts=True)
        n = np.minimum(n, least)
        edges = np.searchsorted(at, np.arange((1 << bits - shard_bits) + 1, dtype=np.uint64) << U(shard_bits))
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[shard], edges[shard + 1]
            yield number, row, shard, int(hi - lo), packed(at[lo:hi] - np.uint32(shard << shard_bits)), planes(n[lo:hi])


def merged(parts: DataFrame, shard_bits: int, least: int) -> DataFrame:
    """KEPT: for each PART those of its counters that come to `least` or more over all bundles. A task holds one shard at a time."""
    arrow = to_arrow_schema(KEPT)

    def merge(table: pa.Table) -> pa.Table:
        total, rows = np.zeros(1 << shard_bits, np.int64), list(zip(*(table[c].to_pylist() for c in PART.names), strict=True))
        for *_, n, gaps, adds in rows:
            total[unpacked(n, gaps)] += numbers(n, adds)
        out = []
        for bundle, row, shard, n, gaps, _ in rows:
            at = unpacked(n, gaps)
            if len(at := at[total[at] >= least]):
                out.append((bundle, row, shard, len(at), packed(at)))
        return pa.Table.from_batches([common.to_batch(out, arrow)])

    return parts.groupBy("row", "shard").applyInArrow(merge, KEPT)


def kept_of(rows: list[dict] | None, shard_bits: int) -> list[np.ndarray]:
    """For each row of the sketch the counters that a bundle was told of, ascending."""
    out = []
    for row in range(ROWS):
        own = sorted((r["shard"], r["n"], r["gaps"]) for r in rows or () if r["row"] == row)
        out.append(np.concatenate([unpacked(n, gaps) + np.uint32(shard << shard_bits) for shard, n, gaps in own] or [np.zeros(0, np.uint32)]))
    return out


def frequent(docs: DataFrame, least: int = LEAST, bundle_bytes: int = BUNDLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of 1 to LONGEST words that occur `least` times or more, and (lang, n), n all its occurrences of words.

    Texts become bundles of numbered words, a written table. Each bundle sketches its phrases of one and two words; what it adds to a shard of counters goes
    there, is summed with what others add, and the bundle is told which of its own counters come to `least`. A sketch never counts too little, so that what is
    dropped is not frequent. Longer phrases, whose every two words have stayed, are sketched the same way. What is left is counted exactly, by its words.
    A sketch has a counter for about four words of the corpus, whatever its size, and is never in one place: what a bundle asks and is told is in
    proportion to the bundle, what a shard adds up in proportion to the shard.
    """
    found = common.written(bundles(docs, bundle_bytes), "collocation-bundles")
    words, n = found.agg(F.coalesce(F.sum("n_ids"), F.lit(0)), F.count("*")).first()
    bits = max(18, int(words >> SPARSE).bit_length())
    if bits > 32:
        raise ValueError("more than 2**36 words: take a wider hash of counters")
    shard_bits = max(SHARD.bit_length() - 1, bits - SHARDS.bit_length() + 1)
    columns = ["bundle", "n_ids", "n_bytes", "langs", "words", "lang_of", "ids"]

    def of(batch: pa.RecordBatch) -> Iterator[tuple[int, Grams, list]]:
        for i in range(batch.num_rows):
            number, *own = (batch.column(c)[i].as_py() for c in range(len(columns)))
            yield number, Grams(*own), [batch.column(c)[i].as_py() for c in range(len(columns), batch.num_columns)]

    def narrowed(grams: Grams, told: list) -> Grams:
        for sizes, rows in zip(((1, 2), (3, 4)), told, strict=False):
            for size in sizes:
                if size > 1:
                    grams.allow(size)
            kept = kept_of(rows, shard_bits)
            for size in sizes:
                grams.keep(size, bits, kept)
        return grams

    def first(batch: pa.RecordBatch) -> Iterator[tuple]:
        for number, grams, _ in of(batch):
            grams.allow(2)
            yield from sketched(grams, (1, 2), number, bits, shard_bits, least)

    def second(batch: pa.RecordBatch) -> Iterator[tuple]:
        for number, grams, told in of(batch):
            narrowed(grams, told).allow(3)
            grams.allow(4)
            yield from sketched(grams, (3, 4), number, bits, shard_bits, least)

    def last(batch: pa.RecordBatch) -> Iterator[tuple]:
        for _, grams, told in of(batch):
            narrowed(grams, told)
            for size in range(1, LONGEST + 1):
                yield from grams.counts(size)

    tasks, told = max(1, -(-n // COUNTED)), []

    def data() -> DataFrame:
        """Bundles with what they were told, those of a task together."""
        out = found.select(*columns).repartition(tasks, "bundle")
        for i, kept in enumerate(told):  # what is told of one bundle is bounded as it is
            out = out.join(kept.repartition(tasks, "bundle").groupBy("bundle").agg(F.collect_list(F.struct("row", "shard", "n", "gaps")).alias(f"told{i}")), "bundle", "left")
        return out

    for step in (first, second):
        parts = common.map_rows(data() if told else found.select(*columns), PART, step, lambda r: 80 + len(r[4]) + len(r[5]))
        told.append(common.written(merged(parts, shard_bits, least), "collocation-kept"))
    exact = common.map_rows(data(), COUNT, last, lambda r: 60 + 4 * len(r[1]))
    counts = exact.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    totals = found.select(F.explode(F.arrays_zip("langs", "n_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n_words").alias("n"))
    return common.written(counts, "collocation-counts"), common.written(totals, "collocation-totals")


def exactly(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of each phrase of two words or more, by the cut that gives the lowest score, the first such."""
    words = F.split("phrase", " ")
    cuts = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"(cast({SCALE} as decimal(18,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(38,0)) + r)"))
    return cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "size", "a", "low.l", "low.r", "low.score")


def subsumed(counts: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of candidates that lie in a longer one with enough of their occurrences."""
    longer = counts.where("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("words"))
    at = F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(words, i, k), ' '))))")
    inner = longer.select("lang", F.explode(F.array_distinct(at)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    both = counts.where("size > 1").join(inner, ["lang", "phrase"])
    return both.where(100 * exactly(F.col("longer")) >= percent * exactly(F.col("f"))).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each lang of rows (lang, text).

    A-Z are lowered; texts fall into pieces at . , ; : ! ? and U+000A-U+000D, pieces into words at spaces and tabs. A phrase is 2 to LONGEST words in a
    row within a piece that occur a >= least times; occurrences may overlap. Its score is floor(2000000 a / (l + r)) at the cut into a first part (l occurrences)
    and a rest (r) that makes it lowest, the first such. Phrases that lie in a longer one with `percent` or more of their occurrences go. Ties stand by a
    descending, then phrase by its bytes. A null lang is `und`, an empty one is itself; null and empty texts have no words; rows that repeat count each; an
    empty table gives no rows. Other columns are not read.
    """
    counts, totals = frequent(docs, least, bundle_bytes)
    best = scored(counts).join(subsumed(counts, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # of which each task keeps `top` before rows are exchanged
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH low AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM low),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM words),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM sizes),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scores AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, w, size, unnest(range(2, size)) AS k FROM cand WHERE size > 2),
inner_ AS (SELECT lang, a, unnest(list_transform(range(1, size - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM parts),
longer AS (SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.a IS NULL OR 100 * x.a < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
