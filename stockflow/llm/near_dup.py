"""Near-duplicate documents: fast similarity sketches, banding, and links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Bands of a sketch and coordinates in each. At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**6)**42 < 3e-6.
BANDS, ROWS = 42, 6
CACHE_WORDS = 1 << 18
#: Buckets of so many members or fewer are tested pair by pair once they have met one leader; larger ones in blocks of at most so many
#: documents and shingles, once they have met two.
SMALL, BLOCK_DOCS, BLOCK_SHINGLES = 8, 512, 1_000_000
SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
U = np.uint64


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SEEDS = spread(np.arange(1, 4097, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
ODD = SEEDS | U(1)


class Words(dict):
    """64-bit hashes of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Words()


def forget() -> None:
    """No words are known: those of a task are of little use to the next one."""
    WORDS.clear()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of hashed shingles, sorted: runs of `words` words, A-Z lowered; fewer words are one shingle; none, no shingle.

    Words end at space and U+0009-U+000D only. Shingles are told apart by 64-bit hashes.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        return spread((h * ODD[: len(h)]).sum(keepdims=True) + U(len(h)))
    out = np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        out += spread(h[i : i + len(out)] + SEEDS[i])
        out *= ODD[words]
    return np.unique(spread(out))


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """A fast similarity sketch of a nonempty set; two sets agree in a coordinate with the probability of their similarity.

    In each of `size` rounds every item goes to one hashed bin. A bin keeps the least hash of the first round that reached it.
    Bins that are still empty then get one round each, in which all items go there: no coordinate stays empty.
    Rounds stop once all bins are full, after about size * ln(size) / len(items) of them.
    """
    bins, empty, done = np.zeros(size, np.uint64), np.ones(size, bool), 0
    while done < size and empty.any():
        rounds = min(size - done, max(1, 1024 // len(items)))
        h = spread(items[None, :] ^ SEEDS[done : done + rounds, None])
        place = (((h >> U(40)) * U(size)) >> U(24)).astype(np.int64).ravel()
        rank = ((np.arange(done, done + rounds, dtype=np.uint64)[:, None] << U(50)) | (h & U((1 << 50) - 1))).ravel()
        fresh = np.flatnonzero(empty[place])
        order = fresh[np.argsort(rank[fresh])[::-1]]
        bins[place[order]] = rank[order]  # the least of a bin comes last and stays
        empty[place[fresh]] = False
        done += rounds
    for b in np.flatnonzero(empty):
        bins[b] = (spread(items ^ SEEDS[size + b]) >> U(1)).min() | U(1 << 63)
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    mixed = (bins.reshape(BANDS, ROWS) * ODD[:ROWS]).sum(axis=1, dtype=np.uint64)
    return spread(mixed + SEEDS[:BANDS]).view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """SKETCH of each row (doc_id, text). No bands where there are no shingles."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            items = shingles(text.as_py(), words)
            bands = band_keys(sketch(items, BANDS * ROWS)) if len(items) else None
            yield doc_id, len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), bands

    return common.map_rows(docs.select("doc_id", "text"), SKETCH, rows, lambda r: 450, forget)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are alike enough; reads the texts of both. Written to the shared folder."""
    texts = docs.select("doc_id", "text")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        lately: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

        def items(doc_id: int, text: pa.StringScalar) -> np.ndarray:
            key = doc_id, xxhash.xxh3_64_intdigest(text.as_buffer() or b"")  # rows of one doc_id may have other texts
            if key not in lately:
                lately[key] = shingles(text.as_py(), words)
                if len(lately) > 16:
                    lately.popitem(last=False)
            lately.move_to_end(key)
            return lately[key]

        for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            x, y = items(a, text_a), items(b, text_b)
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                common_size = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common_size >= percent * (len(x) + len(y) - common_size):
                    yield a, b

    return common.written(common.map_rows(both, LINK, rows, lambda r: 16, forget).distinct(), "links")


def confirmed_in_blocks(open_: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members (key, doc_id, component, n_shingles) of one bucket that are in different components. Written to the shared folder.

    Buckets with the same leader are one group. Most of a group is joined already, in its main component, so the others meet each other
    and the main component's members. They do so in cells of two blocks each, so that a task holds two blocks at most, a document
    moves once for each cell and not for each pair, and only links come out.
    """
    first = F.min(F.struct(F.xxhash64("doc_id").alias("order"), F.col("doc_id").alias("lead"))).alias("first")
    leads = common.written(open_.groupBy("key").agg(first).select("key", "first.lead"), "block-leads")
    near = common.written(open_.join(leads, "key").select("lead", "doc_id", "component", "n_shingles").distinct(), "block-members")
    counts = near.groupBy("lead", "component").agg(F.count("*").alias("n"))
    main = common.written(counts.groupBy("lead").agg(F.max_by("component", F.struct("n", "component")).alias("main")), "block-main")
    sides = common.written(near.join(main, "lead").select("lead", "doc_id", "component", "n_shingles", (F.col("component") != F.col("main")).alias("minor")), "block-sides")
    needed = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = sides.groupBy("lead", "minor").agg(needed.alias("blocks")).groupBy("lead").agg(F.max(F.when(F.col("minor"), F.col("blocks"))).alias("minors"), F.max(F.when(~F.col("minor"), F.col("blocks"))).alias("mains"))
    dealt = sides.join(common.written(sizes.where("minors is not null"), "block-sizes"), "lead")
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("mains"))) + F.when(F.col("minor"), 0).otherwise(F.col("minors"))
    dealt = dealt.withColumn("block", block)
    cell = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    minors = F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)
    own = F.concat(F.array_distinct(F.transform(minors, lambda j: cell(F.least(F.col("block"), j), F.greatest(F.col("block"), j)))), F.transform(F.sequence(F.col("minors"), F.col("minors") + F.col("mains") - 1), lambda j: cell(F.col("block"), j)))
    cells = dealt.select("lead", "doc_id", "component", "block", F.explode(F.when(F.col("minor"), own).otherwise(F.transform(minors, lambda i: cell(i, F.col("block"))))).alias("cell"))
    rows = cells.select("lead", "cell.lo", "cell.hi", "block", "doc_id", "component").join(docs.select("doc_id", "text"), "doc_id")
    arrow = to_arrow_schema(LINK)

    def links(table: pa.Table) -> pa.Table:
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        ids, component, block = (np.array(table[c].to_pylist()) for c in ("doc_id", "component", "block"))
        sets = [shingles(t.as_py(), words) for t in table["text"]]
        size = np.array([len(x) for x in sets])
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts, has, found = np.cumsum(size) - size, np.zeros(len(names), bool), []
        for i in np.flatnonzero(block == lo):
            mine = codes[starts[i] : starts[i] + size[i]]
            has[mine] = True
            shared = np.add.reduceat(has[codes], starts, dtype=np.int64)
            has[mine] = False
            alike = (100 * shared >= percent * (size + size[i] - shared)) & (component != component[i]) & (block == hi)
            found += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in np.flatnonzero(alike)]
        forget()
        return pa.Table.from_batches([common.to_batch(sorted(set(found)), arrow)])

    return common.written(rows.groupBy("lead", "lo", "hi").applyInArrow(links, LINK).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of links (a, b): component is the least node that it is joined to.

    Rounds of large star and small star, written to the shared folder, until all links form stars about their least nodes. Least
    neighbours come from partial aggregates and go back in joins, of which Spark splits the partition of a node with very many links.
    """
    edges = common.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star")
    while not (edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("c")).distinct(), F.col("a") == F.col("c"), "left_semi").isEmpty()):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-least")
        large = common.written(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "star-large")
        least = common.written(large.groupBy("a").agg(F.min("b").alias("m")), "star-least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "star")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a row once that comes several times, so that k rows don't meet m as k * m pairs. Only rows of ids that recur are exchanged for it."""
    recurring = common.written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "recurring")
    if recurring.isEmpty():
        return docs
    return docs.join(recurring, "doc_id", "left_anti").unionByName(common.written(docs.join(recurring, "doc_id", "left_semi").distinct(), "once"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row (doc_id, text).

    Documents are linked if their shingle sets are alike by `percent` or more; component_id is the smallest doc_id that links
    reach. Documents without shingles, and those with a null doc_id, are linked with nothing. A document with equal
    set follows the one of smallest doc_id, so that copies make one class before anything is compared.

    Classes that share a band's bucket are candidates. A bucket of any size meets its leader first, a pair for each member. What that leaves in
    different components is tested pair by pair in a small bucket. A large one meets a second leader, and what is still open in it is
    tested in blocks. So a large group of near copies costs a few pairs a member, and no pair of a bucket goes untested
    unless its ends are joined already.
    """
    docs = docs.select("doc_id", "text")
    found = common.written(sketches(docs, words), "sketches")
    docs = without_repeats(docs, found)
    useful = found.where("n_shingles > 0 and doc_id is not null")
    classes = useful.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "n_shingles"), "doc_id").alias("own"))
    classes = common.written(classes.select("digest", "rep", "own.bands", "own.n_shingles"), "classes")
    members = classes.select(F.col("rep").alias("doc_id"), "n_shingles", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = common.written(members.join(common.written(shared, "buckets"), "key"), "members").distinct()
    tested, labels = None, docs.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(3):
        open_ = members.withColumn("component", F.col("doc_id"))
        if turn:
            known = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("known"))
            now = common.written(members.join(known, "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("known", "doc_id").alias("component")), "labelled")
            split = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").where(F.col("n") > (2 if turn == 1 else SMALL))
            open_ = common.written(now.join(common.written(split.select("key", "n"), "open-keys"), "key"), "open")
            if open_.isEmpty():
                break
        if turn == 2:
            new = confirmed_in_blocks(open_, docs, words, percent)
        else:
            large = open_.where(F.col("n") > SMALL) if turn else open_
            order = F.xxhash64("doc_id", "key") if turn else F.xxhash64("doc_id")  # other leaders in each bucket, the second time
            first = F.struct(order.alias("order"), F.col("doc_id").alias("lead"), F.col("component").alias("lead_component"))
            leads = common.written(large.groupBy("key").agg(F.min(first).alias("first")).select("key", "first.lead", "first.lead_component"), "leads")
            pairs = large.join(leads, "key").where("component <> lead_component").select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b"))
            if turn:
                small = open_.where(F.col("n") <= SMALL)
                other = small.select("key", F.col("doc_id").alias("b"), F.col("component").alias("component_b"))
                each = small.join(other, "key").where("doc_id < b and component <> component_b").select(F.col("doc_id").alias("a"), "b")
                pairs = pairs.unionByName(each).distinct().join(tested, ["a", "b"], "left_anti")
            tested = common.written(pairs.distinct(), "pairs")
            new = confirmed(tested, docs, words, percent)
        if not new.isEmpty():
            labels = components(new.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))  # what is joined already comes as stars
    class_of = classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    rows = found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(common.written(class_of, "class-of"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, text, and any others) but those whose document has a near duplicate of smaller doc_id among those linked to it.

    Rows of one doc_id stay or go together; those of a null one stay.
    """
    gone = common.fresh("gone", docs.columns)
    rejected = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(rejected, docs["doc_id"] == rejected[gone], "left_anti")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=2)
