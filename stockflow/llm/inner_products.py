"""Exact search for the largest inner products: vectors by descending length, rotated, with partial sums bounded by Cauchy and Schwarz."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from . import common, whole

#: Results of a query; a query's vec_id is divisible by EVERY; units to one of a component.
TOP, EVERY, UNITS = 5, 50, 256
#: Vectors of a chunk, about; bands of lengths at most; queries that meet a chunk in one task, when thresholds are found first and afterwards.
CHUNK, BANDS, FIRST_GROUP, GROUP = 32_768, 256, 8_192, 262_144
#: Vectors and queries multiplied at once; pairs whose exact products are computed at once; share of a tile that is left from which the whole tile is multiplied.
TILE, QUERIES, PAIRS, DENSE = 4_096, 256, 32_768, 0.2
#: What sums of doubles may be wrong by, as a share of the product of lengths.
SLACK = 1e-9
#: Lengths from which squares leave the doubles: no bounds are taken then.
HUGE = 1e150
NONE = -(1 << 63)
VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("norm", T.DoubleType())])
HIT = T.StructType([T.StructField("query", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
MOMENT = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])


def vectors_of(df: DataFrame, units: int) -> DataFrame:
    """(row, vec_id, vector, norm) of the rows (vec_id, embedding) with a vector of finite components, as a written table. norm: its length, not too little."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ok, found = whole.floored(batch.column(1), units)
        ids = batch.column(0).to_pylist()
        for i, x in zip(np.flatnonzero(ok).tolist(), found, strict=True):
            yield ids[i], x.tobytes(), float(np.hypot.reduce(x) if whole.largest(x) > HUGE else np.sqrt((x * x).sum())) * (1 + SLACK)

    found = common.map_rows(df.select(F.col("vec_id").cast("long"), "embedding"), VECTOR, rows, lambda r: 40 + len(r[1]))
    return common.written(found.withColumn("row", F.monotonically_increasing_id()), "search-vectors")


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """The right singular vectors of all vectors, the one of the largest value first. Any rotation gives right results; this one makes the first sums large."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                x = np.frombuffer(b"".join(batch.column(0).slice(start, TILE).to_pylist()), np.float64).reshape(-1, size)
                x = x / max(1.0, whole.largest(x))
                total += x.T @ x
        i, j = np.triu_indices(size)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=MOMENT.names)

    moments, total = vectors.select("vector").mapInArrow(rows, MOMENT).groupBy("i", "j").agg(F.sum("value").alias("value")), np.zeros((size, size))
    for i, j, value in moments.collect():  # as many as two components have pairs
        total[i, j] = total[j, i] = value
    return np.linalg.eigh(total)[1][:, ::-1]


@dataclass
class Chunks:
    """Chunks numbered by descending length. A band of lengths has one or more, among which its vectors are dealt."""

    edges: list[float]  # descending: a vector's band is how many are above its norm
    firsts: list[int] = field(default_factory=list)  # first chunk of each band, and the number of chunks
    longest: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, vectors: DataFrame, rows: int, chunk: int) -> Chunks:
        n = min(BANDS, -(-rows // chunk))
        edges = vectors.agg(F.percentile_approx("norm", [1 - i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
        out = cls(sorted(set(edges), reverse=True))
        bands = {r["band"]: r for r in vectors.groupBy(out.band().alias("band")).agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}  # BANDS at most
        out.firsts = [0]
        for i in range(len(out.edges) + 1):
            out.longest.append(bands[i]["longest"] if i in bands else -1.0)
            out.firsts.append(out.firsts[-1] + (-(-bands[i]["n"] // chunk) if i in bands else 0))
        return out

    def band(self) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e > F.col("norm"))) if self.edges else F.lit(0)

    def chunk(self) -> Column:
        first = lambda i: F.element_at(F.array(*map(F.lit, self.firsts)), self.band() + i)
        return first(1) + F.pmod(F.xxhash64("row"), first(2) - first(1)).cast("int")

    def reach(self) -> Column:
        """How many chunks may hold a vector whose product with a query of length norm is `least`: those before the first band that is too short."""
        bands = F.array(*[F.struct(F.lit(longest).alias("longest"), F.lit(first).alias("chunks")) for longest, first in zip(self.longest, self.firsts[1:], strict=True)])
        far = F.filter(bands, lambda b: F.col("least").isNull() | (b["longest"] * F.col("norm") * (1 + SLACK) >= F.col("least")))
        return F.coalesce(F.array_max(F.transform(far, lambda b: b["chunks"])), F.lit(0))


class Chunk:
    """The vectors of a chunk by descending length, and rotated, with the lengths of what is left of them after so many coordinates."""

    def __init__(self, rows: list, ids: list, x: np.ndarray, norms: np.ndarray, turn: np.ndarray):
        order = np.argsort(-norms, kind="stable")
        self.rows, self.x, self.norms, self.turn = np.array(rows)[order], x[order], norms[order], turn
        self.unnamed = np.array([i is None for i in ids])[order]
        self.ids = np.array([i or 0 for i in ids], np.int64)[order]
        size = x.shape[1]
        self.cuts = sorted({max(1, size // 8), max(1, size // 4), max(1, size // 2), size})
        self.turned, self.rest = self.rotated(self.x)
        self.largest = whole.largest(x)

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = x @ self.turn
        left = np.sqrt(np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1])
        return turned, np.stack([left[:, c] if c < x.shape[1] else np.zeros(len(x)) for c in self.cuts], axis=1) * (1 + SLACK)

    def products(self, x: np.ndarray, y: np.ndarray, pairs: bool) -> np.ndarray:
        """Inner products of rows of x with those of y, each with each or with the one beside it. Exact; beyond 64 bits the nearest long."""
        if x.shape[1] * whole.largest(x) * whole.largest(y) < whole.EXACT:
            return ((x * y).sum(axis=1) if pairs else x @ y.T).astype(np.int64)
        x, y = whole.integers(x), whole.integers(y)
        out = (x * y).sum(axis=1) if pairs else x @ y.T
        return np.array([min(max(v, NONE + 1), whole.LONG) for v in out.ravel()], np.int64).reshape(out.shape)

    def search(self, rows: np.ndarray, q: np.ndarray, norms: np.ndarray, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, unnamed, id) of the `top` best for each query, of those that come to least. A row isn't its own result."""
        least, (turned, rest) = least.copy(), self.rotated(q)
        best = tuple(np.zeros(0, k) for k in (np.int64, np.int64, bool, np.int64))
        for start in range(0, len(self.x), TILE):
            part = slice(start, start + TILE)
            lengths = norms * self.norms[start] * (1 + SLACK)
            open_ = np.flatnonzero(lengths >= least)
            if not len(open_):
                break  # all that follow are shorter still
            which, place, score = self.tile(part, open_, q, turned, rest, norms, least, top)
            own = self.rows[start + place] == rows[which]
            which, place, score = which[~own], start + place[~own], score[~own]
            both = [np.concatenate(c) for c in zip(best, (which, score, self.unnamed[place], self.ids[place]), strict=True)]
            order = np.lexsort((both[3], both[2], -both[1], both[0]))  # scores are above NONE, so that they have a negative
            both = [c[order] for c in both]
            first = np.flatnonzero(np.append(True, both[0][1:] != both[0][:-1])) if len(order) else np.zeros(0, np.int64)
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            last = rank == top - 1
            least[both[0][last]] = np.maximum(least[both[0][last]], both[1][last])
            best = tuple(c[rank < top] for c in both)
        return best

    def tile(self, part: slice, open_: np.ndarray, q: np.ndarray, turned: np.ndarray, rest: np.ndarray, norms: np.ndarray, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in the tile, score) of pairs of open queries and the tile's vectors, all that come to least among them."""
        x, from_ = self.x[part], 0
        slack = norms[open_, None] * self.norms[part] * SLACK
        bar = least[open_].astype(np.float64)[:, None] - slack
        sums = np.zeros((len(open_), len(x)))
        bounded = (least[open_] > NONE).all() and max(norms[open_].max(), self.norms[part.start]) < HUGE
        for i, cut in enumerate(self.cuts if bounded else ()):  # without thresholds nothing can go
            sums += turned[open_, from_:cut] @ self.turned[part, from_:cut].T
            from_ = cut
            left = sums + rest[open_, i, None] * self.rest[part, i] >= bar
            if (n := np.count_nonzero(left)) <= DENSE * left.size:
                a, b = np.nonzero(left)
                for j in range(i + 1, len(self.cuts)) if n else ():
                    own = np.concatenate([(turned[open_[a[s : s + PAIRS]], from_ : self.cuts[j]] * self.turned[part][b[s : s + PAIRS], from_ : self.cuts[j]]).sum(axis=1) for s in range(0, len(a), PAIRS)] or [np.zeros(0)])
                    sums[a, b] += own
                    from_ = self.cuts[j]
                    stay = sums[a, b] + rest[open_[a], j] * self.rest[part][b, j] >= bar[a, b]
                    a, b = a[stay], b[stay]
                score = np.concatenate([self.products(q[open_[a[s : s + PAIRS]]], x[b[s : s + PAIRS]], True) for s in range(0, len(a), PAIRS)] or [np.zeros(0, np.int64)])
                good = score >= least[open_[a]]
                return open_[a[good]], b[good], score[good]
        score = self.products(q[open_], x, False)
        enough = top + 1  # its own row may be among them
        bar = np.maximum(least[open_], np.partition(score, -enough, axis=1)[:, -enough] if score.shape[1] > enough else NONE)
        a, b = np.nonzero(score >= bar[:, None])
        return open_[a], b, score[a, b]


def met(vectors: DataFrame, queries: DataFrame, groups: int, turn: np.ndarray, top: int) -> DataFrame:
    """HIT of queries (row, vector, norm, least, chunk) and the vectors (row, vec_id, vector, norm, chunk) of the same chunk.

    A task takes a chunk into memory and lets a group of its queries pass; chunks go to each group, queries once to each of their chunks.
    """
    columns = ["chunk", "group", "asks", "row", "vec_id", "vector", "norm", "least"]
    asked = queries.withColumns({"group": F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"), "asks": F.lit(True), "vec_id": F.lit(None).cast("long")})
    given = vectors.withColumns({"group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "asks": F.lit(False), "least": F.lit(None).cast("long")})
    cells = given.select(*columns).unionByName(asked.select(*columns)).repartition("chunk", "group").sortWithinPartitions("chunk", "group", "asks")
    size = len(turn)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk = None, [], None
        for batch in batches:
            for start, end in runs(batch):
                part = batch.slice(start, end - start)
                chunk_of, group, asks = (part.column(i)[0].as_py() for i in range(3))
                if (chunk_of, group) != key:
                    key, held, chunk = (chunk_of, group), [], None
                own, ids = part.column(3).to_numpy(), part.column(4).to_pylist()
                x, norms = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(-1, size), part.column(6).to_numpy()
                if not asks:
                    held.append((own, ids, x, norms))
                    continue
                if chunk is None and held:
                    chunk = Chunk(np.concatenate([h[0] for h in held]), [i for h in held for i in h[1]], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), turn)
                    held = []
                least = np.array([NONE if v is None else v for v in part.column(7).to_pylist()], np.int64)
                for s in range(0, len(own), QUERIES) if chunk else ():
                    some = slice(s, s + QUERIES)
                    which, score, unnamed, found = chunk.search(own[some], x[some], norms[some], least[some], top)
                    yield pa.record_batch([pa.array(own[some][which]), pa.array(found, pa.int64(), mask=unnamed), pa.array(score)], names=HIT.names)

    return cells.mapInArrow(rows, HIT)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Where rows of one chunk, group and kind begin and end."""
    keys = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3)])
    edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def best_products(df: DataFrame, is_query: Column | None = None, top: int = TOP, units: int = UNITS, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `top` largest inner products of each query among rows (vec_id, embedding) with all rows but itself.

    Components become floor(units * x). Equal scores stand by vec_id, a null one last. Every row for which is_query holds (vec_id divisible by EVERY, unless given) is a
    query, so that of rows that repeat each has its results, with the other one among them; results of queries of one vec_id have the same query_id. Left out are vectors that
    are null or have null or non-finite components, and those of another length than that of the smallest vec_id's (of one vec_id the longest). A score beyond 64
    bits counts as the nearest long. An empty table gives no rows.

    Vectors stand in chunks by descending length. All queries meet the longest chunk first, which gives them thresholds; then each meets those chunks that are
    long enough for its threshold. In a chunk, tiles come by descending length until all queries' thresholds are out of reach; a pair goes once its sum over the first
    rotated coordinates and the lengths of what is left can't come to the threshold; what stays is multiplied exactly.
    """
    rows = vectors_of(df, units)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.desc(F.octet_length("vector"))).select(F.octet_length("vector").alias("bytes")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if first is None or not first["bytes"]:
        return df.sparkSession.createDataFrame([], result)
    rows = rows.where(F.octet_length("vector") == first["bytes"])
    queries = rows.where(F.pmod("vec_id", F.lit(EVERY)) == 0 if is_query is None else is_query)
    n, n_queries = rows.count(), queries.count()
    turn, chunks = rotation(rows, first["bytes"] // 8), Chunks.of(rows, n, chunk)
    rows = rows.withColumn("chunk", chunks.chunk())
    groups = lambda size: max(1, -(-n_queries // size))
    hits = common.written(met(rows.where("chunk = 0"), queries.withColumns({"chunk": F.lit(0), "least": F.lit(None).cast("long")}), groups(FIRST_GROUP), turn, top), "search-first")
    known = hits.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") >= top, F.min("score")).alias("least"))
    asking = queries.join(known, "row", "left")
    asking = asking.withColumn("reach", chunks.reach()).where("reach > 1").withColumn("chunk", F.explode(F.expr("sequence(1, reach - 1)")))
    hits = hits.unionByName(met(rows.where("chunk > 0"), asking, groups(GROUP), turn, top)) if chunks.firsts[-1] > 1 else hits
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


def op13_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_products(common.table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH good AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
),
pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
"""
