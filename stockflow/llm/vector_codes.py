"""Vectors as codes of eight bytes: a codebook for each part, made by Lloyd's rounds with Elkan's bounds, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common, whole

#: Parts of a vector, entries of a codebook, rounds, units to one of a component; rows worked on at once.
PARTS, ENTRIES, ROUNDS, UNITS, AT_ONCE = 8, 16, 6, 4096, 8192
#: A vector on its way: its components as doubles; for each part the entry, a bound from above on the distance to it, and one from below on that to each entry.
STATE = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("vector", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("upper", T.BinaryType()),
        T.StructField("lower", T.BinaryType()),
    ]
)
#: What a batch adds to a position of an entry of a part: sum as decimal text, as it may pass 64 bits. Position -1 has the number of rows.
ADDED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("position", T.IntegerType()), T.StructField("sum", T.StringType())])
CODED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label", T.IntegerType())])


@dataclass
class Codebooks:
    """entries[part][entry][position], Python's integers; moved[part][entry]: how far an entry has come in the last round, at most."""

    entries: list[list[list[int]]]
    moved: np.ndarray

    @property
    def shape(self) -> tuple[int, int, int]:
        return len(self.entries), len(self.entries[0]), len(self.entries[0][0])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def after(self, sums: dict[tuple[int, int, int], int]) -> Codebooks:
        """Each entry at the floor of the mean of its rows; those without rows stay. sums: by part, entry and position."""
        entries, moved = [], np.zeros(self.shape[:2])
        for p, part in enumerate(self.entries):
            entries.append([])
            for e, entry in enumerate(part):
                n = sums.get((p, e, -1), 0)
                new = [sums.get((p, e, i), 0) // n for i in range(len(entry))] if n else entry
                entries[p].append(new)
                moved[p, e] = float(sum((a - b) ** 2 for a, b in zip(new, entry, strict=True))) ** 0.5
        return Codebooks(entries, moved)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to the rows of entries beside them: exact, as doubles or Python's integers."""
    if x.shape[-1] * (whole.largest(x) + whole.largest(entries)) ** 2 < whole.EXACT:
        return ((x - entries) ** 2).sum(axis=-1)
    return ((whole.integers(x) - whole.integers(entries)) ** 2).sum(axis=-1)


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Part:
    """One part's codebook, with what Elkan's tests need."""

    def __init__(self, entries: list[list[int]], moved: np.ndarray):
        self.entries = np.array(entries, dtype=np.float64)  # whole numbers that came from doubles, or means of such
        if whole.largest(self.entries) > whole.EXACT:
            self.entries = np.array([[int(x) for x in e] for e in entries], object)
        self.moved = moved
        k = len(entries)
        each = distances(np.repeat(self.entries, k, axis=0), np.tile(self.entries, (k, 1))).reshape(k, k)
        self.half = root(each) / 2

    def assign(self, x: np.ndarray, entry: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's nearest entry, the lowest of equal ones, with bounds.

        An entry goes untested only if it is strictly farther than the row's own one: by its bound from below, or as it is more than twice as far from
        the own entry. All others are compared by their exact squared distances. entry None: there are no bounds yet, all are compared.
        """
        n, k = len(x), len(self.entries)
        if entry is None:
            test, lower = np.ones((n, k), bool), np.zeros((n, k), np.float32)
            entry, upper = np.zeros(n, np.int64), np.full(n, np.inf, np.float32)
        else:
            upper = whole.up(upper.astype(np.float64) + whole.up(self.moved)[entry])
            lower = whole.down(np.maximum(lower.astype(np.float64) - whole.up(self.moved), 0))
            half, own = whole.down(self.half), np.arange(k) == entry[:, None]
            open_ = np.flatnonzero(((upper[:, None] >= lower) & (upper[:, None] >= half[entry]) & ~own).any(axis=1))
            near = whole.up(root(distances(x[open_], self.entries[entry[open_]])))  # the bound from above, made tight
            upper[open_] = np.minimum(upper[open_], near)
            test = np.zeros((n, k), bool)
            test[open_] = (upper[open_, None] >= lower[open_]) & (upper[open_, None] >= half[entry[open_]])
            test[open_, entry[open_]] = True
            alone = test.sum(axis=1) == 1
            test[alone] = False
        rows, which = np.nonzero(test)
        exact = distances(x[rows], self.entries[which])
        far = np.sqrt(exact.astype(np.float64))
        lower[rows, which] = whole.down(far)
        if len(rows):
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[of])
            hit = hit[np.append(True, of[hit][1:] != of[hit][:-1])]  # the lowest of those that tie
            entry[rows[hit]], upper[rows[hit]] = which[hit], whole.up(far[hit])
        return entry, upper, lower


def stepped(batch: pa.RecordBatch, parts: list[Part], fresh: bool) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_id, label, vectors, codes, upper, lower) of the rows of a STATE batch, assigned anew; AT_ONCE rows at a time."""
    k, p = len(parts[0].entries), len(parts)
    for start in range(0, batch.num_rows, AT_ONCE):
        some = batch.slice(start, AT_ONCE)
        read = lambda c, kind: np.frombuffer(b"".join(some.column(c).to_pylist()), kind)
        x = read(2, np.float64).reshape(some.num_rows, p, -1)
        if fresh:
            codes, upper, lower = np.zeros((len(x), p), np.uint8), np.zeros((len(x), p), np.float32), np.zeros((len(x), p, k), np.float32)
        else:
            codes, upper, lower = read(3, np.uint8).reshape(len(x), p).copy(), read(4, np.float32).reshape(len(x), p).copy(), read(5, np.float32).reshape(len(x), p, k).copy()
        for i, part in enumerate(parts):
            before = (None, None, None) if fresh else (codes[:, i].astype(np.int64), upper[:, i], lower[:, i])
            codes[:, i], upper[:, i], lower[:, i] = part.assign(np.ascontiguousarray(x[:, i]), *before)
        yield some.column(0).to_pylist(), some.column(1).to_pylist(), x, codes, upper, lower


def added(x: np.ndarray, codes: np.ndarray, sums: dict[tuple[int, int, int], int]) -> None:
    """Adds rows to sums by part, entry and position."""
    x = x if len(x) * whole.largest(x) < whole.EXACT else whole.integers(x)
    for p in range(x.shape[1]):
        for e in np.unique(codes[:, p]).tolist():
            own = x[codes[:, p] == e, p]
            for i, total in enumerate([len(own), *own.sum(axis=0).tolist()], -1):
                sums[p, e, i] = sums.get((p, e, i), 0) + int(total)


def prepared(vectors: DataFrame, units: int, parts: int) -> DataFrame:
    """STATE, without bounds, of the rows (vec_id, embedding, label) whose vector is made of finite components."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ok, found = whole.floored(batch.column(1), units)
        ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, x in zip(np.flatnonzero(ok).tolist(), found, strict=True):
            if len(x) and len(x) % parts == 0:
                yield ids[i], labels[i], x.tobytes(), None, None, None

    given = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("int"))
    return common.map_rows(given, STATE, rows, lambda r: 60 + len(r[2]))


def coded(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS, units: int = UNITS) -> tuple[DataFrame, Codebooks | None]:
    """CODED of rows (vec_id, embedding, label), and the codebooks.

    Components become floor(units * x). Each part's codebook starts as that part of the `entries` vectors of smallest vec_id; of rows with one vec_id that whose
    bytes are smallest comes first, a null one last; with fewer rows codebooks have fewer entries. Each round assigns every part to its nearest entry, ties
    to the lower one, and puts each entry at the floored mean of its parts. Left out are rows whose vector is null, has a null or non-finite component, or a
    length that is no multiple of `parts` or not that of the vector that comes first. An error beyond 64 bits counts as the largest long.
    Rows that repeat count each; an empty table has no codebooks.

    A round is one pass over a written table, that holds each row's bounds beside it; its sums of entries come from the rows that the same tasks write, are summed by
    Spark, and only they (a number for each entry's component) reach the driver. A round's table goes once the next is there.
    """
    spark, state, path = vectors.sparkSession, None, common.new_path(vectors.sparkSession, "codes-start")
    prepared(vectors, units, parts).write.parquet(path)
    state = spark.read.schema(STATE).parquet(path)
    seeds = state.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not seeds:
        return spark.createDataFrame([], CODED), None
    state = state.where(F.octet_length("vector") == len(seeds[0]["vector"]))
    seeds = state.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    first = np.stack([np.frombuffer(r["vector"], np.float64) for r in seeds]).reshape(len(seeds), parts, -1)
    books = Codebooks(whole.integers(first.transpose(1, 0, 2)).tolist(), np.zeros((parts, len(seeds))))
    for turn in range(rounds):
        out = common.new_path(spark, f"codes-{turn}")
        round_(state, books, fresh=turn == 0).write.parquet(out)
        done = spark.read.schema(T.StructType(STATE.fields + [T.StructField("sums", T.ArrayType(ADDED))])).parquet(out)
        sums = done.where("sums is not null").select(F.explode("sums").alias("x")).groupBy("x.part", "x.entry", "x.position").agg(F.sum(F.col("x.sum").cast("decimal(38,0)")).alias("sum"))
        books = books.after({(r["part"], r["entry"], r["position"]): int(r["sum"]) for r in sums.collect()})
        common.remove(spark, path)
        state, path = done.where("sums is null").drop("sums"), out
    return finished(state, books, fresh=rounds == 0), books


def round_(state: DataFrame, books: Codebooks, fresh: bool) -> DataFrame:
    """STATE, assigned anew, and in a column more the sums of each batch, in a row of their own."""
    schema = T.StructType(STATE.fields + [T.StructField("sums", T.ArrayType(ADDED))])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, sums = [Part(e, m) for e, m in zip(books.entries, books.moved, strict=True)], {}
        for batch in batches:
            for ids, labels, x, codes, upper, lower in stepped(batch, each, fresh):
                added(x, codes, sums)
                cells = lambda a: [r.tobytes() for r in a]
                columns = [ids, labels, cells(x), cells(codes), cells(upper), cells(lower), [None] * len(ids)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        if sums:
            yield common.to_batch([(*[None] * 6, [{"part": p, "entry": e, "position": i, "sum": str(s)} for (p, e, i), s in sums.items()])], arrow)

    return state.mapInArrow(rows, schema)


def finished(state: DataFrame, books: Codebooks, fresh: bool) -> DataFrame:
    """CODED: the last assignment, with the exact error."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        each = [Part(e, m) for e, m in zip(books.entries, books.moved, strict=True)]
        for ids, labels, x, codes, _, _ in stepped(batch, each, fresh):
            error = sum(np.array([int(d) for d in distances(x[:, p], part.entries[codes[:, p]])], object) for p, part in enumerate(each))
            for i, label, code, e in zip(ids, labels, codes, error, strict=True):
                yield i, code.tobytes().hex(), min(e, whole.LONG), label

    return common.map_rows(state, CODED, rows, lambda r: 60)


def with_errors(codes: DataFrame, books: Codebooks | None) -> DataFrame:
    """CODED with label_error, the error summed over equal labels (nulls are one label; beyond 64 bits the largest long), and codebooks_sha256."""
    codes = common.written(codes, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(whole.LONG).cast("decimal(38,0)")).cast("long").alias("label_error")
    sums = codes.groupBy(F.col("label").alias("of")).agg(total)  # summed in each task first; its rows then are as few as labels
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_errors(*coded(common.table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """The rounds written out."""
    near = lambda book: f"SELECT vec_id, p, x, e FROM (SELECT v.vec_id, v.p, v.x, b.e, row_number() OVER (PARTITION BY v.vec_id, v.p ORDER BY list_sum(list_transform(range(1, 9), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))), b.e) AS place FROM parts v JOIN {book} b USING (p)) WHERE place = 1"
    steps = [
        "good AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true))",
        "parts AS MATERIALIZED (SELECT vec_id, p, v[8 * p + 1:8 * p + 8] AS x FROM (SELECT vec_id, v, unnest(range(0, 8)) AS p FROM good))",
        "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < 16)",
    ]
    for i in range(ROUNDS):
        mean = ", ".join(f"(sum(x[{j}]) - ((sum(x[{j}]) % count(*)) + count(*)) % count(*)) // count(*)" for j in range(1, 9))
        steps.append(f"near{i} AS MATERIALIZED ({near(f'book{i}')})")
        steps.append(f"mean{i} AS (SELECT p, e, [{mean}]::BIGINT[] AS x FROM near{i} GROUP BY p, e)")
        steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m USING (p, e))")
    last = f"book{ROUNDS}"
    steps.append(f"final AS ({near(last)})")
    steps.append(f"coded AS (SELECT f.vec_id, string_agg(printf('%02x', f.e), '' ORDER BY f.p) AS code, sum(list_sum(list_transform(range(1, 9), lambda i: (f.x[i] - b.x[i]) * (f.x[i] - b.x[i]))))::BIGINT AS error FROM final f JOIN {last} b USING (p, e) GROUP BY f.vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS d FROM {last})")
    return f"WITH {', '.join(steps)} SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM coded c JOIN good USING (vec_id), digest"


OP12_SQL = _sql()
