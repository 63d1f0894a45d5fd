"""What the text operators share: tables, written intermediate results, batches of Arrow rows."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.kept import shared_dir

#: Bytes of text in one Arrow batch that goes back to Spark, so that very long documents don't pile up.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/stockflow-{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs none of it."""
    df.write.parquet(path := new_path(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many underscores after it as make it unlike all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but those rows of which (doc_id, h) is in rejected, h a hash of the text. Columns of docs stay as they are."""
    doc, h = fresh("rejected_doc", docs.columns), fresh("rejected_text", docs.columns)
    rejected = rejected.select(F.col("doc_id").alias(doc), F.col("h").alias(h))
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected[doc]) & (F.xxhash64(docs["text"]) == rejected[h]), "left_anti")


def give_back() -> None:
    """Memory that is free goes back to the system: Python workers live on after their tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, schema: T.StructType, rows: Callable[[pa.RecordBatch], Iterator[tuple]], size: Callable[[tuple], int] = lambda row: 200, forget: Callable[[], None] = lambda: None) -> DataFrame:
    """mapInArrow by a function that yields tuples for a batch; what it yields goes back in batches of BATCH_BYTES at most.

    `forget` ends a task: what its worker shouldn't keep for the next ones goes there.
    """
    arrow = to_arrow_schema(schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in source:
            for row in rows(batch):
                held.append(row)
                weight += size(row)
                if weight >= BATCH_BYTES:
                    yield to_batch(held, arrow)
                    held, weight = [], 0
        if held:
            yield to_batch(held, arrow)
        batch = row = held = None
        forget()
        give_back()

    return df.mapInArrow(batches, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
