"""The stock log as a stream: rows that come twice are told apart, and changes are counted by day, within a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.stores import Store

SCHEMA = "event_id long, item_id long, shop_id long, qoh long, updated_time timestamp"


def stock_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Files of stock changes as they come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def without_repeats(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once. What is held to tell repeats goes as soon as they are later than `late`."""
    return stream.withWatermark("updated_time", late).dropDuplicatesWithinWatermark(["event_id"])


def changes_by_day(stream: DataFrame) -> DataFrame:
    """(day, shop_id, changes, empty): a day's row comes out once it is closed. Give it the stream with its watermark."""
    days = stream.groupBy(F.window("updated_time", "1 day").alias("w"), "shop_id")
    return days.agg(F.count("*").alias("changes"), F.count_if(F.col("qoh") <= 0).alias("empty")).select(F.to_date("w.start").alias("day"), "shop_id", "changes", "empty")


def appended(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and ends; the next call goes on from its checkpoint, so that nothing is written twice."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def latest_into(stream: DataFrame, store: Store, checkpoint: str, table: str = "latest_stock") -> StreamingQuery:
    """Keeps the newest row of each key of a stream in a table of the store; writes what is there and ends.

    A batch's number stands in the record of the version that it makes. A batch that is run again, as its checkpoint was lost after the version was
    claimed, changes nothing; one whose version wasn't claimed is written whole. Late rows lose against newer ones that are there.
    """
    write = lambda rows, number: store.merge(table, rows, batch=(table, number))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
