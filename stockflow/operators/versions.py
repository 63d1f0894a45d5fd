"""Versions of rows: the latest of each key, and replacement by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_version(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order, which should leave no ties between rows that differ.

    Spark prunes each task's rows to one per key before the shuffle.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("nth_version", nth).where("nth_version = 1").drop("nth_version")


def mark_latest(log: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """log with a column `name`: whether a row is the one that latest_version keeps. Rows that already stand together by one of the keys aren't exchanged for it."""
    return log.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], kept: list[str] = ()) -> DataFrame:
    """current with changes put in by key: a row whose key is there is replaced but for its columns `kept`, others are added.

    changes has one row per key at most. One join by key does it, whichever side is larger; keys that are null never match.
    """
    old, new = current.withColumn("was", F.lit(True)).alias("old"), changes.withColumn("comes", F.lit(True)).alias("new")
    same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]

    def value(c: str) -> Column:
        if c in kept:
            return F.when(F.col("was"), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)
        return F.when(F.col("comes"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return old.join(new, same, "full").select(*map(value, current.columns))
