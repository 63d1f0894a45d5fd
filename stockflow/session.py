"""A session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stockflow", **conf: str) -> SparkSession:
    """UTC, and plans that adapt at run time: joins turn into broadcasts, and skewed partitions are split, by measured sizes."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
