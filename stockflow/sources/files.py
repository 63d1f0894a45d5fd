"""Files and rows that come from outside, and made-up rows for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import id_text

#: What an uploaded file of managed items must have, and what it may have.
REQUIRED, OPTIONAL = ("sku", "item_id"), ("product", "brand", "vendor", "category")
TEMPLATE = "sku,item_id,product,brand,vendor,category\nSKU-1,1001,Example product,Example brand,Example vendor,Example category\n"
MANAGED = T.StructType([T.StructField(c, T.StringType()) for c in (*REQUIRED, *OPTIONAL, "added_by")])


def managed_from_csv(spark: SparkSession, path: str, added_by: str) -> DataFrame:
    """Managed items from an uploaded CSV file with a header; raises where a required column is missing. All values are text."""
    found = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in found.columns}
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    columns = [F.col(f"`{names[c]}`").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in (*REQUIRED, *OPTIONAL)]
    return found.select(*columns, F.lit(added_by).alias("added_by"))


def managed_from_rows(spark: SparkSession, rows: list[dict], added_by: str) -> DataFrame:
    """Managed items from JSON rows. The id is system_id, or else item_id; rows without a sku or an id are skipped."""
    names = ("sku", "system_id", "item_id", *OPTIONAL)
    text = [tuple(None if r.get(c) is None else str(r[c]) for c in names) for r in rows]
    found = spark.createDataFrame(text, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    found = found.withColumn("item_id", F.coalesce(id_text(F.col("system_id")), id_text(F.col("item_id"))))
    return found.where("trim(sku) <> '' and item_id is not null").select(*REQUIRED, *OPTIONAL, F.lit(added_by).alias("added_by"))


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that stands in a query."""
    return spark.createDataFrame(rows, schema)


def made_up_items(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n rows for trying out grids: whole numbers, and vendors of uneven share."""
    number = lambda k, top: F.floor(F.rand(seed + k) * top).cast("long")
    draw = F.rand(seed + 9)
    vendor = F.when(draw < 0.5, F.lit("Northwind")).when(draw < 0.8, F.lit("Contoso")).otherwise(F.lit("Fabrikam"))
    rows = spark.range(1, n + 1).select(F.col("id").alias("item_id"), F.format_string("SKU-%06d", "id").alias("sku"), vendor.alias("vendor"), number(1, 80).alias("on_hand"), number(2, 40).alias("on_order"), number(3, 60).alias("current_reorder_point"))
    return rows.withColumn("needs_order", F.col("on_hand") + F.col("on_order") <= F.col("current_reorder_point"))
