"""Brands and the vendors that supply them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import half_even, is_blank, name_key


def item_brands(items: DataFrame) -> DataFrame:
    """(item_id, brand): of several brands the first by name; blank ones don't count."""
    return items.where(~is_blank(F.col("brand"))).groupBy("item_id").agg(F.min("brand").alias("brand"))


def brands_with_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(brand_name, item_count, preferred_vendor_id, preferred_vendor_name, active): every brand; one without a rule isn't active."""
    counts = items.where(~is_blank(F.col("brand"))).groupBy(F.col("brand").alias("brand_name")).agg(F.count_distinct("item_id").alias("item_count"))
    return counts.join(rules, "brand_name", "left").select("brand_name", "item_count", "preferred_vendor_id", "preferred_vendor_name", F.coalesce("active", F.lit(False)).alias("active"))


def brand_vendors(report: DataFrame, items: DataFrame, names: DataFrame, as_of: date, days: int = 365, least: int = 3) -> DataFrame:
    """(brand_name, vendor_id, vendor_name, distinct_items): vendors from whom so many items of a brand were ordered lately.

    Pairs of item and vendor are made distinct before they meet brands, so that an item ordered often is one row.
    """
    recent = report.where((F.to_date("po_ordered_at") >= F.lit(as_of - timedelta(days=days))) & (F.coalesce("vendor_id", F.lit(0)) != 0))
    pairs = recent.select("item_id", "vendor_id").distinct().join(item_brands(items), "item_id")
    counts = pairs.groupBy(F.col("brand").alias("brand_name"), "vendor_id").agg(F.count_distinct("item_id").alias("distinct_items")).where(F.col("distinct_items") >= least)
    return counts.join(names.groupBy("vendor_id").agg(F.min("vendor_name").alias("vendor_name")), "vendor_id", "left").select("brand_name", "vendor_id", "vendor_name", "distinct_items")


def best_vendors(sourcing: DataFrame, shops: DataFrame, lead_times: DataFrame, medians: DataFrame, n: int = 3) -> DataFrame:
    """The n vendors of each brand and shop of `shops` (brand_name, shop_id): those of known lead time first, the shortest first, then by items.

    A shop without a lead time of its own takes the vendor's median.
    """
    known = lead_times.select("vendor_id", "shop_id", F.col("lead_time_days").alias("shop_lead"))
    rows = shops.join(sourcing, "brand_name").join(known, ["vendor_id", "shop_id"], "left").join(medians.select("vendor_id", F.col("lead_time_days").alias("median_lead")), "vendor_id", "left")
    source = F.when(F.col("shop_lead").isNotNull(), F.lit("store")).when(F.col("median_lead").isNotNull(), F.lit("vendor_median")).otherwise(F.lit("unknown"))
    rows = rows.select("brand_name", "shop_id", "vendor_id", "vendor_name", "distinct_items", half_even(F.coalesce("shop_lead", "median_lead"), 1).alias("lead_time_days"), source.alias("lead_time_source"))
    order = Window.partitionBy("brand_name", "shop_id").orderBy(F.asc_nulls_last("lead_time_days"), F.desc("distinct_items"), "vendor_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def same_brand(a: str, b: str):
    return name_key(F.col(a)) == name_key(F.col(b))
