"""Queries on vendors, brands and lead times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import grid, lead_times as lt, sourcing
from ..sources import tables as t
from .stock import LEAD_MONTHS
from .views import over


def lead_time_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lt.median_lead_times(t.purchase_report(spark, sf_dir), t.AS_OF, LEAD_MONTHS)


def vendor_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lt.vendor_medians(lead_time_median(spark, sf_dir))


def active_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lt.active_vendors(t.purchase_report(spark, sf_dir), t.vendors(spark, sf_dir), t.brand_rules(spark, sf_dir), t.AS_OF)


def active_vendor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors with their lead times by shop and their brands as text, and the lead time of shop 1."""
    entry = lambda x: F.concat_ws(":", x["shop_id"].cast("string"), x["lead_time_days"].cast("long").cast("string"), x["po_count"].cast("string"))
    return active_vendors(spark, sf_dir).select(
        "vendor_id", "vendor_name", "active_po_count", "active_sample_count", "last_received_at", F.array_join(F.transform("location_lead_times", entry), ";").alias("lead_times"), F.array_join("configured_brands", ";").alias("brands"), lt.at_location(F.col("location_lead_times"), 1)["lead_time_days"].alias("lead_time_shop_1")
    )


def vendor_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.size("location_lead_times") > 0
    return active_vendors(spark, sf_dir).agg(F.count("*").alias("vendors"), F.count_if(known).alias("with_lead_time"), F.count_if(~known).alias("without_lead_time"), F.count_if(F.size("configured_brands") > 0).alias("mapped"))


def vendor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the vendors of open orders; the first by name of several."""
    wanted = t.sale_lines(spark, sf_dir).select("vendor_id").distinct()
    names = t.vendors(spark, sf_dir).where("trim(vendor_name) <> ''").join(wanted, "vendor_id", "left_semi")
    return names.groupBy("vendor_id").agg(F.min("vendor_name").alias("vendor_name"))


def brands_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.brands_with_rules(t.items(spark, sf_dir), t.brand_rules(spark, sf_dir))


def active_brand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.brand_rules(spark, sf_dir).where("active")


def item_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.item_brands(t.items(spark, sf_dir))


def brand_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.brand_vendors(t.purchase_report(spark, sf_dir), t.items(spark, sf_dir), t.vendors(spark, sf_dir), t.AS_OF)


def best_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = lead_time_median(spark, sf_dir)
    brands = t.items(spark, sf_dir).select(F.col("brand").alias("brand_name")).distinct()
    shops = brands.withColumn("shop_id", F.explode(F.array(*(F.lit(s).cast("long") for s in t.TARGET_SHOPS))))
    return sourcing.best_vendors(brand_vendors(spark, sf_dir), shops, leads, lt.vendor_medians(leads))


def mapped_vendor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors with a brand that prefers them whose name or brands hold a text."""
    rows = active_vendors(spark, sf_dir).where(F.size("configured_brands") > 0)
    return grid.searched(rows, "Brand#1", ["vendor_name", "configured_brands"]).select("vendor_id", "vendor_name", "active_po_count")


def open_order_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.overrides(spark, sf_dir)


QUERIES = {f.__name__: f for f in (lead_time_median, vendor_medians, active_vendor_list, vendor_figures, vendor_names, brands_with_rules, active_brand_rules, item_brands, brand_vendors, best_vendors, mapped_vendor_search, open_order_overrides)}

_ACTIVE = {
    "recent": "SELECT * FROM lead_rows WHERE first_received_at >= TIMESTAMP '2001-05-03'",
    "by_shop": "SELECT vendor_id, shop_id, ceil(quantile_cont(lead, 0.5))::DOUBLE AS lead_time_days, count(DISTINCT order_id) AS po_count FROM recent WHERE lead BETWEEN 0 AND 40 GROUP BY ALL",
    "configured": "SELECT preferred_vendor_id::BIGINT AS vendor_id, string_agg(brand_name, ';' ORDER BY brand_name) AS brands FROM rules WHERE active GROUP BY ALL",
    "arrays": "SELECT vendor_id, sum(po_count)::BIGINT AS active_sample_count, string_agg(shop_id || ':' || lead_time_days::BIGINT || ':' || po_count, ';' ORDER BY shop_id) AS lead_times, max(CASE WHEN shop_id = 1 THEN lead_time_days END) AS lead_time_shop_1 FROM by_shop GROUP BY ALL",
    "active_vendors": """SELECT c.*, coalesce(n.vendor_name, 'Vendor ' || c.vendor_id) AS vendor_name, coalesce(a.active_sample_count, 0) AS active_sample_count, coalesce(a.lead_times, '') AS lead_times, coalesce(b.brands, '') AS brands, a.lead_time_shop_1
  FROM (SELECT vendor_id, count(DISTINCT order_id) AS active_po_count, max(first_received_at) AS last_received_at FROM recent GROUP BY 1) c LEFT JOIN vendors n USING (vendor_id) LEFT JOIN arrays a USING (vendor_id) LEFT JOIN configured b USING (vendor_id)""",
}
BRAND_VENDORS = """SELECT i.brand AS brand_name, p.vendor_id, v.vendor_name, count(DISTINCT item_id) AS distinct_items
  FROM (SELECT DISTINCT item_id, vendor_id FROM report WHERE po_ordered_at::DATE >= DATE '2000-08-01' AND vendor_id <> 0) p JOIN items i USING (item_id) LEFT JOIN vendors v USING (vendor_id) GROUP BY ALL HAVING count(DISTINCT item_id) >= 3"""
_MEDIANS = "SELECT vendor_id, quantile_cont(lead_time_days, 0.5) AS lead_time_days FROM lead_times GROUP BY ALL"

ORACLES = {
    "lead_time_median": over("SELECT * FROM lead_times"),
    "vendor_medians": over(_MEDIANS),
    "active_vendor_list": over("SELECT vendor_id, vendor_name, active_po_count, active_sample_count, last_received_at, lead_times, brands, lead_time_shop_1 FROM active_vendors", **_ACTIVE),
    "vendor_figures": over("SELECT count(*) AS vendors, count(*) FILTER (lead_times <> '') AS with_lead_time, count(*) FILTER (lead_times = '') AS without_lead_time, count(*) FILTER (brands <> '') AS mapped FROM active_vendors", **_ACTIVE),
    "vendor_names": over("SELECT vendor_id, vendor_name FROM vendors WHERE vendor_id IN (SELECT vendor_id FROM sale_lines)"),
    "brands_with_rules": over("SELECT b.*, r.preferred_vendor_id, r.preferred_vendor_name, coalesce(r.active, false) AS active FROM (SELECT brand AS brand_name, count(DISTINCT item_id) AS item_count FROM items WHERE trim(brand) <> '' GROUP BY 1) b LEFT JOIN rules r USING (brand_name)"),
    "active_brand_rules": over("SELECT * FROM rules WHERE active"),
    "item_brands": over("SELECT item_id, min(brand) AS brand FROM items WHERE trim(brand) <> '' GROUP BY 1"),
    "brand_vendors": over(BRAND_VENDORS),
    "best_vendors": over(
        """SELECT brand_name, shop_id, vendor_id, vendor_name, distinct_items, lead_time_days, lead_time_source, place FROM (
  SELECT *, row_number() OVER (PARTITION BY brand_name, shop_id ORDER BY lead_time_days ASC NULLS LAST, distinct_items DESC, vendor_id) AS place FROM (
    SELECT b.*, s.shop_id, half_even(coalesce(l.lead_time_days, m.lead_time_days), 1) AS lead_time_days, CASE WHEN l.lead_time_days IS NOT NULL THEN 'store' WHEN m.lead_time_days IS NOT NULL THEN 'vendor_median' ELSE 'unknown' END AS lead_time_source
    FROM brand_sources b CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS shop_id) s LEFT JOIN lead_times l ON l.vendor_id = b.vendor_id AND l.shop_id = s.shop_id LEFT JOIN medians m ON m.vendor_id = b.vendor_id)) WHERE place <= 3""",
        brand_sources=BRAND_VENDORS,
        medians=_MEDIANS,
    ),
    "mapped_vendor_search": over("SELECT vendor_id, vendor_name, active_po_count FROM active_vendors WHERE brands <> '' AND (lower(vendor_name) LIKE '%brand#1%' OR lower(brands) LIKE '%brand#1%')", **_ACTIVE),
    "open_order_overrides": over("SELECT * FROM overrides"),
}
