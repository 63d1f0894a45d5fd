"""Queries behind grids, logs and tables that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audit, grid
from ..operators.versions import upsert
from ..sources import stores, tables as t
from .stock import RECOMMENDED, all_recommendations
from .views import over


def grid_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of recommendations that hold a text, by status, then sku and shop."""
    rows = grid.searched(all_recommendations(spark, sf_dir), "e", ["description", "sku", "brand"])
    order = [grid.order_by(rows, "status_rank"), grid.order_by(rows, "sku"), grid.order_by(rows, "shop_id")]
    return grid.page(rows, order, number=2, size=20).select("sku", "shop_id", "status", "qty_to_order")


def grid_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.choices(all_recommendations(spark, sf_dir), ["brand", "category_top_level", "location", "status"])


def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.key_figures(all_recommendations(spark, sf_dir))


def audit_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels that recommendations would change, a row for each."""
    return audit.level_changes(audit.writeback_outbox(all_recommendations(spark, sf_dir), "run-"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.run_summary(all_recommendations(spark, sf_dir), "run-1", t.AS_OF, "test").drop("run_at")


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest entries of a log."""
    rows = t.stock_log(spark, sf_dir)
    return rows.orderBy(F.desc("updated_time"), "event_id").limit(50).select("event_id", "item_id", "updated_time")


def upsert_managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed items (those whose id divides by 3) with new names for those whose id divides by 2."""
    kept = ["sku", "item_id", "product", "brand"]
    items = t.items(spark, sf_dir).withColumn("product", F.col("description"))
    changes = items.where("item_id % 2 = 0").select("sku", (F.col("item_id") + 100000).alias("item_id"), F.upper("product").alias("product"), F.lit("new").alias("brand"))
    return upsert(items.where("item_id % 3 = 0").select(*kept), changes, ["sku"], ["item_id"])


def upsert_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = t.overrides(spark, sf_dir)
    changes = now.where("location_id <> 2").select("sku", (F.col("location_id") + 1).alias("location_id"), F.lit(None).cast("long").alias("manual_reorder_point"), (F.col("manual_desired_level") + 5).alias("manual_desired_level"), F.lit(True).alias("locked"))
    return upsert(now, changes, ["sku", "location_id"]).select("sku", "location_id", "manual_desired_level", "locked")


def upsert_brand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every brand, without a vendor for some: those can't be active."""
    number = F.regexp_extract("brand", r"(\d+)$", 1).cast("long")
    brands = t.items(spark, sf_dir).select("brand").distinct().withColumn("number", number)
    new = brands.select(F.col("brand").alias("brand_name"), F.when(F.col("number") % 4 != 0, F.col("number").cast("string")).alias("preferred_vendor_id"), F.lit("New").alias("preferred_vendor_name"), F.lit(True).alias("active"))
    return upsert(t.brand_rules(spark, sf_dir), stores.checked_rules(new), ["brand_name"])


def location_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each location has, and the first sku of them; a location without rows has 0 and none."""
    rows = all_recommendations(spark, sf_dir).select(F.col("shop_id").alias("location_id"), "sku", "qty_to_order")
    locations = spark.createDataFrame([(0,), (1,), (2,), (99,)], "location_id long")
    return stores.location_summary(rows, locations)


QUERIES = {f.__name__: f for f in (grid_page, grid_choices, kpi_summary, audit_unpivot, run_summary, latest_runs, upsert_managed, upsert_overrides, upsert_brand_rules, location_sizes)}

_R = {"recommended": RECOMMENDED, "ranked": "SELECT *, list_position(['critical', 'low', 'warning', 'healthy', 'incoming', 'on_target', 'high', 'overstock', 'no_demand'], status) AS status_rank FROM recommended"}

ORACLES = {
    "grid_page": over("SELECT sku, shop_id, status, qty_to_order FROM ranked WHERE lower(description) LIKE '%e%' OR lower(sku) LIKE '%e%' OR lower(brand) LIKE '%e%' ORDER BY status_rank, lower(sku), shop_id LIMIT 20 OFFSET 20", **_R),
    "grid_choices": over(
        """SELECT DISTINCT 'brand' AS name, brand AS value FROM recommended UNION SELECT 'category_top_level', category_top_level FROM recommended UNION SELECT 'status', status FROM recommended
  UNION SELECT 'location', CASE shop_id WHEN 0 THEN 'North' WHEN 1 THEN 'Centre' ELSE 'South' END FROM recommended""",
        **_R,
    ),
    "kpi_summary": over(
        """SELECT count(*) AS items, count(*) FILTER (qty_to_order > 0) AS needs_order, count(*) FILTER (status = 'critical') AS critical, count(*) FILTER (status = 'low') AS low, count(*) FILTER (status = 'overstock') AS overstock,
  count(*) FILTER (change_needed) AS changes, coalesce(sum(qty_to_order), 0)::BIGINT AS units_to_order FROM recommended""",
        **_R,
    ),
    "audit_unpivot": over(
        """SELECT 'run-' || sku || '@' || shop_id AS log_id, sku, shop_id AS location_id, 'reorder_point' AS field, current_reorder_point AS old_value, reorder_point AS new_value FROM recommended WHERE change_needed AND current_reorder_point <> reorder_point
  UNION ALL SELECT 'run-' || sku || '@' || shop_id, sku, shop_id, 'desired_level', current_desired_level, desired_level FROM recommended WHERE change_needed AND current_desired_level <> desired_level""",
        **_R,
    ),
    "run_summary": over("SELECT 'run-1' AS run_id, count(*) AS items, count(*) FILTER (qty_to_order > 0) AS needs_order, 'test' AS triggered_by FROM recommended", **_R),
    "latest_runs": over("SELECT event_id, item_id, updated_time FROM stock_log ORDER BY updated_time DESC, event_id LIMIT 50"),
    "upsert_managed": over(
        """SELECT sku, CASE WHEN item_id % 3 = 0 THEN item_id ELSE item_id + 100000 END AS item_id, CASE WHEN item_id % 2 = 0 THEN upper(description) ELSE description END AS product, CASE WHEN item_id % 2 = 0 THEN 'new' ELSE brand END AS brand
  FROM items WHERE item_id % 3 = 0 OR item_id % 2 = 0"""
    ),
    "upsert_overrides": over(
        """SELECT o.sku, o.location_id, coalesce(p.manual_desired_level + 5, o.manual_desired_level) AS manual_desired_level, CASE WHEN p.sku IS NOT NULL THEN true ELSE o.locked END AS locked FROM overrides o LEFT JOIN overrides p ON p.sku = o.sku AND p.location_id = o.location_id - 1"""
    ),
    "upsert_brand_rules": over(
        """SELECT brand AS brand_name, CASE WHEN n % 4 <> 0 THEN n::VARCHAR END AS preferred_vendor_id, CASE WHEN n % 4 <> 0 THEN 'New' END AS preferred_vendor_name, n % 4 <> 0 AS active FROM (SELECT DISTINCT brand, regexp_extract(brand, '(\\d+)$', 1)::BIGINT AS n FROM items)"""
    ),
    "location_sizes": over("SELECT l.id AS location_id, count(r.sku) AS n, coalesce(min(r.sku), '') AS first_sku FROM (SELECT unnest([0, 1, 2, 99])::BIGINT AS id) l LEFT JOIN recommended r ON r.shop_id = l.id GROUP BY 1", **_R),
}
