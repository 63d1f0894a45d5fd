"""Queries that look things up: texts by their trigrams, a grid by several choices and flags, and where given items drop out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audit, grid, qualification, replenishment as rp, special_orders as so, text_index
from ..sources import tables as t
from ..sources.kept import kept
from .orders import flagged, matched
from .stock import _QTY, INPUTS, all_recommendations
from .vendors import ORACLES as VENDORS, brand_vendors, lead_time_median
from .views import VIEWS, over
from .worklists import _MORE, ORACLES as WORKLISTS, enriched, with_items, with_supply

NEEDLES = ("Brand#13", "11", "y/brand#2")
ITEM_TEXTS = ["description", "sku", "brand", "category_path"]
EXAMPLES = [(1, "should qualify"), (2, "should qualify"), (17, "should qualify"), (40, "should not qualify"), (180, "should not qualify"), (10**12, "should not qualify")]


#: Ids of special orders that share the grams of their texts: those of some 6,500 sales.
ID_BLOCK = 65536


def indexed_order_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_search by a table of the trigrams of each block of ids, that is kept; orders of blocks that hold the text are looked through."""
    inputs = [f"{sf_dir}/{name}.parquet" for name in INPUTS]
    table = kept(spark, "order-trigram-blocks", inputs, lambda: order_index(spark, sf_dir))
    rows = enriched(spark, sf_dir).where("flag <> 'none' and shop_id = 1")
    return text_index.search(rows, table, " #00000000 ", "special_order_id", so.SEARCHED, ID_BLOCK).select("special_order_id", "flag", "shop_id", "vendor_name")


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigrams of each block of orders: own texts move to their block, those of items and vendors are met by ids."""
    rows = flagged(spark, sf_dir).withColumn("block", text_index.place(F.col("special_order_id"), ID_BLOCK))
    of_items, of_vendors = ["description", "brand", "vendor_names"], ["vendor_name"]
    own = [c for c in so.SEARCHED if c not in of_items + of_vendors]
    by_item = with_supply(with_items(rows.select("block", "item_id", "shop_id"), spark, sf_dir), spark, sf_dir)
    by_vendor = rows.select("block", "vendor_id").distinct().join(t.vendors(spark, sf_dir), "vendor_id")
    return text_index.index_of_parts([(rows.select("block", *own).repartition("block"), own), (by_item, of_items), (by_vendor, of_vendors)], "block", so.SEARCHED)


def indexed_item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that hold a text in one of ITEM_TEXTS, for each of several texts, one of them too short for the index."""
    rows = t.items(spark, sf_dir)
    table = kept(spark, "item-trigrams", [f"{sf_dir}/part.parquet"], lambda: text_index.index(rows, "item_id", ITEM_TEXTS))
    found = [text_index.search(rows, table, text, "item_id", ITEM_TEXTS).select(F.lit(text).alias("needle"), "item_id", "sku") for text in NEEDLES]
    return found[0].unionByName(found[1]).unionByName(found[2])


def grid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations with overrides, by a text, two locations, and the flags `changed` and `overridden`; `locked` isn't ticked."""
    overrides = t.overrides(spark, sf_dir)
    given = overrides.select(F.col("sku").alias("o_sku"), F.col("location_id").alias("o_shop"), F.lit(True).alias("overridden"))
    rows = rp.apply_overrides(all_recommendations(spark, sf_dir), overrides)
    rows = rows.join(given, (F.col("sku") == F.col("o_sku")) & (F.col("shop_id") == F.col("o_shop")), "left").withColumns({"needs_order": F.col("qty_to_order") > 0, "changed": F.col("change_needed")})
    rows = grid.chosen(grid.searched(rows, "5", ["sku", "description"]), {"location": ["North", "South"], "brand": []})
    rows = grid.ticked(rows, {"needs_order": False, "changed": True, "locked": False, "overridden": True})
    return rows.select("item_id", "shop_id", "sku", "locked", "qty_to_order")


def qualification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row, its lists as JSON."""
    row = qualification.report(t.items(spark, sf_dir), t.stock_log(spark, sf_dir), t.TARGET_SHOPS, EXAMPLES)
    return row.withColumns({c: F.to_json(c) for c in ("by_shop", "examples")})


LINKS = {"item_link": ("/items/{}", "item_id"), "customer_link": ("/customers/{}", "customer_id"), "order_link": ("/orders/{}?tab=main", "po_id")}
SHOPS = {0: "North", 1: "Centre", 2: "South"}


def special_order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of special orders. Lines of every sixth sale have no time here: their orders began two days later, at the record's last change; every fourth item has a blank text and no upc."""
    rows = matched(spark, sf_dir).where(~F.col("done"))
    line_time = F.when(F.col("sale_id") % 6 != 0, F.col("created_date"))
    rows = rows.withColumn("created_date", so.created_day(line_time, F.date_add("created_date", 2)))
    rows = so.with_flag(so.with_stage(rows), t.AS_OF)
    sales = t.sales(spark, sf_dir).select("sale_id", "customer_id", F.col("received").alias("po_complete"))
    fourth = F.col("item_id") % 4 == 0
    items = t.items(spark, sf_dir).select("item_id", "brand", F.when(fourth, " ").otherwise(F.col("description")).alias("item_text"), F.when(fourth, "").otherwise(F.col("sku")).alias("upc"))
    rows = rows.join(sales, "sale_id", "left").join(items, "item_id", "left").join(t.vendors(spark, sf_dir), "vendor_id", "left")
    rows = so.recorded(rows.withColumns({"num_received": F.when(F.col("po_id") % 3 == 0, F.col("quantity")), "line_text": F.concat(F.lit("line "), F.col("sale_id").cast("string"))}), SHOPS, LINKS)
    known = ["special_order_id", "status", "quantity", "shop_id", "store", "created_date", "age_days", "contacted", "customer_id", "customer_name", "customer_email", "web_match", "web_order_id", "web_order_name", "item_id", "system_sku", "upc", "description"]
    more = ["brand", "po_id", "vendor_id", "vendor_name", "expected_date", "po_ordered_date", "po_ordered", "po_complete", "received_started", "stage", "stage_index", "flag", "days_overdue", "is_overdue", *LINKS]
    return rows.select(*known, *more)


def ordered_lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty lead times by vendor and shop."""
    return lead_time_median(spark, sf_dir).orderBy("vendor_id", "shop_id").limit(60)


def ordered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty vendors of brands: by brand, then the most items, then vendor."""
    return brand_vendors(spark, sf_dir).orderBy("brand_name", F.desc("distinct_items"), "vendor_id").limit(60)


def recommendation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest runs of a kept log of runs, with one for each day and shop of the stock log."""

    def runs() -> DataFrame:
        day = F.to_date("updated_time")
        found = t.stock_log(spark, sf_dir).groupBy(day.alias("day"), "shop_id").agg(F.count_distinct("item_id").alias("items"), F.count_if(F.col("qoh") <= 0).alias("needs_order"))
        return found.select(F.concat_ws("-", F.lit("run"), "day", F.col("shop_id").cast("string")).alias("run_id"), F.col("day").cast("timestamp").alias("run_at"), "items", "needs_order", F.lit("log").alias("triggered_by"))

    return audit.newest_runs(kept(spark, "runs", [f"{sf_dir}/events.parquet"], runs)).withColumn("run_at", F.to_date("run_at"))


QUERIES = {f.__name__: f for f in (indexed_order_search, indexed_item_search, grid_choice, qualification_report, special_order_records, ordered_lead_times, ordered_sources, recommendation_runs)}

_HOLDS = lambda text: " OR ".join(f"contains(lower({c}), '{text.lower()}')" for c in ITEM_TEXTS)
ORACLES = {
    "indexed_order_search": WORKLISTS["order_search"],
    "indexed_item_search": over(" UNION ALL ".join(f"SELECT '{text}' AS needle, item_id, sku FROM items WHERE {_HOLDS(text)}" for text in NEEDLES)),
    "grid_choice": over(
        f"""SELECT item_id, shop_id, sku, locked, {_QTY} AS qty_to_order
  FROM (SELECT p.* EXCLUDE (reorder_point, desired_level), coalesce(o.manual_reorder_point, p.reorder_point) AS reorder_point, coalesce(o.manual_desired_level, p.desired_level) AS desired_level, coalesce(o.locked, false) AS locked
    FROM planned p JOIN overrides o ON o.sku = p.sku AND o.location_id = p.shop_id)
  WHERE shop_id IN (0, 2) AND (contains(lower(sku), '5') OR contains(lower(description), '5')) AND (current_reorder_point <> reorder_point OR current_desired_level <> desired_level)"""
    ),
    "ordered_lead_times": f"SELECT * FROM ({VENDORS['lead_time_median']}) ORDER BY vendor_id, shop_id LIMIT 60",
    "ordered_sources": f"SELECT * FROM ({VENDORS['brand_vendors']}) ORDER BY brand_name, distinct_items DESC, vendor_id LIMIT 60",
    "recommendation_runs": over("""SELECT 'run-' || updated_time::DATE || '-' || shop_id AS run_id, updated_time::DATE AS run_at, count(DISTINCT item_id) AS items, count(*) FILTER (qoh <= 0) AS needs_order, 'log' AS triggered_by
  FROM stock_log GROUP BY updated_time::DATE, shop_id ORDER BY run_at DESC, run_id LIMIT 50"""),
    "special_order_records": over(
        """SELECT special_order_id, status_text AS status, f.quantity, f.shop_id, CASE f.shop_id WHEN 0 THEN 'North' WHEN 1 THEN 'Centre' WHEN 2 THEN 'South' END AS store, created_date, age_days, contacted, s.customer_id, s.customer_name, customer_email,
  web_match, web_order_id, web_order_name, f.item_id, system_sku, CASE WHEN f.item_id % 4 <> 0 THEN i.sku END AS upc, CASE WHEN f.item_id % 4 <> 0 THEN i.description ELSE 'line ' || f.sale_id END AS description, i.brand, po_id, f.vendor_id, v.vendor_name, expected_date,
  po_ordered_date, po_id IS NOT NULL AND po_ordered_date IS NOT NULL AS po_ordered, po_id IS NOT NULL AND s.received AS po_complete, coalesce(po_id % 3 = 0, false) AS received_started, stage, (list_position(['open_pool', 'unordered_po', 'ordered', 'received'], stage) - 1)::INTEGER AS stage_index,
  flag, days_overdue, flag IN ('overdue', 'overdue_mid', 'critical') AS is_overdue, '/items/' || f.item_id AS item_link, '/customers/' || s.customer_id AS customer_link, '/orders/' || po_id || '?tab=main' AS order_link
  FROM flagged f JOIN sales s USING (sale_id) LEFT JOIN items i ON i.item_id = f.item_id LEFT JOIN vendors v ON v.vendor_id = f.vendor_id""",
        **_MORE | {"first_orders": VIEWS["special_orders"], "special_orders": "SELECT * REPLACE (CASE WHEN sale_id % 6 <> 0 THEN created_date ELSE created_date + 2 END AS created_date) FROM first_orders"},
    ),
    "qualification_report": over(
        f"""SELECT (SELECT count(*) FROM qualified) AS qualified_items, (SELECT count(*) FROM known) AS latest_items, (SELECT count(*) FROM target) AS target_rows,
  (SELECT to_json(list({{'shop_id': shop_id, 'n': n}} ORDER BY shop_id))::VARCHAR FROM (SELECT shop_id, count(*) AS n FROM target GROUP BY 1)) AS by_shop,
  (SELECT to_json(list({{'item_id': item_id, 'expected': expected, 'qualified': item_id IN (SELECT item_id FROM qualified), 'known': item_id IN (SELECT item_id FROM known), 'shops': coalesce(shops, [])}} ORDER BY item_id))::VARCHAR
   FROM (VALUES {', '.join(f"({i}::BIGINT, '{e}')" for i, e in EXAMPLES)}) x(item_id, expected) LEFT JOIN (SELECT item_id, list(shop_id ORDER BY shop_id) AS shops FROM target GROUP BY 1) USING (item_id)) AS examples""",
        known="SELECT DISTINCT item_id FROM items WHERE item_id IN (SELECT item_id FROM qualified)",
        target="SELECT item_id, shop_id FROM current_levels WHERE shop_id IN (0, 1, 2) AND item_id IN (SELECT item_id FROM known)",
    ),
}
