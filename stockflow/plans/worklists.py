"""Queries behind work lists: special orders with all that is known of them, web orders by tag, and lists in their order."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import forecasting as fc, grid, lead_times as lt, purchasing, sourcing, special_orders as so, stock
from ..sources import stores, tables as t
from ..sources.kept import kept, newest_snapshot
from . import orders as po, vendors
from .forecasts import _MORE as FORECASTS, cover, profiles, top_history
from .orders import _MORE as ORDERS, flagged, open_lines
from .stock import all_recommendations
from .vendors import _MEDIANS, BRAND_VENDORS
from .views import over

SHOPS = (0, 1, 2, 3, 4)


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.with_triage(flagged(spark, sf_dir)).select("special_order_id", "stage", "flag", "sub_key", "label", "tone")


def triage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.triage_counts(flagged(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special orders with their customer, item, shop, vendor, web order, and the vendors that could supply them soonest."""
    rows = with_items(flagged(spark, sf_dir), spark, sf_dir).join(t.vendors(spark, sf_dir), "vendor_id", "left")
    return with_supply(rows, spark, sf_dir)


def with_items(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join(t.items(spark, sf_dir).select("item_id", "description", "brand"), "item_id", "left")


def with_supply(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows (brand, shop_id) with the vendors that could supply them soonest, and their names."""
    return so.with_vendors(rows, supply(spark, sf_dir)).withColumn("vendor_names", F.transform("available_vendors", lambda x: x["vendor_name"]))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few vendors of each brand and shop: a kept table, so that lines are read once for it, and rows that meet it aren't exchanged where it is small."""

    def best() -> DataFrame:
        leads = vendors.lead_time_median(spark, sf_dir)
        brands = t.items(spark, sf_dir).select(F.col("brand").alias("brand_name")).distinct().withColumn("shop_id", F.explode(F.array(*(F.lit(s).cast("long") for s in SHOPS))))
        return sourcing.best_vendors(vendors.brand_vendors(spark, sf_dir), brands, leads, lt.vendor_medians(leads))

    return kept(spark, "supply", [*po.inputs(sf_dir), f"{sf_dir}/part.parquet", f"{sf_dir}/supplier.parquet"], best)


def enriched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda x: F.concat_ws(":", x["vendor_id"].cast("string"), x["lead_time_days"].cast("long").cast("string"), x["lead_time_source"])
    rows = enriched(spark, sf_dir)
    return rows.select("special_order_id", "customer_name", "customer_email", "description", "brand", "shop_id", "vendor_name", "quantity", "po_id", "age_days", "expected_date", "web_order_name", F.array_join(F.transform("available_vendors", entry), ";").alias("vendors"))


def order_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged orders of one shop that hold a text in any of ten fields, of any age; the text is the end of vendors' names, also of those that could supply them."""
    return so.found(enriched(spark, sf_dir), " #00000000 ", flagged_only=True, shop=1, live_only=False).select("special_order_id", "flag", "shop_id", "vendor_name")


def live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have waited a year at most, by stage and brand."""
    return so.found(enriched(spark, sf_dir)).groupBy("stage", "brand").agg(F.count("*").alias("n"))


def tagged_web_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of open web orders that are tagged as special ones, with the text of their field. Some have the tag twice."""
    web = so.open_web_orders(t.shop_orders(spark, sf_dir))
    heads = web.select("order_id", "order_name", "eta").distinct()
    tags = heads.select("order_id", F.explode(F.when(F.col("order_id") % 4 == 0, F.array(F.lit("SO"), F.lit("so"))).when(F.col("order_id") % 4 == 1, F.array(F.lit("So"), F.lit("vip"))).otherwise(F.array(F.lit("vip")))).alias("tag"))
    fields = heads.select("order_id", F.when(F.col("order_id") % 3 == 0, F.lit("order")).otherwise(F.lit("customer")).alias("owner"), F.concat(F.lit("note "), F.col("order_id").cast("string")).alias("field"))
    return so.tagged(heads, tags, fields, web.select("order_id", "sku").where("sku is not null"))


def all_web_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open web orders, a row per line, and one without a sku for an order without lines."""
    web = so.open_web_orders(t.shop_orders(spark, sf_dir))
    bare = web.withColumn("sku", F.when(F.col("order_id") % 5 != 0, F.col("sku"))).groupBy("order_id", "order_name").agg(F.sort_array(F.collect_set("sku")).alias("skus"))  # a fifth of them loses its lines
    return bare.select("order_id", "order_name", F.explode_outer("skus").alias("sku"))


def vendors_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty vendors by name, then id; those without a name come first."""
    rows = t.vendors(spark, sf_dir).withColumn("vendor_name", F.when(F.col("vendor_id") % 7 != 0, F.col("vendor_name")))
    return rows.orderBy(F.coalesce("vendor_name", F.lit("")), "vendor_id").limit(20)


def soonest_stockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty recommendations that run out first."""
    return fc.first_critical(cover(spark, sf_dir), ["item_id", "shop_id"]).orderBy("steps_to_critical", "item_id", "shop_id").limit(40)


def largest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten profiles that rest on the most units."""
    rows = profiles(spark, sf_dir).where("level <> 'category_path'").select("level", "category", F.round("total_units", 4).alias("sample_units"))
    return rows.orderBy(F.desc("sample_units"), "level", "category").limit(10)


def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four top categories that sell the most, which a chart begins with."""
    return top_history(spark, sf_dir).groupBy("category").agg(F.sum("units").alias("units")).orderBy(F.desc("units"), "category").limit(4)


def promised_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web orders that nothing refers to: the thirty that were promised for the earliest day, those without a promise last."""
    return po.unmatched_orders(spark, sf_dir).orderBy(*so.by_promise()).limit(30).select("order_id", "order_name", "eta")


def dated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of special orders by expected date upwards, unknown ones last."""
    rows = flagged(spark, sf_dir)
    return grid.page(rows, [grid.order_by(rows, "expected_date"), F.asc("special_order_id")], number=2, size=30).select("special_order_id", "expected_date")


def undated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of them downwards: unknown dates first."""
    rows = flagged(spark, sf_dir)
    return grid.page(rows, [grid.order_by(rows, "expected_date", descending=True), F.asc("special_order_id")], size=30).select("special_order_id", "expected_date")


def overrides_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.overrides(spark, sf_dir).select(F.concat_ws("_", "sku", F.col("location_id").cast("string")).alias("sku_location"), "manual_reorder_point", "manual_desired_level", "locked")


def managed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.items(spark, sf_dir).where("item_id % 3 = 0").select("sku", F.col("item_id").cast("string").alias("item_id"), F.col("description").alias("product"), "brand", F.col("category_top_level").alias("category"))


def drafts_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of one status with their lines as text: those of recommendations that go on orders, by vendor and shop."""
    lines = purchasing.reconciled(all_recommendations(spark, sf_dir), open_lines(spark, sf_dir)).withColumn("draft_id", F.concat_ws("-", F.col("vendor_id").cast("string"), F.col("shop_id").cast("string")))
    drafts = lines.select("draft_id", "vendor_id", "shop_id").distinct().withColumn("status", F.when(F.col("vendor_id") % 2 == 0, "draft").otherwise("pushed")).where("status = 'draft'")
    entry = lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["quantity"].cast("string"), x["tag"])
    return stores.with_lines(drafts, lines).select("draft_id", "vendor_id", "shop_id", "status", F.array_join(F.transform("lines", entry), ";").alias("lines"))


def open_orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines of one shop and some vendors."""
    return grid.chosen(open_lines(spark, sf_dir), {"shop_id": 1, "vendor_id": list(range(0, 1000, 2)), "item_id": None}).select("order_id", "line_no", "vendor_id", "item_id", "open_quantity")


def item_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item, its units by shop over all versions of lines and over the latest, as JSON."""
    from .stock import raw_and_deduplicated

    number = lambda c: F.col(c).cast("long").alias(c)
    side = lambda s: F.struct(*(number(f"{s}_{c}").alias(c) for c in ("units_30", "units_60", "line", "on_order"))).alias(s)
    rows = raw_and_deduplicated(spark, sf_dir).select("item_id", F.struct("shop_id", side("raw"), side("latest")).alias("shop"))
    return rows.groupBy("item_id").agg(F.to_json(F.sort_array(F.collect_list("shop"))).alias("shops"))  # a few shops for each item


def sought_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty special orders that follow one of a given expected date and id."""
    keys = [("expected_date", False), ("special_order_id", False)]
    return grid.seek_page(flagged(spark, sf_dir), keys, [date(1998, 3, 1), 0], 30).select("special_order_id", "expected_date")


def newest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of the stock log's daily levels, from a table with a folder for each day."""
    table = kept(spark, "daily-levels", [f"{sf_dir}/events.parquet"], lambda: stock.last_of_day(t.stock_log(spark, sf_dir), date(1900, 1, 1), date(2100, 1, 1)), partition_by="day")
    return newest_snapshot(table, "day").select("day", "item_id", "shop_id", "qoh")


def units_of_shops(spark: SparkSession, sf_dir: str, shops: tuple[int, ...] = t.TARGET_SHOPS, since: date = date(2001, 1, 1), statuses: tuple[str, ...] = ("F", "P")) -> DataFrame:
    """Units by item and shop, by SQL with parameters that are bound: an array of shops, an array of statuses, a date."""
    sql = """SELECT item_id, shop_id, sum(quantity) AS units, count(*) AS lines FROM {lines} JOIN {sales} USING (sale_id)
             WHERE array_contains(CAST(:shops AS ARRAY<BIGINT>), shop_id) AND array_contains(:statuses, status) AND complete_time >= :since GROUP BY item_id, shop_id"""
    args = {"shops": F.array(*map(F.lit, shops)), "statuses": F.array(*map(F.lit, statuses)), "since": since}
    return spark.sql(sql, args=args, lines=t.sale_lines(spark, sf_dir), sales=t.sales(spark, sf_dir))


def item_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item its ids in shops, as JSON, and that in shop 1."""
    return t.item_shops(spark, sf_dir).select("item_id", "sku", F.coalesce(F.to_json("shops"), F.lit("{}")).alias("shops"), F.try_element_at("shops", F.lit(1).cast("long")).alias("in_shop_1"))


QUERIES = {
    f.__name__: f
    for f in (
        sought_page, newest_levels, units_of_shops, item_relations, triage, triage_counts, enriched_orders, order_search, live_orders, tagged_web_orders, all_web_orders, vendors_by_name, soonest_stockouts, largest_profiles, top_categories, promised_first, dated_page, undated_page,
        overrides_by_key, managed_scan, drafts_with_lines, open_orders_of, item_debug,
    )
}

_NAMES = " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{key}' AS sub_key, '{label}' AS label, '{tone}' AS tone" for stage, own in so.TRIAGE.items() for key, (label, tone) in own.items())
_MORE = ORDERS | {
    "brand_sources": BRAND_VENDORS,
    "medians": _MEDIANS,
    "names": _NAMES,
    "keyed": "SELECT *, CASE flag WHEN 'none' THEN 'healthy' ELSE flag END AS sub_key FROM flagged",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_name, shop_id ORDER BY lead ASC NULLS LAST, distinct_items DESC, vendor_id) AS place FROM (
    SELECT b.*, s.shop_id, half_even(coalesce(l.lead_time_days, m.lead_time_days), 1) AS lead, CASE WHEN l.lead_time_days IS NOT NULL THEN 'store' WHEN m.lead_time_days IS NOT NULL THEN 'vendor_median' ELSE 'unknown' END AS source
    FROM brand_sources b CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS shop_id) s LEFT JOIN lead_times l ON l.vendor_id = b.vendor_id AND l.shop_id = s.shop_id LEFT JOIN medians m ON m.vendor_id = b.vendor_id)) WHERE place <= 3""",
    "candidates": """SELECT brand_name, shop_id, string_agg(vendor_id || ':' || CASE WHEN lead IS NOT NULL THEN trunc(lead)::BIGINT || ':' ELSE '' END || source, ';' ORDER BY place) AS vendors, lower(string_agg(vendor_name, ' ' ORDER BY place)) AS vendor_names FROM best GROUP BY ALL""",
    "enriched": """SELECT f.*, s.customer_name, i.description, i.brand, v.vendor_name, coalesce(c.vendors, '') AS vendors, coalesce(c.vendor_names, '') AS vendor_names FROM flagged f LEFT JOIN sales s USING (sale_id) LEFT JOIN items i USING (item_id)
    LEFT JOIN vendors v ON v.vendor_id = f.vendor_id LEFT JOIN candidates c ON c.brand_name = i.brand AND c.shop_id = f.shop_id""",
    "heads": "SELECT DISTINCT order_id, order_name, eta FROM open_web",
    "unmatched": """SELECT order_id, min(order_name) AS order_name, min(eta) AS eta FROM open_web WHERE order_id NOT IN (SELECT order_id FROM taken)
    AND order_id NOT IN (SELECT order_id FROM pairs WHERE special_order_id IN (SELECT special_order_id FROM adopting)) GROUP BY 1""",
    "sent": "SELECT *, vendor_id || '-' || shop_id AS draft_id FROM po_lines WHERE tag IS NOT NULL",
}
_NEEDLE = " OR ".join(f"lower({c}::VARCHAR) LIKE '%#00000000%'" for c in ("customer_name", "customer_email", "description", "system_sku", "brand", "vendor_name", "po_id", "special_order_id", "web_order_name", "vendor_names"))
_SIDE = lambda s: f"{{'units_30': {s}_units_30::BIGINT, 'units_60': {s}_units_60::BIGINT, 'line': {s}_line::BIGINT, 'on_order': {s}_on_order::BIGINT}}"


def _debug() -> str:
    from .stock import ORACLES as STOCK

    sql = STOCK["raw_and_deduplicated"]
    return f"SELECT item_id, to_json(list({{'shop_id': shop_id, 'raw': {_SIDE('raw')}, 'latest': {_SIDE('latest')}}} ORDER BY shop_id))::VARCHAR AS shops FROM ({sql}) GROUP BY 1"


ORACLES = {
    "sought_page": over("SELECT special_order_id, expected_date FROM flagged WHERE expected_date > DATE '1998-03-01' OR expected_date IS NULL OR expected_date = DATE '1998-03-01' AND special_order_id > 0 ORDER BY expected_date ASC NULLS LAST, special_order_id LIMIT 30", **_MORE),
    "newest_levels": over("SELECT updated_time::DATE AS day, item_id, shop_id, qoh FROM stock_log WHERE updated_time::DATE = (SELECT max(updated_time::DATE) FROM stock_log) QUALIFY row_number() OVER (PARTITION BY item_id, shop_id ORDER BY updated_time DESC, event_id DESC) = 1"),
    "units_of_shops": over("SELECT item_id, shop_id, sum(quantity) AS units, count(*) AS lines FROM sale_lines JOIN sales USING (sale_id) WHERE shop_id IN (0, 1, 2) AND status IN ('F', 'P') AND complete_time >= DATE '2001-01-01' GROUP BY ALL"),
    "item_relations": over("""SELECT item_id, sku, '{' || coalesce(string_agg('"' || shop_id || '":' || (item_id * 10 + shop_id), ',' ORDER BY shop_id), '') || '}' AS shops, max(CASE WHEN shop_id = 1 THEN item_id * 10 + 1 END) AS in_shop_1
  FROM items LEFT JOIN (SELECT DISTINCT item_id, shop_id FROM stock_log) USING (item_id) GROUP BY item_id, sku"""),
    "triage": over("SELECT special_order_id, k.stage, flag, k.sub_key, coalesce(label, 'Healthy') AS label, coalesce(tone, 'ok') AS tone FROM keyed k LEFT JOIN names n ON n.stage = k.stage AND n.sub_key = k.sub_key", **_MORE),
    "triage_counts": over("SELECT n.stage, n.sub_key, n.label, count(k.sub_key) AS n FROM names n LEFT JOIN keyed k ON n.stage = k.stage AND n.sub_key = k.sub_key GROUP BY ALL", **_MORE),
    "enriched_orders": over("SELECT special_order_id, customer_name, customer_email, description, brand, shop_id, vendor_name, quantity, po_id, age_days, expected_date, web_order_name, vendors FROM enriched", **_MORE),
    "order_search": over(f"SELECT special_order_id, flag, shop_id, vendor_name FROM enriched WHERE flag <> 'none' AND shop_id = 1 AND ({_NEEDLE})", **_MORE),
    "live_orders": over("SELECT stage, brand, count(*) AS n FROM enriched WHERE age_days IS NULL OR age_days <= 365 GROUP BY ALL", **_MORE),
    "tagged_web_orders": over(
        """SELECT h.order_id, h.order_name, h.eta, CASE WHEN h.order_id % 3 = 0 THEN 'note ' || h.order_id END AS field, w.sku FROM heads h JOIN open_web w ON w.order_id = h.order_id AND w.sku IS NOT NULL
  CROSS JOIN (SELECT unnest([1, 2]) AS copy) WHERE h.order_id % 4 = 0 OR h.order_id % 4 = 1 AND copy = 1""",
        **_MORE,
    ),
    "all_web_orders": over("SELECT DISTINCT order_id, order_name, CASE WHEN order_id % 5 <> 0 THEN sku END AS sku FROM open_web", **_MORE),
    "vendors_by_name": over("SELECT vendor_id, CASE WHEN vendor_id % 7 <> 0 THEN vendor_name END AS vendor_name FROM vendors ORDER BY coalesce(CASE WHEN vendor_id % 7 <> 0 THEN vendor_name END, ''), vendor_id LIMIT 20"),
    "soonest_stockouts": over("SELECT item_id, shop_id, coalesce(min(CASE WHEN stockout_risk = 'critical' THEN step - 1 END), 12) AS steps_to_critical FROM covered GROUP BY ALL ORDER BY 3, 1, 2 LIMIT 40", **FORECASTS),
    "largest_profiles": over("SELECT level, category, round(total, 4) AS sample_units FROM level_index WHERE level <> 'category_path' AND month = 1 ORDER BY 3 DESC, 1, 2 LIMIT 10", **FORECASTS),
    "top_categories": over("SELECT category, sum(units) AS units FROM top_months GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4", **FORECASTS),
    "promised_first": over("SELECT order_id, order_name, eta FROM unmatched ORDER BY eta ASC NULLS LAST, order_name, order_id LIMIT 30", **_MORE),
    "dated_page": over("SELECT special_order_id, expected_date FROM flagged ORDER BY expected_date ASC NULLS LAST, special_order_id LIMIT 30 OFFSET 30", **_MORE),
    "undated_page": over("SELECT special_order_id, expected_date FROM flagged ORDER BY expected_date DESC NULLS FIRST, special_order_id LIMIT 30", **_MORE),
    "overrides_by_key": over("SELECT sku || '_' || location_id AS sku_location, manual_reorder_point, manual_desired_level, locked FROM overrides"),
    "managed_scan": over("SELECT sku, item_id::VARCHAR AS item_id, description AS product, brand, category_top_level AS category FROM items WHERE item_id % 3 = 0"),
    "drafts_with_lines": over("SELECT draft_id, vendor_id, shop_id, 'draft' AS status, string_agg(item_id || ':' || quantity || ':' || tag, ';' ORDER BY item_id, quantity, tag) AS lines FROM sent WHERE vendor_id % 2 = 0 GROUP BY ALL", **_MORE),
    "open_orders_of": over("SELECT order_id, line_no, vendor_id, item_id, open_quantity FROM open_po WHERE shop_id = 1 AND vendor_id % 2 = 0 AND vendor_id < 1000", **_MORE),
    "item_debug": _debug(),
}
