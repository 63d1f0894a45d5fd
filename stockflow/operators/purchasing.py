"""From recommendations to purchase orders: which order each line goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NEW, APPEND, ALREADY = "new_po", "append_to_open_po", "already_on_po"


def with_order_vendor(rows: DataFrame) -> DataFrame:
    """Adds order_vendor_id: the preferred vendor where the lead time is its, else the item's own."""
    by_rule = (F.col("lead_time_source") == "preferred_vendor") & F.col("lead_time_vendor_id").isNotNull()
    return rows.withColumn("order_vendor_id", F.when(by_rule, F.col("lead_time_vendor_id")).otherwise(F.col("vendor_id")))


def first_open_orders(open_lines: DataFrame) -> DataFrame:
    """(vendor_id, shop_id, target_order_id): the first open order of each vendor and shop."""
    return open_lines.groupBy("vendor_id", "shop_id").agg(F.min("order_id").alias("target_order_id"))


def open_items(open_lines: DataFrame) -> DataFrame:
    """A row per vendor, shop and item on an open order: the first order that holds it, and its units there."""
    return open_lines.groupBy("vendor_id", "shop_id", "item_id").agg(F.min("order_id").alias("item_order_id"), F.min_by("open_quantity", F.struct("order_id", "line_no")).alias("open_quantity"))


def reconciled(rows: DataFrame, open_lines: DataFrame) -> DataFrame:
    """Lines for purchase orders from recommendations (item_id, sku, shop_id, qty_to_order, ...), with tag and target_order_id.

    Nothing to order is a line only if the item is on an open order of the same vendor and shop. Otherwise a line goes on the first open
    order, or on a new one if there is none. Rows without a vendor or a shop go on no order.
    """
    rows = with_order_vendor(rows).where("order_vendor_id is not null and shop_id is not null")
    lines = rows.select(F.col("order_vendor_id").alias("vendor_id"), "shop_id", "item_id", "sku", F.col("qty_to_order").alias("quantity"))
    lines = lines.join(open_items(open_lines), ["vendor_id", "shop_id", "item_id"], "left").join(first_open_orders(open_lines), ["vendor_id", "shop_id"], "left")
    tag = F.when((F.col("quantity") <= 0) & F.col("item_order_id").isNotNull(), ALREADY).when(F.col("quantity") <= 0, None).when(F.col("target_order_id").isNotNull(), APPEND).otherwise(NEW)
    lines = lines.withColumn("tag", tag).where("tag is not null")
    return lines.withColumn("line_target_id", F.when(F.col("tag") == APPEND, F.col("target_order_id")))


def headers(lines: DataFrame) -> DataFrame:
    """A draft for each vendor and shop with a line."""
    return lines.groupBy("vendor_id", "shop_id").agg(F.min("target_order_id").alias("target_order_id"), F.count("*").alias("lines"), F.sum("quantity").alias("total_units"), F.count_if(F.col("tag") == ALREADY).alias("already_on_po"))


def push_plan(lines: DataFrame) -> DataFrame:
    """What to send for each line with units: raise the line that an open order has, add one to the first open order, or make one order for the draft."""
    rows = lines.where((F.col("tag") != ALREADY) & (F.col("quantity") > 0))
    on_order = F.col("item_order_id").isNotNull()
    action = F.when(on_order, "updated_line").when(F.col("target_order_id").isNotNull(), "appended_line").otherwise("created_po_line")
    return rows.select(
        "vendor_id", "shop_id", "item_id", "quantity", action.alias("action"), F.coalesce("item_order_id", "target_order_id").alias("order_id"), (F.when(on_order, F.coalesce("open_quantity", F.lit(0.0)).cast("long")).otherwise(0) + F.col("quantity")).alias("line_quantity")
    )


def push_outcome(results: DataFrame) -> DataFrame:
    """(draft_id, status, failed, succeeded): failed if any line did."""
    counts = results.groupBy("draft_id").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "success").alias("succeeded"))
    return counts.withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("pushed"))


def checked_lines(lines: DataFrame) -> DataFrame:
    """Edited lines with a whole quantity of 0 or more; text that isn't a number is 0, lines without an item go."""
    number = F.greatest(F.coalesce(F.floor(F.col("quantity").cast("string").try_cast("double")), F.lit(0)), F.lit(0)).cast("long")
    return lines.where("trim(cast(item_id as string)) <> ''").withColumn("quantity", number)
