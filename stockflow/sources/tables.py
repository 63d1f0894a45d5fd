"""The logical tables of the library, built from order, part and event tables.

Ids are long everywhere. Item ids are part keys + 1, as an id of 0 stands for no item.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The day that queries look back from.
AS_OF = date(2001, 8, 1)
#: Shops that are replenished.
TARGET_SHOPS = (0, 1, 2)
#: Events are this many days younger than the orders that they belong to.
LOG_SHIFT_DAYS = 8217
#: Kinds of events, by the shop that they stand for.
LOG_SHOPS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    level_2 = F.concat_ws("/", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("item_id"),
        F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category_top_level"),
        level_2.alias("category_level_2"),
        F.concat_ws("/", level_2, F.col("p_size").cast("string")).alias("category_path"),
        F.col("p_size").cast("long").alias("reorder_point"),
        (F.col("p_size") * 2).cast("long").alias("reorder_level"),
    )


def customer_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("shop_id"))
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), "shop_id")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order, as a sale and as a purchase order."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sale_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") != "O").alias("completed"),
        (F.col("o_orderpriority") == "5-LOW").alias("voided"),
        F.col("o_orderdate").alias("complete_time"),
        (F.col("o_orderstatus") == "F").alias("received"),
    )
    return orders.join(customer_shops(spark, sf_dir), "customer_id")


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of lines: (sale_id, line_no) comes up more than once."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sale_id"),
        F.col("l_linenumber").cast("long").alias("line_no"),
        (F.col("l_partkey") + 1).alias("item_id"),
        F.col("l_suppkey").alias("vendor_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.least(F.col("l_quantity"), F.col("l_linenumber").cast("double")).alias("num_received"),
        (F.col("l_returnflag") == "R").alias("is_warranty"),
        F.col("l_shipdate").alias("updated_time"),
    )


LINE_ID = ["sale_id", "line_no"]


def newest_line() -> list[Column]:
    """The newest version of a line comes first; no two versions that differ are tied."""
    return [F.desc(c) for c in ("updated_time", "item_id", "vendor_id", "quantity", "price")]


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"))


def stock_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the quantity on hand of an item in a shop."""
    shop = F.array_position(F.array(*map(F.lit, LOG_SHOPS)), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") + 1).alias("item_id"),
        shop.cast("long").alias("shop_id"),
        (F.floor("value") - 10).cast("long").alias("qoh"),
        (F.col("ts") - F.make_dt_interval(F.lit(LOG_SHIFT_DAYS))).alias("updated_time"),
    )


def purchase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per ordered line: when it was ordered, and when it was first received."""
    lines = sale_lines(spark, sf_dir).select("sale_id", "item_id", "vendor_id", F.col("updated_time").alias("first_received_at"))
    orders = sales(spark, sf_dir).select("sale_id", "shop_id", F.col("complete_time").alias("po_ordered_at"))
    return lines.join(orders, "sale_id").withColumnRenamed("sale_id", "order_id")


def brand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred vendors of brands: those whose number divides by 3 have a rule, and every other one of them is active."""
    number = F.regexp_extract("brand", r"(\d+)$", 1).cast("long")
    brands = items(spark, sf_dir).select("brand").distinct().withColumn("number", number)
    return brands.where("number % 3 = 0").select(
        F.col("brand").alias("brand_name"), F.col("number").cast("string").alias("preferred_vendor_id"), F.concat(F.lit("Preferred "), F.col("number").cast("string")).alias("preferred_vendor_name"), (F.col("number") % 2 == 0).alias("active")
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual levels of every fifth item in target shops; of some of them one level only."""
    shop = F.explode(F.array(*(F.lit(s).cast("long") for s in TARGET_SHOPS)))
    return items(spark, sf_dir).where("item_id % 5 = 0").select("sku", shop.alias("location_id"), F.when(F.col("item_id") % 2 == 0, F.col("item_id") % 40).alias("manual_reorder_point"), (F.col("item_id") % 90).alias("manual_desired_level"), (F.col("item_id") % 3 == 0).alias("locked"))


#: Columns of special_lines that no special order has.
LINE_ONLY = ["line_no", "status", "updated_date"]


def special_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What special orders are made of: a row per line of a sale, its latest version, with few columns."""
    from ..operators.versions import latest_version

    # versions meet their sale first: what stands together by sale_id isn't exchanged again to tell versions apart
    # the price, which newest_line() looks at last, is none of an order's columns: versions that differ in nothing else give the same row
    line = latest_version(sale_lines(spark, sf_dir).join(sales(spark, sf_dir), "sale_id"), LINE_ID, newest_line()[:-1])
    return line.select("sale_id", "line_no", "customer_name", "item_id", "shop_id", "vendor_id", "quantity", "status", F.to_date("complete_time").alias("created_date"), F.to_date("updated_time").alias("updated_date"), F.col("voided").alias("done"))


def of_special_lines(rows: DataFrame) -> DataFrame:
    """Lines with the columns of their special orders. Every fifth has been told to its customer."""
    ordered = F.col("status").isin("P", "F")
    return rows.withColumns(
        {
            "special_order_id": F.col("sale_id") * 10 + F.col("line_no"),
            "customer_email": F.lower("customer_name"),
            "system_sku": (F.col("item_id") - 1).cast("string"),
            "po_id": F.when(ordered, F.col("sale_id")),
            "po_ordered_date": F.when(ordered & (F.col("line_no") % 3 != 0), F.col("created_date")),
            "po_arrival_date": F.when(ordered, F.col("updated_date")),
            "status_text": F.when(F.col("status") == "F", F.lit("Received")).when(F.col("status") == "P", F.lit("Ordered")).otherwise(F.lit("Not ordered")),
            "contacted": F.col("line_no") % 5 == 0,
        }
    )


def special_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items ordered for a customer: a row per line of a sale, its latest version."""
    return of_special_lines(special_lines(spark, sf_dir)).drop(*LINE_ONLY)


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the web shop, a row per line: every seventh sale."""
    lines = sale_lines(spark, sf_dir).where("sale_id % 7 = 0").select("sale_id", (F.col("item_id") - 1).cast("string").alias("sku")).distinct()
    orders = sales(spark, sf_dir).where("sale_id % 7 = 0")
    return orders.join(lines, "sale_id", "left").select(
        F.col("sale_id").alias("order_id"),
        F.concat(F.lit("#"), F.col("sale_id").cast("string")).alias("order_name"),
        F.lower("customer_name").alias("email"),
        F.when(F.col("received"), F.lit("FULFILLED")).when(F.col("status") == "P", F.lit("PARTIAL")).alias("fulfillment_status"),
        F.when(F.col("sale_id") % 11 == 0, F.lit("REFUNDED")).otherwise(F.lit("PAID")).alias("financial_status"),
        F.col("complete_time").alias("created_at"),
        F.when(F.col("sale_id") % 2 == 0, F.date_add(F.to_date("complete_time"), 21)).alias("eta"),
        "sku",
        "voided",
    )


def item_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, sku, shops): of each item a map from shop to the id that the item has there. It has an entry for each shop that the item was ever counted in, a few."""
    own = stock_log(spark, sf_dir).select("item_id", "shop_id").distinct()
    entry = F.struct("shop_id", (F.col("item_id") * 10 + F.col("shop_id")).alias("item_shop_id"))
    maps = own.groupBy("item_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("shops"))
    return items(spark, sf_dir).select("item_id", "sku").join(maps, "item_id", "left")
