"""Lead times of vendors from purchase orders, and which of them an item gets."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import name_key, whole_days

#: Lead times counted, in days, both ends included; the lead time of an item without any.
RANGE, DEFAULT = (0, 40), 14.0


def lead_days() -> Column:
    return whole_days(F.col("po_ordered_at"), F.col("first_received_at"))


def months_back(day: date, months: int) -> date:
    total = day.year * 12 + day.month - 1 - months
    year, month = divmod(total, 12)
    last = (date(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month + 1, min(day.day, last))


def median_lead_times(report: DataFrame, as_of: date, months: int = 3) -> DataFrame:
    """(vendor_id, shop_id, lead_time_days, po_count): the exact median, up to whole days, of orders placed in the last months.

    percentile keeps counts of distinct values, which are RANGE at most, so a vendor of any size is a few numbers in each task.
    """
    recent = report.where(F.col("po_ordered_at") >= F.lit(months_back(as_of, months)).cast("timestamp_ntz")).withColumn("lead", lead_days())
    recent = recent.where(F.col("lead").between(*RANGE))
    return recent.groupBy("vendor_id", "shop_id").agg(F.ceil(F.percentile("lead", F.lit(0.5))).cast("double").alias("lead_time_days"), F.count("lead").alias("po_count"))


def vendor_medians(lead_times: DataFrame) -> DataFrame:
    """(vendor_id, lead_time_days): the median of a vendor's shops, whatever their counts."""
    return lead_times.where("vendor_id is not null").groupBy("vendor_id").agg(F.percentile("lead_time_days", F.lit(0.5)).alias("lead_time_days"))


def active_vendors(report: DataFrame, names: DataFrame, rules: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """A row per vendor with receipts in the last days: counts, the latest receipt, lead times by shop as an array by shop_id,
    and the brands that prefer it. A vendor without a name is called by its id.
    """
    since = datetime.combine(as_of - timedelta(days=days), datetime.min.time())
    recent = report.where((F.col("first_received_at") >= F.lit(since).cast("timestamp_ntz")) & F.col("vendor_id").isNotNull())
    counts = recent.groupBy("vendor_id").agg(F.count_distinct("order_id").alias("active_po_count"), F.max("first_received_at").alias("last_received_at"))
    timed = recent.withColumn("lead", lead_days()).where(F.col("lead").between(*RANGE))
    by_shop = timed.groupBy("vendor_id", "shop_id").agg(F.ceil(F.percentile("lead", F.lit(0.5))).cast("double").alias("lead_time_days"), F.count_distinct("order_id").alias("po_count"))
    arrays = by_shop.groupBy("vendor_id").agg(F.sort_array(F.collect_list(F.struct("shop_id", "lead_time_days", "po_count"))).alias("location_lead_times"), F.sum("po_count").alias("sample_count"))
    preferred = rules.where("active").groupBy(F.col("preferred_vendor_id").cast("long").alias("vendor_id")).agg(F.sort_array(F.collect_list("brand_name")).alias("configured_brands"))
    rows = counts.join(arrays, "vendor_id", "left").join(names, "vendor_id", "left").join(preferred, "vendor_id", "left")
    return rows.select(
        "vendor_id",
        F.coalesce("vendor_name", F.concat(F.lit("Vendor "), F.col("vendor_id").cast("string"))).alias("vendor_name"),
        "active_po_count",
        F.coalesce("sample_count", F.lit(0)).alias("active_sample_count"),
        "last_received_at",
        F.coalesce("location_lead_times", F.array().cast("array<struct<shop_id:bigint,lead_time_days:double,po_count:bigint>>")).alias("location_lead_times"),
        F.coalesce("configured_brands", F.array().cast("array<string>")).alias("configured_brands"),
    )


def at_location(location_lead_times: Column, shop: int | Column) -> Column:
    """A vendor's entry for one shop, or null."""
    return F.get(F.filter(location_lead_times, lambda x: x["shop_id"] == shop), F.lit(0))


def with_lead_time(rows: DataFrame, lead_times: DataFrame, rules: DataFrame, default: float = DEFAULT) -> DataFrame:
    """rows (vendor_id, shop_id, brand) with lead_time_days, lead_time_source, lead_time_vendor_id and po_count.

    That of the brand's preferred vendor in the shop comes first, then that of the item's own vendor, then the default.
    """
    known = lead_times.select("vendor_id", "shop_id", "lead_time_days", "po_count")
    rule = rules.where("active").select(name_key(F.col("brand_name")).alias("rule_brand"), F.col("preferred_vendor_id").cast("long").alias("preferred_id"), F.col("preferred_vendor_name").alias("preferred_name"))
    own = known.select(F.col("vendor_id"), F.col("shop_id"), F.col("lead_time_days").alias("own_lead"), F.col("po_count").alias("own_count"))
    preferred = known.select(F.col("vendor_id").alias("preferred_id"), F.col("shop_id"), F.col("lead_time_days").alias("preferred_lead"), F.col("po_count").alias("preferred_count"))
    found = rows.join(rule, name_key(F.col("brand")) == F.col("rule_brand"), "left").join(preferred, ["preferred_id", "shop_id"], "left").join(own, ["vendor_id", "shop_id"], "left")
    by_rule, by_item = F.col("preferred_lead").isNotNull(), F.col("own_lead").isNotNull()
    pick = lambda a, b, c: F.when(by_rule, a).when(by_item, b).otherwise(c)
    return found.withColumns(
        {
            "lead_time_days": F.coalesce("preferred_lead", "own_lead", F.lit(default)),
            "lead_time_source": pick(F.lit("preferred_vendor"), F.lit("item_vendor"), F.lit("default")),
            "lead_time_vendor_id": pick(F.col("preferred_id"), F.col("vendor_id"), F.lit(None)),
            "lead_time_po_count": pick(F.col("preferred_count"), F.col("own_count"), F.lit(0)),
        }
    ).drop("rule_brand", "preferred_id", "preferred_name", "preferred_lead", "preferred_count", "own_lead", "own_count")
