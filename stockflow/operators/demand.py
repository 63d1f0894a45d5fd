"""Units sold and days with sales, by item and shop, over windows that end at a day; monthly history."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from .stock import PAIR

#: Sales before this day are never history.
FIRST_DAY = date(2024, 1, 1)


def counted_sales(sales: DataFrame) -> DataFrame:
    """Completed sales that weren't voided; where either is unknown the sale doesn't count."""
    return sales.where(F.col("completed") & ~F.col("voided"))


def sold_lines(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """Lines of sales that count, with the sale's shop and time."""
    return lines.join(counted_sales(sales).select("sale_id", "shop_id", "complete_time"), "sale_id")


def windowed_sales(sold: DataFrame, as_of: date, spans: tuple[int, ...] = (14, 30, 60)) -> DataFrame:
    """(item_id, shop_id, units_N ..., sale_days_N ...) over the last N days, as_of included; there is no upper bound.

    Days are summed first, so that days with sales are counted as rows and nothing is expanded.
    """
    return windows_of_days(daily_units(sold, as_of - timedelta(days=max(spans) - 1)), as_of, spans)


def daily_units(sold: DataFrame, first: date, last: date | None = None) -> DataFrame:
    """(item_id, shop_id, day, units) of the days with sales, from first on."""
    rows = sold.withColumn("day", F.to_date("complete_time")).where(F.col("day") >= F.lit(first))
    rows = rows.where(F.col("day") <= F.lit(last)) if last else rows
    return rows.groupBy(*PAIR, "day").agg(F.sum("quantity").alias("units"))


def windows_of_days(days: DataFrame, as_of: date, spans: tuple[int, ...]) -> DataFrame:
    """windowed_sales of daily_units."""
    within = {n: F.col("day") >= F.lit(as_of - timedelta(days=n - 1)) for n in spans}
    units = [F.sum(F.when(within[n], F.col("units")).otherwise(0.0)).alias(f"units_{n}") for n in spans]
    return days.groupBy(*PAIR).agg(*units, *(F.count_if(within[n]).alias(f"sale_days_{n}") for n in spans))


def units_since(sold: DataFrame, since: date | datetime) -> DataFrame:
    """(item_id, shop_id, units_sold) from a moment on."""
    return sold.where(F.col("complete_time") >= F.lit(since).cast("timestamp_ntz")).groupBy(*PAIR).agg(F.sum("quantity").alias("units_sold"))


def open_purchases(orders: DataFrame) -> DataFrame:
    """(sale_id, shop_id) of orders that are neither complete nor archived."""
    return orders.where(~F.coalesce(F.col("received"), F.lit(False)) & ~F.coalesce(F.col("voided"), F.lit(False))).select("sale_id", "shop_id")


def lines_of_open_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The lines, in all versions, of open purchases: what stands together by sale_id then isn't exchanged again to tell versions apart, nor to sum them up."""
    return lines.join(open_purchases(orders).select("sale_id"), "sale_id", "left_semi")


def open_purchase_units(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """(item_id, shop_id, po_units): units ordered and not received yet, on orders that are neither complete nor archived."""
    open_ = open_purchases(orders)
    left = F.col("quantity") - F.coalesce(F.col("num_received"), F.lit(0.0))
    return lines.join(open_, "sale_id").groupBy(*PAIR).agg(F.sum(left).alias("po_units"))


def history_bounds(as_of: date, years: int, floor: date = FIRST_DAY) -> tuple[date, date]:
    """From so many years back, but no earlier than floor, to the first of the current month, which is left out."""
    back = as_of.replace(year=as_of.year - years, day=min(as_of.day, 28) if as_of.month == 2 else as_of.day)
    return max(back, floor), as_of.replace(day=1)


def monthly_history(sold: DataFrame, keys: list[str | Column], as_of: date, years: int, floor: date = FIRST_DAY) -> DataFrame:
    """Units by keys, year and month, without warranty lines and the running month."""
    first, end = history_bounds(as_of, years, floor)
    day = F.to_date("complete_time")
    rows = sold.where((day >= F.lit(first)) & (day < F.lit(end)) & ~F.coalesce(F.col("is_warranty"), F.lit(False)))
    return rows.groupBy(*keys, F.year("complete_time").alias("year"), F.month("complete_time").alias("month")).agg(F.sum("quantity").alias("units"))
