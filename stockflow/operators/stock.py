"""Stock levels by day: the date spine, values carried forward, and days without stock."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PAIR = ["item_id", "shop_id"]


def date_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    """A row for each day, both ends included."""
    days = F.sequence(F.lit(first), F.lit(last), F.make_dt_interval(F.lit(1)))
    return spark.range(1).select(F.explode(days).alias("day"))


def forward_fill(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """value, and where it is null the last one before it; null before the first."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(so_far))


def forward_fill_in_ranges(rows: DataFrame, keys: list[str], order: str, value: str, span: int) -> DataFrame:
    """forward_fill by one whole number or date, for series that are too long for a task: a series is cut into ranges of `span` of order, or days.

    Each range's last known value goes, by a window over ranges only, to the ranges after it, and fills what stands before their own first one. A task
    sorts a range, and a row for each range of a series. Values of one place should be alike.
    """
    place = F.datediff(order, F.lit(date(1970, 1, 1))) if dict(rows.dtypes)[order] == "date" else F.col(order)
    cut = rows.withColumn("fill_range", F.floor(place / span))
    ends = cut.groupBy(*keys, "fill_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("fill_last"))
    before = Window.partitionBy(*keys).orderBy("fill_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(k).alias(f"fill_{k}") for k in keys), F.col("fill_range").alias("fill_at"), F.last("fill_last", ignorenulls=True).over(before).alias("fill_from"))
    same = [F.col(k).eqNullSafe(F.col(f"fill_{k}")) for k in keys] + [F.col("fill_range") == F.col("fill_at")]
    within = Window.partitionBy(*keys, "fill_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = cut.join(ends, same).withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(within), "fill_from"))
    return filled.select(*rows.columns)


def last_of_day(log: DataFrame, first: date, last: date) -> DataFrame:
    """(item_id, shop_id, day, qoh): the last known quantity of each day with a change. Tasks keep one row per day before the shuffle."""
    day = F.to_date("updated_time")
    known = log.where(F.col("qoh").isNotNull() & day.between(F.lit(first), F.lit(last)))
    return known.groupBy(*PAIR, day.alias("day")).agg(F.max_by("qoh", F.struct("updated_time", "event_id")).alias("qoh"))


def daily_levels(log: DataFrame, first: date, last: date) -> DataFrame:
    """(day, item_id, shop_id, qoh) for every pair and day; null before a pair's first change within the days."""
    changes = last_of_day(log, first, last)
    spine = changes.select(*PAIR).distinct().crossJoin(F.broadcast(date_spine(log.sparkSession, first, last)))
    return forward_fill(spine.join(changes, [*PAIR, "day"], "left"), PAIR, [F.col("day")], "qoh").select("day", *PAIR, "qoh")


def days_without_stock(log: DataFrame, as_of: date, spans: tuple[int, ...], longest: int | None = None) -> DataFrame:
    """(item_id, shop_id, days_out_of_stock_N ...): days of the last N, as_of included, that end with nothing on hand.

    A level holds until the next change, so the days of each stretch are counted from its ends: no row per day is made.
    Days before the first change within the longest span are unknown and don't count.
    """
    longest = longest or max(spans)
    return out_of_days(last_of_day(log, as_of - timedelta(days=longest - 1), as_of), as_of, spans)


def out_of_days(changes: DataFrame, as_of: date, spans: tuple[int, ...]) -> DataFrame:
    """days_without_stock of last_of_day."""
    until = F.coalesce(F.lead("day").over(Window.partitionBy(*PAIR).orderBy("day")), F.lit(as_of + timedelta(days=1)))
    stretches = changes.withColumn("until", until)

    def out(n: int) -> Column:
        days = F.greatest(F.datediff("until", F.greatest("day", F.lit(as_of - timedelta(days=n - 1)))), F.lit(0))
        return F.sum(F.when(F.col("qoh") <= 0, days).otherwise(0)).alias(f"days_out_of_stock_{n}")

    return stretches.groupBy(*PAIR).agg(*map(out, spans))


def days_without_stock_raw(log: DataFrame, as_of: date, spans: tuple[int, ...]) -> DataFrame:
    """As days_without_stock, but a day with k changes counts k times: each change's level, and levels carried over days without a change."""
    first = as_of - timedelta(days=max(spans) - 1)
    changes = log.select(*PAIR, F.to_date("updated_time").alias("day"), "qoh", "updated_time", "event_id").where(F.col("day").between(F.lit(first), F.lit(as_of)))
    spine = changes.select(*PAIR).distinct().crossJoin(F.broadcast(date_spine(log.sparkSession, first, as_of)))
    levels = forward_fill(spine.join(changes, [*PAIR, "day"], "left"), PAIR, [F.col("day"), F.col("updated_time"), F.col("event_id")], "qoh")
    return levels.groupBy(*PAIR).agg(*(F.count_if((F.col("qoh") <= 0) & (F.col("day") >= F.lit(as_of - timedelta(days=n - 1)))).alias(f"days_out_of_stock_{n}") for n in spans))


def current_levels(log: DataFrame) -> DataFrame:
    """(item_id, shop_id, qoh) by the newest change of each pair."""
    return log.groupBy(*PAIR).agg(F.max_by("qoh", F.struct("updated_time", "event_id")).alias("qoh"))
