"""Queries on stock levels, sales and purchase orders."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import demand, replenishment as rp, stock
from ..operators.lead_times import median_lead_times, with_lead_time
from ..operators.versions import latest_version, mark_latest
from ..sources import tables as t
from ..sources.kept import Days, kept, place_of, state_of
from .views import STATUS, over

SPANS = (14, 30, 60)
#: How far back lead times go here: the orders of the tables are few for each vendor.
LEAD_MONTHS = 36


def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest versions of the lines of items with a stock log, in target shops. Other lines go before versions are told apart."""
    qualified = t.stock_log(spark, sf_dir).select("item_id").distinct()
    shops = t.sales(spark, sf_dir).where(F.col("shop_id").isin(*t.TARGET_SHOPS)).select("sale_id")
    lines = t.sale_lines(spark, sf_dir).join(qualified, "item_id", "left_semi").join(shops, "sale_id", "left_semi")
    return latest_version(lines, t.LINE_ID, t.newest_line())


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_version(t.sale_lines(spark, sf_dir), t.LINE_ID, t.newest_line())


def latest_sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_lines(spark, sf_dir).select("sale_id", "line_no", "item_id", "quantity", "updated_time")


def daily_stock_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.daily_levels(t.stock_log(spark, sf_dir), t.AS_OF - timedelta(days=59), t.AS_OF)


def stockout_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.days_without_stock(t.stock_log(spark, sf_dir), t.AS_OF, SPANS)


def stockout_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.days_without_stock_raw(t.stock_log(spark, sf_dir), t.AS_OF, SPANS)


def windowed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.windowed_sales(demand.sold_lines(tagged_lines(spark, sf_dir), t.sales(spark, sf_dir)), t.AS_OF, SPANS)


def item_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per item and target shop of the stock log: levels, units on order, sales and days without stock of 14, 30 and 60 days.

    What has no sales or no changes counts as 0.
    """
    return metrics_with(spark, sf_dir, windowed_sales(spark, sf_dir), stock.days_without_stock(target_log(spark, sf_dir), t.AS_OF, SPANS))


def target_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.stock_log(spark, sf_dir).where(F.col("shop_id").isin(*t.TARGET_SHOPS))


def metrics_with(spark: SparkSession, sf_dir: str, sold: DataFrame, out: DataFrame) -> DataFrame:
    """item_metrics with given sales and days without stock."""
    pair = stock.PAIR
    log, lines = target_log(spark, sf_dir), t.sale_lines(spark, sf_dir)
    own = lines.groupBy("item_id").agg(F.min("vendor_id").alias("vendor_id"))
    on_order = demand.open_purchase_units(latest_version(demand.lines_of_open_orders(lines, t.sales(spark, sf_dir)), t.LINE_ID, t.newest_line()), t.sales(spark, sf_dir))
    rows = stock.current_levels(log).join(t.items(spark, sf_dir), "item_id").join(own, "item_id", "left").join(on_order, pair, "left")
    rows = rows.join(sold, pair, "left").join(out, pair, "left")
    counts = [f"{c}_{n}" for c in ("units", "sale_days", "days_out_of_stock") for n in SPANS]
    return rows.select(
        *pair, "sku", "description", "brand", "category_top_level", "category_path", "vendor_id", F.col("qoh").alias("on_hand"), F.coalesce("po_units", F.lit(0.0)).alias("on_order"),
        F.col("reorder_point").alias("current_reorder_point"), F.col("reorder_level").alias("current_desired_level"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
    )


INPUTS = ("part", "orders", "customer", "nation", "lineitem", "supplier", "events")


def days_of(spark: SparkSession, sf_dir: str, as_of: date) -> tuple[DataFrame, DataFrame]:
    """Units sold, and last levels, of each of the days that as_of looks back on: from tables with a folder for each day, of which only missing days are made."""
    inputs = [f"{sf_dir}/{name}.parquet" for name in INPUTS]
    first, state = as_of - timedelta(days=max(SPANS) - 1), state_of(spark, inputs)
    table = lambda name: Days(spark, place_of(spark, "days", name, inputs), state)
    units = table("units").read(first, as_of, lambda a, b: demand.daily_units(demand.sold_lines(tagged_lines(spark, sf_dir), t.sales(spark, sf_dir)), a, b))
    levels = table("levels").read(first, as_of, lambda a, b: stock.last_of_day(target_log(spark, sf_dir), a, b))
    return units, levels


def metrics_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_metrics from daily tables: another as-of date makes the days that it adds."""
    units, levels = days_of(spark, sf_dir, t.AS_OF)
    return metrics_with(spark, sf_dir, demand.windows_of_days(units, t.AS_OF, SPANS), stock.out_of_days(levels, t.AS_OF, SPANS))


def unified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shops, over 60 days before as_of and as_of itself; all versions of lines count."""
    days, pair = 61, stock.PAIR
    log = t.stock_log(spark, sf_dir)
    out = stock.days_without_stock(log, t.AS_OF, (days,)).withColumnRenamed(f"days_out_of_stock_{days}", "days_out_of_stock")
    sold = demand.sold_lines(t.sale_lines(spark, sf_dir), t.sales(spark, sf_dir)).where(F.to_date("complete_time") >= F.lit(t.AS_OF - timedelta(days=days - 1)))
    units = sold.groupBy(*pair).agg(F.sum("quantity").alias("units_sold"))
    levels = stock.current_levels(log).withColumnRenamed("qoh", "current_qoh")
    rows = levels.join(out, pair, "left").join(units, pair, "left").join(t.items(spark, sf_dir).select("item_id", "reorder_point", "reorder_level"), "item_id", "left")
    return rows.select(*pair, F.coalesce("units_sold", F.lit(0.0)).alias("units_sold"), F.coalesce("days_out_of_stock", F.lit(0)).alias("days_out_of_stock"), "current_qoh", "reorder_point", "reorder_level")


def sales_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = demand.sold_lines(t.sale_lines(spark, sf_dir), t.sales(spark, sf_dir))
    return demand.units_since(sold, datetime.combine(t.AS_OF, datetime.min.time()) - timedelta(days=60))


def stock_and_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest levels, and units on order over all versions of lines."""
    on_order = demand.open_purchase_units(t.sale_lines(spark, sf_dir), t.sales(spark, sf_dir))
    levels = stock.current_levels(t.stock_log(spark, sf_dir)).join(t.items(spark, sf_dir).select("item_id", "sku"), "item_id")
    return levels.join(on_order, stock.PAIR, "left").select(*stock.PAIR, "sku", "qoh", F.coalesce("po_units", F.lit(0.0)).alias("on_order"))


def raw_and_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units sold in 31 and 61 days and units on order, over all versions of lines and over the latest, by item and target shop.

    Lines and sales are read once: lines meet their sale, whose rows then stand together for the newest version of each line to be marked, and sums count what holds.
    """
    sales = t.sales(spark, sf_dir).where(F.col("shop_id").isin(*t.TARGET_SHOPS))
    day, yes = F.to_date("complete_time"), lambda c: F.coalesce(c, F.lit(False))
    sold = F.col("completed") & ~F.col("voided") & (day >= F.lit(t.AS_OF - timedelta(days=60)))
    facts = {"sold": yes(sold), "recent": yes(day >= F.lit(t.AS_OF - timedelta(days=30))), "open": ~yes(F.col("received")) & ~yes(F.col("voided"))}
    sales = sales.select("sale_id", "shop_id", *(c.alias(name) for name, c in facts.items())).where("sold or open")
    rows = mark_latest(t.sale_lines(spark, sf_dir).join(sales, "sale_id"), t.LINE_ID, t.newest_line(), "latest").withColumn("raw", F.lit(True))
    left = F.col("quantity") - F.coalesce("num_received", F.lit(0.0))
    values = {"units_30": ("sold and recent", F.col("quantity"), F.lit(0.0)), "units_60": ("sold", F.col("quantity"), F.lit(0.0)), "line": ("sold", F.lit(1), F.lit(0)), "on_order": ("open", left, F.lit(0.0))}
    of = lambda side, name, holds, value, zero: F.sum(F.when(F.expr(f"{side} and {holds}"), value).otherwise(zero)).alias(f"{side}_{name}")
    return rows.groupBy(*stock.PAIR).agg(*(of(side, name, *v) for side in ("raw", "latest") for name, v in values.items()))


def qualification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: items, those with a stock log, those with sales, pairs, and the shops of the log."""
    log = t.stock_log(spark, sf_dir)
    logged = log.select("item_id", F.lit(True).alias("logged")).distinct()
    sold = t.sale_lines(spark, sf_dir).select("item_id", F.lit(True).alias("sold")).distinct()
    items = t.items(spark, sf_dir).join(logged, "item_id", "left").join(sold, "item_id", "left").agg(F.count("*").alias("items"), F.count_if(F.col("logged").isNotNull()).alias("qualified"), F.count_if(F.col("sold").isNotNull()).alias("with_sales"), F.count_if(F.col("logged").isNotNull() & F.col("sold").isNull()).alias("logged_without_sales"))
    shops = log.select(*stock.PAIR).distinct().agg(F.count("*").alias("pairs"), F.array_join(F.sort_array(F.collect_set("shop_id")), ",").alias("shops"), F.max("item_id").alias("last_item"))
    return items.crossJoin(shops)


def routed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = median_lead_times(t.purchase_report(spark, sf_dir), t.AS_OF, LEAD_MONTHS)
    return with_lead_time(item_metrics(spark, sf_dir), leads, t.brand_rules(spark, sf_dir))


def all_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By default settings. Metrics and velocities are a table that is kept, so that grids, orders and logs don't compute them again."""
    inputs = [f"{sf_dir}/{name}.parquet" for name in INPUTS]
    return rp.planned(kept(spark, "velocities", inputs, lambda: rp.velocities(routed_metrics(spark, sf_dir))))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_recommendations(spark, sf_dir)
    numbers = ["safety_stock", "reorder_point", "desired_level", "qty_to_order"]
    return rows.select(*stock.PAIR, "sku", "location", "on_hand", "on_order", "lead_time_days", "lead_time_source", "lead_time_po_count", *numbers, "status", "status_rank", "urgency", "momentum", "change_needed", F.round("base_velocity", 6).alias("velocity"))


def guarded_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The velocity of each window by each mode."""
    rows = rp.windows(item_metrics(spark, sf_dir))
    spans = (("14", 14), ("15_30", 16), ("31_60", 30))
    columns = []
    for k, n in spans:
        active = rp.active_days(n, F.col(f"days_out_of_stock_{k}"), F.col(f"sale_days_{k}"))
        columns.append(active.cast("long").alias(f"active_{k}"))
        columns += [F.round(rp.daily_sales(F.col(f"units_{k}"), n, active, mode), 6).alias(f"{mode}_{k}") for mode in rp.MODES]
    return rows.select(*stock.PAIR, *columns)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_recommendations(spark, sf_dir)
    return rows.groupBy("shop_id", "status").agg(F.count("*").alias("n"), F.sum("qty_to_order").alias("units_to_order"))


def momentum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_recommendations(spark, sf_dir).groupBy("momentum").agg(F.count("*").alias("n"))


def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.apply_overrides(all_recommendations(spark, sf_dir), t.overrides(spark, sf_dir))
    return rows.select(*stock.PAIR, "reorder_point", "desired_level", "locked", "status", "qty_to_order", "change_needed")


def adjusted_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_recommendations(spark, sf_dir)
    return rows.select(*stock.PAIR, *(F.round(F.col(f"velocity_{k}") * n, 4).alias(f"adjusted_{k}") for k, n in (("14", 14), ("15_30", 16), ("31_60", 30))), F.round(rp.trend_coefficient(F.col("velocity_14"), F.col("velocity_15_30"), F.col("velocity_31_60")), 6).alias("trend"))


QUERIES = {
    f.__name__: f
    for f in (
        recommendations, latest_sale_lines, daily_stock_levels, stockout_days, stockout_changes, windowed_sales, item_metrics, metrics_of_days, unified_metrics, sales_history, stock_and_orders,
        raw_and_deduplicated, qualification_counts, guarded_velocity, status_counts, momentum_counts, overridden, adjusted_demand,
    )
}

_MODES = ", ".join(
    f"""{a}::BIGINT AS active_{k}, round({u} / {a}, 6) AS raw_{k}, round(CASE WHEN {a} >= 7 THEN {u} / {a} ELSE {u} / {n}.0 END, 6) AS min_days_{k},
  round(least({u} / {a} * {n}, {u} * 2.0) / {n}.0, 6) AS cap_{k}, round({v}, 6) AS shrink_{k}"""
    for k, n, u, a, v in (("14", 14, "units_14", "act_a", "v_a"), ("15_30", 16, "u_b", "act_b", "v_b"), ("31_60", 30, "u_c", "act_c", "v_c"))
)
_HI = lambda n, o, by: f"(CASE WHEN {o} <= 0 THEN {n} > 0 ELSE {n} >= {o} * {1 + by}::DOUBLE END)"
_LO = lambda n, o, by: f"(CASE WHEN {o} <= 0 THEN false ELSE {n} <= {o} * {1 - by}::DOUBLE END)"
_MOMENTUM = f"""CASE WHEN units_60 <= 0 OR act_a < 3 OR act_b < 3 OR act_c < 7 THEN 'insufficient_data'
  WHEN units_14 < 3 AND v_a > 0 AND {_HI("v_a", "v_b", 1.0)} AND {_HI("v_a", "v_c", 1.0)} THEN 'spiky'
  WHEN {_HI("v_a", "v_c", 0.75)} AND {_HI("v_a", "v_b", 0.35)} THEN 'surging'
  WHEN {_HI("v_a", "v_b", 0.40)} AND v_b >= v_c OR {_HI("v_a", "v_c", 0.25)} AND {_HI("v_b", "v_c", 0.25)} THEN 'rising'
  WHEN {_LO("v_a", "v_b", 0.40)} AND v_b <= v_c OR {_LO("v_a", "v_c", 0.25)} AND {_LO("v_b", "v_c", 0.25)} THEN 'cooling' ELSE 'flat' END"""
STATUS_SQL = STATUS
_QTY = "greatest(0, trunc(desired_level - (greatest(on_hand, 0) + on_order)))::BIGINT"
_RANKS = "list_position(['critical', 'low', 'warning', 'healthy', 'incoming', 'on_target', 'high', 'overstock', 'no_demand'], status)::BIGINT"
_URGENT = "CASE status WHEN 'critical' THEN 5 WHEN 'low' THEN 4 WHEN 'warning' THEN 3 WHEN 'healthy' THEN 2 WHEN 'incoming' THEN 2 WHEN 'no_demand' THEN 0 ELSE 1 END::BIGINT"
RECOMMENDED = f"""SELECT *, {STATUS_SQL} AS status, {_QTY} AS qty_to_order, {_MOMENTUM} AS momentum,
  current_reorder_point <> reorder_point OR current_desired_level <> desired_level AS change_needed FROM planned"""
_SIDES = ", ".join(f"sum(CASE WHEN side = '{s}' THEN {c} ELSE 0 END)::{'BIGINT' if c == 'line' else 'DOUBLE'} AS {s}_{c}" for s in ("raw", "latest") for c in ("units_30", "units_60", "line", "on_order"))
_PARTS = " UNION ALL ".join(
    f"""SELECT item_id, shop_id, '{s}' AS side, CASE WHEN complete_time::DATE >= DATE '2001-07-02' THEN quantity ELSE 0 END AS units_30, quantity AS units_60, 1 AS line, 0.0 AS on_order
  FROM {lines} JOIN sales USING (sale_id) WHERE completed AND NOT voided AND shop_id IN (0, 1, 2) AND complete_time::DATE >= DATE '2001-06-02'
  UNION ALL SELECT item_id, shop_id, '{s}', 0, 0, 0, quantity - num_received FROM {lines} JOIN sales USING (sale_id) WHERE NOT received AND NOT voided AND shop_id IN (0, 1, 2)"""
    for s, lines in (("raw", "sale_lines"), ("latest", "latest_lines"))
)

ORACLES = {
    "recommendations": over(
        f"""SELECT item_id, shop_id, sku, CASE shop_id WHEN 0 THEN 'North' WHEN 1 THEN 'Centre' ELSE 'South' END AS location, on_hand, on_order, lead_time_days, lead_time_source, lead_time_po_count,
  safety_stock, reorder_point, desired_level, qty_to_order, status, {_RANKS} AS status_rank, {_URGENT} AS urgency, momentum, change_needed, round(v, 6) AS velocity FROM recommended""",
        recommended=RECOMMENDED,
    ),
    "latest_sale_lines": over(
        """SELECT sale_id, line_no, item_id, quantity, updated_time FROM sale_lines JOIN sales USING (sale_id) WHERE item_id IN (SELECT item_id FROM qualified) AND shop_id IN (0, 1, 2)
  QUALIFY row_number() OVER (PARTITION BY sale_id, line_no ORDER BY updated_time DESC, item_id DESC, vendor_id DESC, quantity DESC, price DESC) = 1"""
    ),
    "daily_stock_levels": over("SELECT day, item_id, shop_id, qoh FROM levels"),
    "stockout_days": over("SELECT * FROM stockouts"),
    "stockout_changes": over(
        """SELECT item_id, shop_id, count(*) FILTER (q <= 0 AND day >= DATE '2001-07-19') AS days_out_of_stock_14, count(*) FILTER (q <= 0 AND day >= DATE '2001-07-03') AS days_out_of_stock_30, count(*) FILTER (q <= 0) AS days_out_of_stock_60
  FROM (SELECT item_id, shop_id, day, last_value(qoh IGNORE NULLS) OVER (PARTITION BY item_id, shop_id ORDER BY day, updated_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q
    FROM (SELECT DISTINCT item_id, shop_id FROM changes) CROSS JOIN spine LEFT JOIN changes USING (item_id, shop_id, day)) GROUP BY ALL""",
        changes="SELECT *, updated_time::DATE AS day FROM stock_log WHERE updated_time::DATE BETWEEN DATE '2001-06-03' AND DATE '2001-08-01'",
    ),
    "windowed_sales": over("SELECT * FROM windowed"),
    "item_metrics": over("SELECT * FROM metrics"),
    "metrics_of_days": over("SELECT * FROM metrics"),
    "unified_metrics": over(
        """SELECT c.item_id, c.shop_id, coalesce(u.units_sold, 0) AS units_sold, coalesce(d.n, 0) AS days_out_of_stock, c.qoh AS current_qoh, i.reorder_point, i.reorder_level
  FROM current_levels c LEFT JOIN (SELECT item_id, shop_id, sum(quantity) AS units_sold FROM sale_lines JOIN sales USING (sale_id) WHERE completed AND NOT voided AND complete_time::DATE >= DATE '2001-06-02' GROUP BY ALL) u USING (item_id, shop_id)
  LEFT JOIN (SELECT item_id, shop_id, count(*) FILTER (q <= 0) AS n FROM (
    SELECT item_id, shop_id, last_value(qoh IGNORE NULLS) OVER (PARTITION BY item_id, shop_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q
    FROM (SELECT DISTINCT item_id, shop_id FROM wide_changes) CROSS JOIN wide_days LEFT JOIN wide_changes USING (item_id, shop_id, day)) GROUP BY ALL) d USING (item_id, shop_id) LEFT JOIN items i USING (item_id)""",
        wide_days="SELECT unnest(range(DATE '2001-06-02', DATE '2001-08-02', INTERVAL 1 DAY))::DATE AS day",
        wide_changes="""SELECT item_id, shop_id, updated_time::DATE AS day, qoh FROM stock_log WHERE updated_time::DATE BETWEEN DATE '2001-06-02' AND DATE '2001-08-01'
  QUALIFY row_number() OVER (PARTITION BY item_id, shop_id, updated_time::DATE ORDER BY updated_time DESC, event_id DESC) = 1""",
    ),
    "sales_history": over("SELECT item_id, shop_id, sum(quantity) AS units_sold FROM sale_lines JOIN sales USING (sale_id) WHERE completed AND NOT voided AND complete_time >= TIMESTAMP '2001-06-02' GROUP BY ALL"),
    "stock_and_orders": over(
        """SELECT item_id, shop_id, sku, qoh, coalesce(on_order, 0) AS on_order FROM current_levels JOIN items USING (item_id)
  LEFT JOIN (SELECT item_id, shop_id, sum(quantity - num_received) AS on_order FROM sale_lines JOIN sales USING (sale_id) WHERE NOT received AND NOT voided GROUP BY ALL) USING (item_id, shop_id)"""
    ),
    "raw_and_deduplicated": over(f"SELECT item_id, shop_id, {_SIDES} FROM ({_PARTS}) GROUP BY ALL"),
    "qualification_counts": over(
        """SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items WHERE item_id IN (SELECT item_id FROM qualified)) AS qualified, (SELECT count(*) FROM items WHERE item_id IN (SELECT item_id FROM sale_lines)) AS with_sales,
  (SELECT count(*) FROM items WHERE item_id IN (SELECT item_id FROM qualified) AND item_id NOT IN (SELECT item_id FROM sale_lines)) AS logged_without_sales,
  (SELECT count(*) FROM (SELECT DISTINCT item_id, shop_id FROM stock_log)) AS pairs, (SELECT string_agg(shop_id, ',' ORDER BY shop_id) FROM (SELECT DISTINCT shop_id FROM stock_log)) AS shops, (SELECT max(item_id) FROM stock_log) AS last_item"""
    ),
    "guarded_velocity": over(f"SELECT item_id, shop_id, {_MODES} FROM velocity"),
    "status_counts": over("SELECT shop_id, status, count(*) AS n, sum(qty_to_order)::BIGINT AS units_to_order FROM recommended GROUP BY ALL", recommended=RECOMMENDED),
    "momentum_counts": over("SELECT momentum, count(*) AS n FROM recommended GROUP BY ALL", recommended=RECOMMENDED),
    "overridden": over(
        f"""SELECT item_id, shop_id, reorder_point, desired_level, locked, {STATUS_SQL} AS status, {_QTY} AS qty_to_order, current_reorder_point <> reorder_point OR current_desired_level <> desired_level AS change_needed
  FROM (SELECT p.* EXCLUDE (reorder_point, desired_level), coalesce(o.manual_reorder_point, p.reorder_point) AS reorder_point, coalesce(o.manual_desired_level, p.desired_level) AS desired_level, coalesce(o.locked, false) AS locked
    FROM planned p LEFT JOIN overrides o ON o.sku = p.sku AND o.location_id = p.shop_id)"""
    ),
    "adjusted_demand": over(
        """SELECT item_id, shop_id, round(v_a * 14, 4) AS adjusted_14, round(v_b * 16, 4) AS adjusted_15_30, round(v_c * 30, 4) AS adjusted_31_60,
  round(CASE WHEN v_b * 0.6::DOUBLE + v_c * 0.4::DOUBLE <= 0 AND v_a <= 0 THEN 1 WHEN v_b * 0.6::DOUBLE + v_c * 0.4::DOUBLE <= 0 THEN 2 WHEN v_a <= 0 THEN 0.5 ELSE greatest(0.5, least(2.0, v_a / (v_b * 0.6::DOUBLE + v_c * 0.4::DOUBLE))) END::DOUBLE, 6) AS trend FROM velocity"""
    ),
}
