"""Logs of changed levels, one row per level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def level_changes(log: DataFrame) -> DataFrame:
    """(log_id, sku, location_id, field, old_value, new_value) of each row of the write-back log: the desired level if it changed, the reorder
    point if it changed or nothing did.
    """
    point = ~F.col("old_reorder_point").eqNullSafe(F.col("new_reorder_point"))
    level = ~F.col("old_desired_level").eqNullSafe(F.col("new_desired_level"))
    one = lambda name: F.struct(F.lit(name).alias("field"), F.col(f"old_{name}").alias("old_value"), F.col(f"new_{name}").alias("new_value"))
    both = F.array(F.when(point | ~level, one("reorder_point")), F.when(level, one("desired_level")))
    return log.select("log_id", "sku", "location_id", F.explode(F.array_compact(both)).alias("c")).select("log_id", "sku", "location_id", "c.*")


def tally(log: DataFrame) -> DataFrame:
    """Successes and failures by location."""
    return log.groupBy("location_id").agg(F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") != "success").alias("failed"))


def run_summary(rows: DataFrame, run_id: str, at, by: str) -> DataFrame:
    """One row about a run of recommendations, for the log of runs."""
    return rows.agg(F.count("*").alias("items"), F.count_if(F.col("qty_to_order") > 0).alias("needs_order")).select(F.lit(run_id).alias("run_id"), F.lit(at).cast("timestamp").alias("run_at"), "items", "needs_order", F.lit(by).alias("triggered_by"))


def velocity_snapshot(rows: DataFrame, run_id: str, at) -> DataFrame:
    """Unrounded velocities of a run, for their log."""
    return rows.select(F.lit(run_id).alias("run_id"), F.lit(at).cast("timestamp").alias("run_at"), "item_id", F.col("shop_id").alias("location_id"), F.col("base_velocity").alias("raw_daily_sales"))


def writeback_outbox(rows: DataFrame, log_id: str = "", at=None) -> DataFrame:
    """What would be sent to the point of sale: rows whose levels change. Sending it is left to whoever reads the table."""
    changed = rows.where("change_needed")
    return changed.select(
        F.concat(F.lit(log_id), F.col("sku"), F.lit("@"), F.col("shop_id").cast("string")).alias("log_id"),
        F.lit(at).cast("timestamp").alias("logged_at"),
        "sku",
        F.col("shop_id").alias("location_id"),
        F.col("current_reorder_point").alias("old_reorder_point"),
        F.col("reorder_point").alias("new_reorder_point"),
        F.col("current_desired_level").alias("old_desired_level"),
        F.col("desired_level").alias("new_desired_level"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def push_log(plan: DataFrame, draft_id: str, at) -> DataFrame:
    """Rows for the log of pushed orders from a plan of pushes (item_id, action, line_quantity, order_id): pending, until whoever sends them says how it went."""
    return plan.select(F.lit(draft_id).alias("draft_id"), F.lit(at).cast("timestamp").alias("logged_at"), "item_id", "action", F.col("line_quantity").alias("quantity"), F.col("order_id").alias("target_order_id"), F.lit("pending").alias("status"))


def eta_outbox(orders: DataFrame, days: int, at) -> DataFrame:
    """Promised dates to be sent to the web shop, for their log too: that of each order (order_id, eta), so many days later; one without a date gets none."""
    changed = orders.where("eta is not null").select("order_id", F.lit(at).cast("timestamp").alias("logged_at"), F.col("eta").alias("old_eta"), F.date_add("eta", days).alias("new_eta"))
    return changed.distinct()


def newest_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    """The last n runs, newest first; of runs at one time the smaller id comes first."""
    return runs.orderBy(F.desc("run_at"), "run_id").limit(n)
