"""Queries over made-up metrics of every part, in which all statuses, momenta and settings come up, and over logs that are made from them."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as c
from ..operators import audit, grid, purchasing, replenishment as rp
from ..sources import stores, tables as t
from .views import STATUS, over

AT = datetime(2001, 8, 1, 12)


def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each part as sums and remainders of its key: sales that rise, fall and stop, levels from empty to far too much, an unknown shop."""
    k = F.col("p_partkey")
    sells = F.when(k % 10 == 0, 0).otherwise(1)
    lately = F.when(k % 17 == 3, 0).otherwise(sells)  # those sell two units in all, in the last days
    units = [F.when(k % 17 == 3, 2).otherwise(sells * ((k * 7) % 23)), lately * ((k * 5) % 31), lately * ((k * 3) % 41)]
    sold, out = [k % 9, (k * 3) % 7, k % 11], [(k % 5) * 3, (k % 6) * 2, (k % 4) * 6]
    up_to = lambda x, n: reduce(lambda a, b: a + b, x[:n])
    rows = t.table(spark, sf_dir, "part").withColumns(
        {f"{name}_{days}": up_to(x, i + 1).cast(kind) for name, x, kind in (("units", units, "double"), ("sale_days", sold, "long"), ("days_out_of_stock", out, "long")) for i, days in enumerate((14, 30, 60))}
    )
    return rows.select(
        (k + 1).alias("item_id"), (k % 4).cast("long").alias("shop_id"), k.cast("string").alias("sku"), ((k * 11) % 60 - 6).cast("long").alias("on_hand"), ((k * 13) % 17).cast("double").alias("on_order"), (k % 20).cast("long").alias("current_reorder_point"),
        (k % 20 * 3).cast("long").alias("current_desired_level"), (k % 21 + 1).cast("double").alias("lead_time_days"), *[f"{n}_{d}" for n in ("units", "sale_days", "days_out_of_stock") for d in (14, 30, 60)],
    )


def scenario_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a recommendation says."""
    rows = rp.recommend(scenario_metrics(spark, sf_dir))
    adjusted = [f"adjusted_{k}" for k in ("14", "15_30", "31_60", "30", "60")]
    return rows.select("item_id", "location", F.round("base_velocity", 6).alias("velocity"), "safety_stock", "reorder_point", "desired_level", "qty_to_order", "status", "status_rank", "urgency", "status_reason", "days_of_stock", *adjusted, "momentum", "change_needed")


#: Settings in turn: presets, weights that follow from one share, growth, safety and forecast days, and modes.
SETTINGS = {
    **{name: rp.Settings(weights=w) for name, w in rp.PRESETS.items()},
    "share": rp.Settings(weights=(None, None, None), recent_30d_weight=0.6),
    "share_above_1": rp.Settings(weights=(None, None, None), recent_30d_weight=1.5),
    "growth": rp.Settings(growth=1.2, safety_days=3.0),
    "no_forecast": rp.Settings(forecast_days=None, safety_days=0.0),
    **{mode: rp.Settings(mode=mode, forecast_days=30.0) for mode in rp.MODES},
}


def grid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of one shop, some statuses and one category, with overrides, that need units and aren't locked."""
    rows = rp.apply_overrides(rp.recommend(scenario_metrics(spark, sf_dir)), t.overrides(spark, sf_dir))
    rows = rows.join(t.items(spark, sf_dir).select("item_id", "brand", "category_top_level", "category_level_2", "category_path"), "item_id")
    rows = grid.in_category(grid.chosen(rows, {"location": "North", "status": ["critical", "low", "warning", "healthy"], "brand": None}), "ECONOMY")
    return rows.where((F.col("qty_to_order") > 0) & ~F.col("locked")).select("item_id", "shop_id", "status", "qty_to_order")


def scenario_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity and levels by each of SETTINGS."""
    metrics = scenario_metrics(spark, sf_dir)
    parts = [rp.recommend(metrics, s).select("item_id", F.lit(name).alias("settings"), F.round("base_velocity", 6).alias("velocity"), "reorder_point", "desired_level") for name, s in SETTINGS.items()]
    return reduce(DataFrame.unionByName, parts)


def scenario_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity with a trend and a season, some of them below 0 or unknown, and a blend with an estimate for slow movers."""
    k = F.col("item_id") - 1
    trend, season, slow = F.when(k % 5 != 0, (k % 5 - 1) / 2.0), F.when(k % 7 != 0, (k % 7) / 3.0), F.when(k % 3 != 0, (k % 13) / 4.0)
    rows = rp.velocities(scenario_metrics(spark, sf_dir), trend=trend, season=season)
    blend = rp.enriched((k % 11 - 2) / 2.0, trend, season, slow, 0.25)
    return rows.select("item_id", F.round("base_velocity", 6).alias("velocity"), F.round(blend, 6).alias("blended"))


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of lines that were sent, by item: fifty drafts, of which some lines failed."""
    k = F.col("p_partkey")
    status = F.when(k % 50 < 20, "success").when(k % 3 == 0, "failed").otherwise("success")
    return t.table(spark, sf_dir, "part").select((k % 50).cast("string").alias("draft_id"), (k % 3).cast("long").alias("location_id"), k.cast("string").alias("sku"), status.alias("status"))


def push_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchasing.push_outcome(pushes(spark, sf_dir))


def writeback_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tally(pushes(spark, sf_dir))


def edited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as typed in: whole and broken numbers, numbers below 0, words, no item."""
    k = F.col("p_partkey")
    typed = F.when(k % 5 == 0, "some").when(k % 5 == 1, (k % 30).cast("string")).when(k % 5 == 2, F.concat((k % 9).cast("string"), F.lit(".75"))).when(k % 5 == 3, F.concat(F.lit("-"), (k % 8).cast("string")))
    lines = t.table(spark, sf_dir, "part").select(F.when(k % 11 == 0, F.lit(" ")).otherwise(k.cast("string")).alias("item_id"), typed.alias("quantity"))
    return purchasing.checked_lines(lines)


def scenario_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write-back log as it is exported, of recommendations whose levels change."""
    log = audit.writeback_outbox(rp.recommend(scenario_metrics(spark, sf_dir)), "run-", AT)
    return log.select(*stores.EXPORTED)


def velocity_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.velocity_snapshot(rp.recommend(scenario_metrics(spark, sf_dir)), "run-1", AT)
    return rows.withColumn("raw_daily_sales", F.round("raw_daily_sales", 9))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that clean up ids, names, dates, numbers and links, over texts made of each part's key."""
    k = F.col("p_partkey")
    one = F.when(k % 4 == 0, F.lit("0")).when(k % 4 == 1, F.lit(" ")).when(k % 4 == 2, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    said = F.when(k % 3 == 0, F.lit(" TRUE")).when(k % 3 == 1, F.lit("no"))
    day = F.when(k % 3 == 0, F.lit("2001-02-30T00:00:00Z")).when(k % 3 == 1, F.concat(F.lit("2001-03-1"), (k % 10).cast("string"), F.lit("T23:00:00-08:00")))
    first, last, company = F.when(k % 2 == 0, F.lit(" Ann")), F.when(k % 3 == 0, F.lit("Lee ")), F.when(k % 5 != 0, F.concat(F.lit("Co "), k.cast("string")))
    number = F.when(k % 2 == 0, (k / 4.0).cast("string")).otherwise("x")
    return t.table(spark, sf_dir, "part").select(
        k.alias("part_id"), c.id_text(one).alias("id"), c.says_true(said).alias("yes"), c.date_of_text(day).alias("day"), c.last_number(F.concat(F.lit("gid://shop/Order/"), F.when(k % 2 == 0, k.cast("string")).otherwise("a"))).alias("number_of_name"),
        c.person_name(first, last, company).alias("person"), c.link("https://pos.example/item/", one).alias("link"), c.short_number(k / 2.0).alias("short"), c.number_or(number, -1.0).alias("number"), F.size(c.as_list(one)).alias("listed"), c.month_after(k % 12 + 1, F.lit(3)).alias("month"),
    )


QUERIES = {f.__name__: f for f in (scenario_recommendations, grid_filter, scenario_settings, scenario_enriched, push_outcomes, writeback_tally, edited_lines, scenario_audit, velocity_snapshots, scalar_functions)}

_LATELY = "(CASE WHEN k % 17 = 3 OR k % 10 = 0 THEN 0 ELSE 1 END)"
_UNITS = ["CASE WHEN k % 17 = 3 THEN 2 WHEN k % 10 = 0 THEN 0 ELSE (k * 7) % 23 END", f"{_LATELY} * ((k * 5) % 31)", f"{_LATELY} * ((k * 3) % 41)"]
_SOLD, _OUT = ["k % 9", "(k * 3) % 7", "k % 11"], ["(k % 5) * 3", "(k % 6) * 2", "(k % 4) * 6"]
_SPANS = ", ".join(
    f"({' + '.join(f'({y})' for y in x[: i + 1])})::{kind} AS {name}_{days}"
    for name, x, kind in (("units", _UNITS, "DOUBLE"), ("sale_days", _SOLD, "BIGINT"), ("days_out_of_stock", _OUT, "BIGINT"))
    for i, days in enumerate((14, 30, 60))
)
_RATE = {
    "shrink": "{u} / {n}.0 + ({u} / {a} - {u} / {n}.0) * least(1.0, {a} / 10.0)",
    "raw": "{u} / {a}",
    "min_days": "CASE WHEN {a} >= 7 THEN {u} / {a} ELSE {u} / {n}.0 END",
    "cap": "least({u} / {a} * {n}, {u} * 2) / {n}.0",
}


def _velocity(mode: str, weights: tuple[float, float, float], growth: float = 1.0) -> str:
    parts = [f"({_RATE[mode].format(u=u, a=a, n=n)}) * {w!r}::DOUBLE" for (u, a, n), w in zip((("units_14", "act_a", 14), ("u_b", "act_b", 16), ("u_c", "act_c", 30)), weights, strict=True)]
    return f"greatest(0, {' + '.join(parts)}) * {growth!r}::DOUBLE"


def _levels(s: rp.Settings) -> str:
    """Levels of one setting, from made_active."""
    return f"""SELECT *, ceil(v * lead_time_days + safety_stock - 1e-9)::BIGINT AS reorder_point, ceil(v * {s.forecast_days or 60.0!r} - 1e-9)::BIGINT AS desired_level FROM (
    SELECT *, ceil(v * {s.safety_days!r} - 1e-9)::BIGINT AS safety_stock FROM (SELECT *, {_velocity(s.mode, s.shares, s.growth)} AS v FROM made_active))"""


_NUMBER = lambda x: f"(CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE ({x})::DOUBLE::VARCHAR END)"
_POSITION = _NUMBER("(greatest(on_hand, 0) + on_order)")
_REASON = "CASE status WHEN 'no_demand' THEN 'Neither level is set' WHEN 'incoming' THEN 'Orders reach the target, on hand is at the reorder point or below: ' || " + _NUMBER("greatest(on_hand, 0)") + " || ' for ' || reorder_point::VARCHAR " + " ".join(
    f"WHEN '{s}' THEN '{words}: ' || {_POSITION} || ' for ' || {level}::VARCHAR"
    for s, words, level in (
        ("overstock", "From 150% of the target on", "desired_level"), ("high", "From 120% of the target on", "desired_level"), ("on_target", "Near the target", "desired_level"), ("healthy", "Over 115% of the reorder point", "reorder_point"),
        ("warning", "Just over the reorder point", "reorder_point"), ("low", "Over half of the reorder point", "reorder_point"), ("critical", "Up to half of the reorder point", "reorder_point"),
    )
) + " END"
_HI = lambda n, o, by: f"(CASE WHEN {o} <= 0 THEN {n} > 0 ELSE {n} >= {o} * {1 + by}::DOUBLE END)"
_LO = lambda n, o, by: f"(CASE WHEN {o} <= 0 THEN false ELSE {n} <= {o} * {1 - by}::DOUBLE END)"
_MOMENTUM = f"""CASE WHEN units_60 <= 0 OR act_a < 3 OR act_b < 3 OR act_c < 7 THEN 'insufficient_data' WHEN units_14 < 3 AND v_a > 0 AND {_HI("v_a", "v_b", 1.0)} AND {_HI("v_a", "v_c", 1.0)} THEN 'spiky'
  WHEN {_HI("v_a", "v_c", 0.75)} AND {_HI("v_a", "v_b", 0.35)} THEN 'surging' WHEN {_HI("v_a", "v_b", 0.40)} AND v_b >= v_c OR {_HI("v_a", "v_c", 0.25)} AND {_HI("v_b", "v_c", 0.25)} THEN 'rising'
  WHEN {_LO("v_a", "v_b", 0.40)} AND v_b <= v_c OR {_LO("v_a", "v_c", 0.25)} AND {_LO("v_b", "v_c", 0.25)} THEN 'cooling' ELSE 'flat' END"""

_MORE = {
    "made": f"""SELECT k + 1 AS item_id, (k % 4)::BIGINT AS shop_id, k::VARCHAR AS sku, ((k * 11) % 60 - 6)::BIGINT AS on_hand, ((k * 13) % 17)::DOUBLE AS on_order, (k % 20)::BIGINT AS current_reorder_point, (k % 20 * 3)::BIGINT AS current_desired_level,
  (k % 21 + 1)::DOUBLE AS lead_time_days, {_SPANS}, k FROM (SELECT p_partkey AS k FROM part)""",
    "made_active": """SELECT *, greatest(1, least(14, greatest(14 - days_out_of_stock_14, sale_days_14, 3)))::DOUBLE AS act_a, greatest(1, least(16, greatest(16 - o_b, s_b, 3)))::DOUBLE AS act_b, greatest(1, least(30, greatest(30 - o_c, s_c, 3)))::DOUBLE AS act_c FROM (
    SELECT *, greatest(0, units_30 - units_14) AS u_b, greatest(0, units_60 - units_30) AS u_c, least(16, greatest(0, days_out_of_stock_30 - days_out_of_stock_14)) AS o_b, least(30, greatest(0, days_out_of_stock_60 - days_out_of_stock_30)) AS o_c,
      least(16, greatest(0, sale_days_30 - sale_days_14)) AS s_b, least(30, greatest(0, sale_days_60 - sale_days_30)) AS s_c FROM made)""",
    "made_rates": f"SELECT *, {', '.join(f'({_RATE["shrink"].format(u=u, a=a, n=n)}) AS {v}' for u, a, n, v in (('units_14', 'act_a', 14, 'v_a'), ('u_b', 'act_b', 16, 'v_b'), ('u_c', 'act_c', 30, 'v_c')))} FROM ({_levels(rp.Settings())})",
    "made_status": f"SELECT *, {STATUS} AS status, current_reorder_point <> reorder_point OR current_desired_level <> desired_level AS change_needed FROM made_rates",
    "made_manual": """SELECT m.* EXCLUDE (reorder_point, desired_level), coalesce(o.manual_reorder_point, m.reorder_point) AS reorder_point, coalesce(o.manual_desired_level, m.desired_level) AS desired_level, coalesce(o.locked, false) AS locked
    FROM made_rates m LEFT JOIN overrides o ON o.sku = m.sku AND o.location_id = m.shop_id""",
    "made_pushes": "SELECT (k % 50)::VARCHAR AS draft_id, k % 3 AS location_id, CASE WHEN k % 50 < 20 THEN 'success' WHEN k % 3 = 0 THEN 'failed' ELSE 'success' END AS status FROM made",
}
_TREND, _SEASON = "greatest(0, coalesce(CASE WHEN k % 5 <> 0 THEN (k % 5 - 1) / 2.0::DOUBLE END, 1))", "greatest(0, coalesce(CASE WHEN k % 7 <> 0 THEN (k % 7) / 3.0::DOUBLE END, 1))"
_BLEND = "CASE WHEN k % 3 = 0 THEN greatest(0, (k % 11 - 2) / 2.0::DOUBLE) ELSE 0.75::DOUBLE * greatest(0, (k % 11 - 2) / 2.0::DOUBLE) + 0.25::DOUBLE * ((k % 13) / 4.0::DOUBLE) END"

ORACLES = {
    "scenario_recommendations": over(
        f"""SELECT item_id, CASE shop_id WHEN 0 THEN 'North' WHEN 1 THEN 'Centre' WHEN 2 THEN 'South' ELSE 'Shop ' || shop_id END AS location, round(v, 6) AS velocity, safety_stock, reorder_point, desired_level,
  greatest(0, trunc(desired_level - (greatest(on_hand, 0) + on_order)))::BIGINT AS qty_to_order, status, list_position(['critical', 'low', 'warning', 'healthy', 'incoming', 'on_target', 'high', 'overstock', 'no_demand'], status)::BIGINT AS status_rank,
  CASE status WHEN 'critical' THEN 5 WHEN 'low' THEN 4 WHEN 'warning' THEN 3 WHEN 'healthy' THEN 2 WHEN 'incoming' THEN 2 WHEN 'no_demand' THEN 0 ELSE 1 END::BIGINT AS urgency,
  CASE WHEN on_hand < 0 THEN 'On hand is negative (' || on_hand || ') and counts as 0. ' ELSE '' END || {_REASON} AS status_reason, CASE WHEN v > 0 THEN half_even(greatest(on_hand, 0) / v, 1) ELSE 0 END::DOUBLE AS days_of_stock,
  half_even(v_a * 14, 1) AS adjusted_14, half_even(v_b * 16, 1) AS adjusted_15_30, half_even(v_c * 30, 1) AS adjusted_31_60, half_even(v * 30, 1) AS adjusted_30, half_even(v * 60, 1) AS adjusted_60, {_MOMENTUM} AS momentum, change_needed FROM made_status""",
        **_MORE,
    ),
    "grid_filter": over(
        f"""SELECT item_id, shop_id, status, qty_to_order FROM (SELECT *, {STATUS} AS status, greatest(0, trunc(desired_level - (greatest(on_hand, 0) + on_order)))::BIGINT AS qty_to_order FROM made_manual) JOIN (SELECT item_id, category_top_level FROM items) USING (item_id)
  WHERE shop_id = 0 AND status IN ('critical', 'low', 'warning', 'healthy') AND category_top_level = 'ECONOMY' AND qty_to_order > 0 AND NOT locked""",
        **_MORE,
    ),
    "scenario_settings": over(" UNION ALL ".join(f"SELECT item_id, '{name}' AS settings, round(v, 6) AS velocity, reorder_point, desired_level FROM ({_levels(s)})" for name, s in SETTINGS.items()), **_MORE),
    "scenario_enriched": over(f"SELECT item_id, round(v * {_TREND} * {_SEASON}, 6) AS velocity, round(({_BLEND}) * {_TREND} * {_SEASON}, 6) AS blended FROM (SELECT *, {_velocity('shrink', (0.4, 0.4, 0.2))} AS v FROM made_active)", **_MORE),
    "push_outcomes": over("SELECT draft_id, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'pushed' END AS status, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'success') AS succeeded FROM made_pushes GROUP BY 1", **_MORE),
    "writeback_tally": over("SELECT location_id, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status <> 'success') AS failed FROM made_pushes GROUP BY 1", **_MORE),
    "edited_lines": over("SELECT k::VARCHAR AS item_id, CASE k % 5 WHEN 1 THEN k % 30 WHEN 2 THEN k % 9 ELSE 0 END::BIGINT AS quantity FROM made WHERE k % 11 <> 0", **_MORE),
    "scenario_audit": over(
        """SELECT TIMESTAMP '2001-08-01 12:00:00' AS logged_at, sku, shop_id AS location_id, current_reorder_point AS old_reorder_point, reorder_point AS new_reorder_point, current_desired_level AS old_desired_level, desired_level AS new_desired_level, 'pending' AS status
  FROM made_status WHERE change_needed""",
        **_MORE,
    ),
    "velocity_snapshots": over("SELECT 'run-1' AS run_id, TIMESTAMP '2001-08-01 12:00:00' AS run_at, item_id, shop_id AS location_id, round(v, 9) AS raw_daily_sales FROM made_rates", **_MORE),
    "scalar_functions": over(
        """SELECT k AS part_id, CASE WHEN k % 4 = 2 THEN k::VARCHAR END AS id, k % 3 = 0 AS yes, CASE WHEN k % 3 = 1 THEN make_date(2001, 3, 10 + k % 10) END AS day, CASE WHEN k % 2 = 0 THEN k::VARCHAR END AS number_of_name,
  CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'Ann Lee' WHEN k % 2 = 0 THEN 'Ann' WHEN k % 3 = 0 THEN 'Lee' WHEN k % 5 <> 0 THEN 'Co ' || k END AS person, CASE WHEN k % 4 = 2 THEN 'https://pos.example/item/' || k END AS link,
  CASE WHEN k % 2 = 0 THEN (k // 2)::VARCHAR ELSE (k / 2.0::DOUBLE)::DOUBLE::VARCHAR END AS short, CASE WHEN k % 2 = 0 THEN k / 4.0::DOUBLE ELSE -1 END AS number, CASE WHEN k % 4 = 3 THEN 0 ELSE 1 END AS listed, (k % 12 + 3) % 12 + 1 AS month FROM made""",
        **_MORE,
    ),
}
