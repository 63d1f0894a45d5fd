from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockflow.operators import audit, lead_times as lt, replenishment as rp, stock
from stockflow.operators.versions import latest_version, upsert


def column(spark, rows, schema, *out):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*out).collect()]


def test_status_bands(spark):
    cases = [
        (5, 0, 10, 60, "critical"), (7, 0, 10, 60, "low"), (11, 0, 10, 60, "warning"), (20, 0, 10, 60, "healthy"), (50, 0, 10, 60, "on_target"), (72, 0, 10, 60, "high"), (90, 0, 10, 60, "overstock"),
        (7, 43, 10, 60, "incoming"), (5, 85, 10, 60, "overstock"), (0, 0, 0, 0, "no_demand"), (-5, 0, 10, 60, "critical"), (-5, 60, 10, 60, "incoming"),
    ]
    got = column(spark, cases, "a long, b long, c long, d long, want string", rp.stock_status(*map(F.col, "abcd")), "want", rp.status_reason(F.col("want"), *map(F.col, "abcd")), rp.status_rank(F.col("want")), rp.status_urgency(F.col("want")))
    assert [g[0] for g in got] == [g[1] for g in got]
    assert got[-1][2].startswith("On hand is negative (-5)") and got[0][3:] == (1, 5) and got[9][3:] == (9, 0)


METRICS = "item_id long, sku string, shop_id long, on_hand long, on_order long, current_reorder_point long, current_desired_level long, lead_time_days double, units_14 double, units_30 double, units_60 double, sale_days_14 long, sale_days_30 long, sale_days_60 long, days_out_of_stock_14 long, days_out_of_stock_30 long, days_out_of_stock_60 long"


def metrics(spark, item=1, on_hand=0, units=(14, 30, 60), sale_days=(14, 30, 60), out=(0, 0, 0)):
    return spark.createDataFrame([(item, "A", 0, on_hand, 0, 0, 0, 9.0, *map(float, units), *sale_days, *out)], METRICS)


def test_recommendation(spark):
    settings = rp.Settings(safety_days=0)
    row = rp.recommend(metrics(spark, on_hand=-5), settings).first()
    assert (row.desired_level, row.qty_to_order, row.days_of_stock, row.on_hand, row.reorder_point) == (60, 60, 0, -5, 9)
    over = spark.createDataFrame([("A", 0, None, 40, True)], "sku string, location_id long, manual_reorder_point long, manual_desired_level long, locked boolean")
    row = rp.apply_overrides(rp.recommend(metrics(spark, on_hand=-5), settings), over).first()
    assert (row.desired_level, row.qty_to_order, row.reorder_point, row.locked) == (40, 40, 9, True)
    row = rp.recommend(metrics(spark, units=(28, 44, 74)), settings).first()
    assert row.base_velocity == pytest.approx(1.4) and row.desired_level == 84
    row = rp.recommend(metrics(spark), rp.Settings(weights=(None, None, None), recent_30d_weight=0.25, safety_days=0)).first()
    assert row.desired_level == 60
    assert rp.recommend(metrics(spark, item=0)).count() == 0 and rp.recommend(metrics(spark, item=None)).count() == 0


def test_guarded_windows(spark):
    first = (1.0, 0.0, 0.0)
    rows = metrics(spark, units=(6, 6, 6), sale_days=(4, 4, 4), out=(11, 11, 11))
    row = rp.recommend(rows, rp.Settings(weights=first, safety_days=0)).first()
    assert row.active_days_14 == 4 and row.adjusted_14 == 12.0
    row = rp.recommend(metrics(spark, units=(6, 6, 6), sale_days=(5, 5, 5), out=(11, 11, 11)), rp.Settings(weights=first, mode="min_days")).first()
    assert row.active_days_14 == 5 and row.adjusted_14 == 6.0


@pytest.mark.parametrize("units, want", [((28, 36, 42), "surging"), ((20, 36, 63), "rising"), ((2, 3, 4), "spiky"), ((7, 31, 91), "cooling"), ((14, 30, 60), "flat"), ((0, 0, 0), "insufficient_data"), ((16, 28, 56), "flat")])
def test_momentum(spark, units, want):
    assert rp.recommend(metrics(spark, units=units)).first().momentum == want


def test_settings_are_checked():
    for bad in ({"weights": (0.5, 0.5, 0.5)}, {"weights": (0.5, None, 0.5)}, {"safety_days": -1}, {"growth": 0}, {"forecast_days": -1}):
        with pytest.raises(ValueError):
            rp.Settings(**bad)
    assert all(rp.Settings(weights=w).shares == w for w in rp.PRESETS.values())


def test_trend(spark):
    cases = [(1, 1, 1, 1), (100, 1, 1, 2), (0.001, 10, 10, 0.5), (5, 0, 0, 2), (0, 3, 3, 0.5), (0, 0, 0, 1), (-5, -1, -1, 1)]
    got = column(spark, [tuple(map(float, c)) for c in cases], "a double, b double, c double, want double", rp.trend_coefficient(*map(F.col, "abc")), "want")
    assert all(a == pytest.approx(b) for a, b in got)
    assert column(spark, [(100.0, 1.0, 1.0)], "a double, b double, c double", rp.trend_coefficient(*map(F.col, "abc"), low=0.8, high=1.2)) == [(1.2,)]
    assert column(spark, [(9.0, 1.0, 1.0)], "a double, b double, c double", rp.trend_coefficient(*map(F.col, "abc"), sensitivity=0)) == [(1.0,)]
    assert column(spark, [(2.0, None, 0.5, 4.0)], "b double, n double, t double, c double", rp.enriched(F.col("b"), F.col("t")), rp.enriched(F.col("b"), None, F.col("n")), rp.enriched(F.col("b"), None, None, F.col("c"), 0.5), rp.enriched(-F.col("b"))) == [(1.0, 2.0, 3.0, 0.0)]


def test_lead_time_order(spark):
    leads = lambda *rows: spark.createDataFrame(list(rows), "vendor_id long, shop_id long, lead_time_days double, po_count long")
    rules = spark.createDataFrame([(" shimano ", "99", "Ninety-nine", True)], "brand_name string, preferred_vendor_id string, preferred_vendor_name string, active boolean")
    none = rules.where("false")
    item = spark.createDataFrame([(1, 55, 3, "Shimano")], "item_id long, vendor_id long, shop_id long, brand string")
    own, other = (55, 3, 7.0, 4), (99, 3, 18.0, 12)
    got = lambda lead, rule: tuple(lt.with_lead_time(item, lead, rule).select("lead_time_days", "lead_time_source", "lead_time_po_count").first())
    assert got(leads(own), none) == (7.0, "item_vendor", 4)
    assert got(leads(own, other), rules) == (18.0, "preferred_vendor", 12)
    assert got(leads(own), rules) == (7.0, "item_vendor", 4)
    assert got(leads((1, 1, 1.0, 1)), rules) == (14.0, "default", 0)


def test_median_counts_whole_days_only(spark):
    at = datetime(2001, 7, 1)
    rows = [(1, 1, 1, at, at + timedelta(hours=h)) for h in (26, 50, 24 * 41)] + [(2, 1, 2, at - timedelta(days=400), at)]
    report = spark.createDataFrame(rows, "vendor_id long, shop_id long, order_id long, po_ordered_at timestamp_ntz, first_received_at timestamp_ntz")
    assert [tuple(r) for r in lt.median_lead_times(report, date(2001, 8, 1)).collect()] == [(1, 1, 2.0, 2)]
    assert lt.months_back(date(2001, 3, 31), 1) == date(2001, 2, 28) and lt.months_back(date(2001, 1, 15), 13) == date(1999, 12, 15)


LOG = "event_id long, item_id long, shop_id long, qoh long, updated_time timestamp_ntz"


def test_days_without_stock(spark):
    day = lambda d, h=0: datetime(2001, 7, d, h)
    rows = [(1, 1, 0, 5, day(20)), (2, 1, 0, 0, day(25, 1)), (3, 1, 0, -2, day(25, 2)), (4, 1, 0, 9, day(28)), (5, 2, 0, None, day(28)), (6, 3, 0, 0, day(1))]
    log = spark.createDataFrame(rows, LOG)
    as_of = date(2001, 7, 31)
    got = {tuple(r)[0]: tuple(r)[2:] for r in stock.days_without_stock(log, as_of, (7, 14, 60)).collect()}
    assert got == {1: (3, 3, 3), 3: (7, 14, 31)}
    raw = {r.item_id: r.days_out_of_stock_14 for r in stock.days_without_stock_raw(log, as_of, (14, 60)).collect()}
    assert raw == {1: 4, 2: 0, 3: 14}
    levels = stock.daily_levels(log, date(2001, 7, 1), as_of)
    assert levels.where("item_id = 1 and qoh is null").count() == 19 and levels.where("item_id = 1 and qoh <= 0").count() == 3
    by_spine = {r.item_id: r.n for r in levels.where("qoh <= 0").groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    assert by_spine == {1: 3, 3: 31}


def test_versions_and_upsert(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "a"), (2, 1, "z")], "id long, at long, v string")
    assert sorted(tuple(r) for r in latest_version(log, ["id"], [F.desc("at"), F.desc("v")]).collect()) == [(1, 3, "b"), (2, 1, "z")]
    now = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "id long, v string, made long")
    new = spark.createDataFrame([(2, None, 99), (3, "d", 30), (None, "m", 1)], "id long, v string, made long")
    assert sorted((tuple(r) for r in upsert(now, new, ["id"], ["made"]).collect()), key=str) == sorted([(1, "a", 10), (2, None, 20), (3, "d", 30), (None, "n", 0), (None, "m", 1)], key=str)


def test_level_changes(spark):
    rows = [("a", "s", 1, 1, 2, 5, 5), ("b", "s", 1, 1, 1, 5, 6), ("c", "s", 1, 1, 1, 5, 5), ("d", "s", 1, None, 2, 5, None)]
    log = spark.createDataFrame(rows, "log_id string, sku string, location_id long, old_reorder_point long, new_reorder_point long, old_desired_level long, new_desired_level long")
    got = sorted((r.log_id, r.field) for r in audit.level_changes(log).collect())
    assert got == [("a", "reorder_point"), ("b", "desired_level"), ("c", "reorder_point"), ("d", "desired_level"), ("d", "reorder_point")]
