from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockflow.functions import columns as c
from stockflow.sources import files, stores
from stockflow.streaming import logs


def test_scalars(spark):
    row = spark.range(1).select(
        c.ceil_units(F.lit(3.0000000001)).alias("ceil"), c.whole_days(F.lit(datetime(2020, 1, 1)), F.lit(datetime(2020, 1, 2, 2))).alias("days"), c.date_of_text(F.lit("2020-02-03T23:00:00-08:00")).cast("string").alias("day"), c.date_of_text(F.lit("soon")).alias("none"),
        c.id_text(F.lit(0)).alias("no_id"), c.id_text(F.lit(" 7 ")).alias("id"), c.says_true(F.lit(" TRUE")).alias("yes"), c.last_number(F.lit("gid://shop/Order/123")).alias("gid"), c.person_name(F.lit("Ann"), F.lit(None).cast("string"), F.lit("Co")).alias("name"),
        c.person_name(F.lit(" "), F.lit(None).cast("string"), F.lit("Co")).alias("company"), c.link("http://x/", F.lit("0")).alias("no_link"), c.link("http://x/", F.lit(5)).alias("link"), c.short_number(F.lit(7.0)).alias("seven"), c.short_number(F.lit(7.5)).alias("half"),
        c.number_or(F.lit("x"), 2.0).alias("number"), c.month_after(F.lit(12), F.lit(1)).alias("month"), F.size(c.as_list(F.lit(None).cast("int"))).alias("empty"), c.divided(F.lit(1.0), F.lit(0.0)).alias("ratio"),
    ).first()
    assert row.asDict() == {"ceil": 3, "days": 1, "day": "2020-02-03", "none": None, "no_id": None, "id": "7", "yes": True, "gid": "123", "name": "Ann", "company": "Co", "no_link": None, "link": "http://x/5", "seven": "7", "half": "7.5", "number": 2.0, "month": 1, "empty": 0, "ratio": 0.0}


def test_uploads(spark, tmp_path):
    (tmp_path / "up.csv").write_text(files.TEMPLATE + "B,2,,,,\n")
    got = files.managed_from_csv(spark, str(tmp_path / "up.csv"), "me").orderBy("sku").collect()
    assert [(r.sku, r.item_id, r.brand, r.added_by) for r in got] == [("B", "2", None, "me"), ("SKU-1", "1001", "Example brand", "me")]
    (tmp_path / "bad.csv").write_text("sku,brand\na,b\n")
    with pytest.raises(ValueError, match="item_id"):
        files.managed_from_csv(spark, str(tmp_path / "bad.csv"), "me")
    rows = files.managed_from_rows(spark, [{"sku": "a", "system_id": 5, "item_id": 6}, {"sku": "b", "item_id": "7"}, {"sku": "", "item_id": 1}, {"sku": "c", "item_id": "0"}, {}], "me")
    assert sorted((r.sku, r.item_id) for r in rows.collect()) == [("a", "5"), ("b", "7")]
    made = files.made_up_items(spark, 50, 1)
    assert made.count() == 50 and made.where("needs_order <> (on_hand + on_order <= current_reorder_point)").count() == 0


def test_store(spark, tmp_path):
    store = stores.Store(spark, f"file://{tmp_path}/store")
    assert store.read("overrides").count() == 0
    rule = lambda *rows: spark.createDataFrame(list(rows), stores.SCHEMAS["brand_rules"])
    at = datetime(2020, 1, 1)
    store.merge("brand_rules", rule(("A", "1", "One", True, at), ("B", None, "None", True, at)))
    store.merge("brand_rules", rule(("A", "2", "Two", True, at + timedelta(days=9))))
    got = {r.brand_name: (r.preferred_vendor_id, r.active, r.created_at) for r in store.read("brand_rules").collect()}
    assert got == {"A": ("2", True, at), "B": (None, False, at)}
    draft = lambda *rows: spark.createDataFrame(list(rows), stores.SCHEMAS["po_drafts"])
    lines = lambda *rows: spark.createDataFrame(list(rows), stores.SCHEMAS["po_draft_lines"])
    store.replace("po_drafts", draft(("d1", 1, 0, "draft", 5, at), ("d2", 2, 0, "draft", None, at)))
    store.replace("po_draft_lines", lines(("d1", 1, 1, "new_po"), ("d2", 2, 2, "new_po")))
    store.replace_lines("d1", lines(("d1", 9, 9, "new_po")), at + timedelta(days=1))
    store.set_status("d1", "pushed", None, at + timedelta(days=2))
    assert store.read("po_drafts").where("draft_id = 'd1'").first()[3:5] == ("pushed", 5)
    assert {(r.draft_id, r.item_id) for r in store.read("po_draft_lines").collect()} == {("d1", 9), ("d2", 2)}
    store.delete_draft("d2")
    assert store.read("po_drafts").count() == store.read("po_draft_lines").count() == 1
    store.append("po_drafts", draft(("d3", 3, 0, "draft", None, at)))
    store.append("po_draft_lines", lines(("d3", 4, 1, "new_po"), ("d3", 2, 6, "new_po")))
    assert {r.draft_id for r in store.read("po_drafts").collect()} == {"d1", "d3"}  # what is appended after a replacement is read
    assert [r.draft_id for r in store.drafts("draft").collect()] == ["d3"] and [r.draft_id for r in store.drafts().collect()] == ["d1", "d3"]
    assert [tuple(x) for x in store.draft("d3").first().lines] == [(2, 6, "new_po"), (4, 1, "new_po")]
    store.start_push("d3", at)
    for name in ("d3", "d1", "d9"):
        with pytest.raises(ValueError, match=name):
            store.start_push(name, at)
    store.merge("overrides", spark.createDataFrame([("a", 1, 2, 3, True)], "sku string, location_id long, manual_reorder_point long, manual_desired_level long, locked boolean"), at)
    assert store.read("overrides").first().updated_at == at
    log = spark.createDataFrame([(str(i), at + timedelta(days=i), "s", 0, 1, 2, 3, 4, "success", None) for i in range(5)], stores.SCHEMAS["writeback_log"])
    store.append("writeback_log", log)
    store.append("writeback_log", log.where("false"))
    assert [r.log_id for r in store.newest("writeback_log", 2).collect()] == ["4", "3"]
    store.export_log(f"file://{tmp_path}/log.csv")
    assert spark.read.csv(f"file://{tmp_path}/log.csv", header=True).columns == stores.EXPORTED


def test_stream(spark, tmp_path):
    at = datetime(2020, 1, 1, 12)
    rows = [(1, 1, 0, 5, at), (2, 1, 0, 0, at + timedelta(hours=1)), (2, 1, 0, 0, at + timedelta(hours=1)), (3, 1, 0, -1, at + timedelta(days=1)), (4, 1, 0, 3, at + timedelta(days=9))]
    spark.createDataFrame(rows, logs.SCHEMA).write.parquet(f"{tmp_path}/in")
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    for _ in range(2):  # the second run finds nothing new
        logs.appended(logs.changes_by_day(logs.without_repeats(logs.stock_stream(spark, f"{tmp_path}/in"))), out, mark).awaitTermination(120)
    got = {str(r.day): (r.changes, r.empty) for r in spark.read.parquet(out).collect()}
    assert got == {"2020-01-01": (2, 1), "2020-01-02": (1, 1)}


def test_locations_are_counted_and_written_without_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (0, "a", 2), (1, "c", 3), (7, "d", 4), (None, "e", 5)], "location_id long, sku string, qty long")
    locations = spark.createDataFrame([(0,), (1,), (9,)], "location_id long")
    sizes = stores.location_summary(rows, locations)
    assert "collect_list" not in sizes._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in sizes.collect()) == [(0, 3, "a"), (1, 1, "c"), (9, 0, "")]
    stores.write_by_location(rows, locations, f"file://{tmp_path}/by")
    got = spark.read.parquet(f"file://{tmp_path}/by").collect()
    assert sorted((r.location_id, r.sku or "", r.qty or 0, r.found) for r in got) == [(0, "a", 2, True), (0, "a", 2, True), (0, "b", 1, True), (1, "c", 3, True), (9, "", 0, False)]


def test_kept_results(spark, tmp_path):
    from stockflow.sources import kept as k

    made = []

    def build():
        made.append(1)
        return spark.range(len(made)).withColumn("x", F.lit(None).cast("string"))

    source = f"{tmp_path}/in.parquet"
    spark.range(3).write.parquet(source)
    for _ in range(2):
        assert k.kept(spark, "t", [source], build).count() == 1
    spark.range(4).write.mode("append").parquet(source)
    assert k.kept(spark, "t", [source], build).count() == 2  # the input has changed
    assert k.kept(spark, "t", [source], build, max_age=-1).count() == 3  # too old

    def broken():
        raise RuntimeError("down")

    with pytest.warns(UserWarning, match="older table"):
        assert k.kept(spark, "t", [source], broken, max_age=-1).count() == 3
    with pytest.raises(RuntimeError, match="down"):
        k.kept(spark, "other", [source], broken)
