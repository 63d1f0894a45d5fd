"""Search by trigrams against a scan, flags, and the report on where items drop out."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stockflow import plans
from stockflow.operators import grid, qualification, special_orders as so, text_index

COLUMNS = ["name", "note", "names"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcÄß😀 #1", k=rng.randint(0, 9)))
    values = [(i if i % 17 else None, word() * rng.randint(1, 9), rng.choice([None, word()]), [word() for _ in range(rng.randint(0, 3))]) for i in range(150)]
    values += [(7, "a second row of seven", None, []), (200, "", "", []), (201, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 400, "xyz", ["Needle in", "a list"])]
    rows = spark.createDataFrame(values, "id long, name string, note string, names array<string>").cache()
    return values, rows, text_index.index(rows, "id", COLUMNS).cache()


def test_index_finds_what_a_scan_finds(texts):
    values, rows, table = texts
    rng = random.Random(4)
    everything = [t.lower() for v in values for t in (v[1], v[2] or "", " ".join(v[3]))]
    needles = ["", "  ", "zzz", "needle in a list", "seven", "a😀", "ÄSS"]
    for size in range(1, 21):
        t = rng.choice([x for x in everything if len(x.strip()) >= size])
        at = rng.randint(0, len(t) - size)
        needles.append(t[at : at + size])
    for text in needles:
        want = sorted(grid.searched(rows, text, COLUMNS).select("id", "name").collect(), key=str)
        assert sorted(text_index.search(rows, table, text, "id", COLUMNS).select("id", "name").collect(), key=str) == want, text
        brute = [v for v in values if any(text.strip().lower() in x.lower() for x in (v[1], v[2] or "", " ".join(v[3])))]
        assert len(want) == len(brute), text


def test_grams_apart_are_candidates_only(spark):
    rows = spark.createDataFrame([(1, "abcx bcd"), (2, "abcd"), (3, "abc"), (4, None)], "id long, t string")
    table = text_index.index(rows, "id", ["t"])
    assert {r.key for r in text_index.candidates(table, "abcd").collect()} == {1, 2}
    assert [r.id for r in text_index.search(rows, table, "ABCD", "id", ["t"]).collect()] == [2]
    assert text_index.index(rows.limit(0), "id", ["t"]).isEmpty()


def test_the_grams_reach_the_scan(spark, texts, tmp_path):
    texts[2].write.parquet(f"{tmp_path}/grams")
    plan = text_index.candidates(spark.read.parquet(f"{tmp_path}/grams"), "needle")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan


def test_an_index_of_blocks_finds_the_same_with_fewer_rows(spark, texts):
    """A gram stands once for each field of a block, however many rows hold it."""
    values, rows, table = texts
    blocks = text_index.index(rows, "id", COLUMNS, block=64).cache()
    assert blocks.count() == blocks.distinct().count() < table.count()
    for text in ("", "a😀", "ÄSS", "seven", "needle in a list", "zzz", *(v[1].strip()[:4] for v in values[:40:4])):
        want = sorted(grid.searched(rows, text, COLUMNS).select("id", "name").collect(), key=str)
        assert sorted(text_index.search(rows, blocks, text, "id", COLUMNS, block=64).select("id", "name").collect(), key=str) == want, text
    same = spark.range(1000).select("id", F.lit("the same text").alias("t"))
    assert text_index.index(same, "id", ["t"], block=1000).count() == 11


def test_an_index_of_parts_is_that_of_whole_rows(spark, texts):
    """Texts of other tables meet the blocks by an id, and needn't move with rows."""
    _, rows, _ = texts
    rows = rows.withColumns({"block": text_index.place(F.col("id"), 64), "kind": F.length("name") % 3})
    kinds = spark.createDataFrame([(0, "no bolt", ["A", "b"]), (1, None, []), (2, "large RING", None)], "kind int, note string, names array<string>")
    whole = rows.drop("note", "names").join(kinds, "kind", "left")
    parts = [(rows, ["name"]), (rows.select("block", "kind").distinct().join(kinds, "kind"), ["note", "names"])]
    got = sorted(map(tuple, text_index.index_of_parts(parts, "block", COLUMNS).collect()), key=str)
    assert got == sorted(map(tuple, text_index.index(whole, "id", COLUMNS, block=64).collect()), key=str) and {f for _, f, _ in got} == {0, 1, 2}


def test_the_index_of_orders_moves_ids_for_texts_of_items_and_vendors(spark, sf):
    """It has the grams of enriched orders. Rows aren't exchanged for their customer, and prices not at all."""
    from test_orders import _unaided

    from stockflow.plans import lookups, worklists
    from stockflow.sources import tables as t

    whole = text_index.index(worklists.enriched(spark, sf), "special_order_id", so.SEARCHED, lookups.ID_BLOCK)
    assert sorted(map(tuple, lookups.order_index(spark, sf).collect())) == sorted(map(tuple, whole.collect()))
    exchanges = [x for x in _unaided(spark, lambda: worklists.enriched(spark, sf)).splitlines() if "Exchange" in x]
    assert exchanges and "sale_id" not in "".join(exchanges)
    assert "l_extendedprice" not in _unaided(spark, lambda: t.special_orders(spark, sf))


def test_special_orders_meet_their_match_as_lines(spark, sf):
    """Columns that follow from others are added after the exchange and the sort by sku; the rows are those of whole special orders."""
    from stockflow.plans import orders
    from stockflow.sources import tables as t

    got, want = orders.matched(spark, sf), so.with_keys(t.special_orders(spark, sf), orders.web_keys(spark, sf))
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    keyed = so.with_keys(t.special_lines(spark, sf).withColumns({"k_email": F.lower("customer_name"), "k_sku": F.col("item_id").cast("string")}), orders.web_keys(spark, sf))
    assert not {"status_text", "po_id", "customer_email", "system_sku"} & set(keyed.columns)


def test_flags(spark):
    rows = spark.createDataFrame([(1, True, True), (2, True, None), (3, False, True)], "id int, a boolean, b boolean")
    ids = lambda flags: sorted(r.id for r in grid.ticked(rows, flags).collect())
    assert ids({}) == ids({"a": False}) == [1, 2, 3]
    assert ids({"a": True}) == [1, 2] and ids({"a": True, "b": True}) == [1]


def test_report(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    at = datetime(2020, 1, 1)
    log = spark.createDataFrame([(1, 1, 0, 5, at), (2, 1, 0, 6, at), (3, 1, 4, 5, at), (4, 2, 2, 5, at), (5, 9, 0, 5, at), (6, None, 0, 5, at)], "event_id long, item_id long, shop_id long, qoh long, updated_time timestamp")
    row = qualification.report(items, log, (0, 2), [(9, "no"), (1, "yes"), (3, "no")]).collect()[0]
    assert (row.qualified_items, row.latest_items, row.target_rows) == (3, 2, 2)
    assert [tuple(x) for x in row.by_shop] == [(0, 1), (2, 1)]
    assert [tuple(x) for x in row.examples] == [(1, "yes", True, True, [0]), (3, "no", False, False, []), (9, "no", True, False, [])]
    none = qualification.report(items.limit(0), log.limit(0), (0,), [(1, "yes")]).collect()[0]
    assert (none.qualified_items, none.latest_items, none.target_rows, none.by_shop) == (0, 0, 0, [])


def test_records(spark):
    at = datetime(2020, 1, 5, 23)
    schema = "id int, line_time timestamp, changed timestamp, shop_id long, status_text string, po_id long, po_ordered_date date, po_complete boolean, num_received double, upc string, item_text string, line_text string, contacted boolean, po_arrival_date date"
    given = [
        (1, at, datetime(2020, 1, 9), 0, None, None, at.date(), True, 3.0, " ", None, "a line", False, None),
        (2, None, at, 7, "Ordered", 5, at.date(), None, 0.0, "12", "an item", "a line", False, at.date()),
        (3, None, None, None, "Arrived", 6, None, True, 1.0, None, "", None, True, None),
    ]
    rows = spark.createDataFrame(given, schema).withColumn("created_date", so.created_day(F.col("line_time"), F.col("changed")))
    rows = so.recorded(so.with_flag(so.with_stage(rows), datetime(2020, 1, 30).date()), {0: "North"}, {"order_link": ("/o/{}?x", "po_id")})
    a, b, c = rows.orderBy("id").collect()
    assert [r.created_date and r.created_date.day for r in (a, b, c)] == [5, 5, None]
    assert (a.status, a.store, a.stage, a.stage_index, a.flag, a.is_overdue) == ("Unknown", "North", "open_pool", 0, "critical", True)
    assert (a.po_ordered, a.po_complete, a.received_started, a.upc, a.description, a.order_link) == (False, False, False, None, "a line", None)
    assert (b.store, b.stage_index, b.flag, b.is_overdue, b.po_ordered, b.po_complete, b.received_started, b.upc, b.description, b.order_link) == (None, 2, "critical", True, True, False, False, "12", "an item", "/o/5?x")
    assert (c.store, c.stage_index, c.flag, c.is_overdue, c.po_complete, c.received_started, c.description) == (None, 3, "none", False, True, True, None)


def test_lines_are_read_once(spark, sf):
    plan = plans.QUERIES["raw_and_deduplicated"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4  # lines, orders, and two for the shop of an order
