import itertools
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from stockflow.operators import grid, purchasing, special_orders as so

TODAY = date(2026, 6, 30)
ORDER = "special_order_id long, customer_email string, system_sku string, status_text string, po_id long, po_ordered_date date, po_arrival_date date, created_date date, contacted boolean"


def order(n, status="Not ordered", po=None, ordered=None, arrival=None, age=None, contacted=False, email="a@x", sku="s"):
    day = lambda d: None if d is None else TODAY - timedelta(days=d)
    return n, email, sku, status, po, day(ordered), day(arrival), day(age), contacted


def test_stage_and_flag(spark):
    late = {0: "none", 1: "overdue", 2: "overdue", 3: "overdue_mid", 7: "overdue_mid", 8: "critical"}
    waits = {4: "none", 5: "overdue", 6: "overdue", 7: "overdue_mid", 11: "overdue_mid", 12: "critical"}
    rows = [order(k, po=1, ordered=30, arrival=k, age=40) for k in late]
    rows += [order(100 + k, age=k) for k in waits]
    rows += [order(200, "Ready for pickup", age=9), order(201, "RECEIVED", age=9, contacted=True), order(202, po=1, age=None), order(203, po=1, ordered=1), order(204, status=None, age=5)]
    got = {r.special_order_id: (r.stage, r.flag, r.days_overdue) for r in so.with_flag(so.with_stage(spark.createDataFrame(rows, ORDER)), TODAY).collect()}
    assert {k: got[k] for k in late} == {k: ("ordered", f, k) for k, f in late.items()}
    assert {k: got[100 + k] for k in waits} == {k: ("open_pool", f, None if f == "none" else k) for k, f in waits.items()}
    assert got[200] == ("received", "ready_not_called", None) and got[201] == ("received", "none", None)
    assert got[202] == ("unordered_po", "none", None) and got[203] == ("ordered", "no_eta", None) and got[204][0] == "open_pool"
    summary = {r.stage: (r.total, r.flagged) for r in so.summary(so.with_flag(so.with_stage(spark.createDataFrame(rows[:6], ORDER)), TODAY)).collect()}
    assert summary == {"ordered": (6, 5), "open_pool": (0, 0), "unordered_po": (0, 0), "received": (0, 0)}


WEB = "order_id long, order_name string, email string, sku string, eta date, created_at timestamp"


def test_match(spark):
    web = spark.createDataFrame([(1, "#1", "A@x ", "s", TODAY, None), (2, "#2", "b@x", "s", None, None), (3, "#3", "b@x", "t", None, None), (3, "#3", "b@x", "u", None, None), (4, "#4", None, None, None, None)], WEB)
    rows = spark.createDataFrame([order(1), order(2, email="c@x"), order(3, email=None, sku="t"), order(4, sku="v"), order(5, sku=None), order(6, email="z@x", sku="u")], ORDER)
    got = {r.special_order_id: (r.web_match, r.web_order_id, sorted(r.candidates)) for r in so.with_match(rows, web).collect()}
    assert got == {1: ("matched", 1, [1]), 2: ("ambiguous", None, [1, 2]), 3: ("matched", 3, [3]), 4: ("none", None, []), 5: ("none", None, []), 6: ("matched", 3, [3])}
    left = so.unmatched(web, spark.createDataFrame([(3,)], "order_id long")).orderBy(*so.by_promise()).collect()
    assert [(r.order_id, r.skus) for r in left] == [(1, ["s"]), (2, ["s"]), (4, [])]
    assert so.as_special_orders(so.unmatched(web, spark.createDataFrame([], "order_id long"))).count() == 4


def test_adoption_follows_the_order_of_ids(spark):
    """Against the walk through rows one by one."""
    rng = random.Random(3)
    for _ in range(4):
        done = [(i, sorted(rng.sample(range(12), rng.randint(0, 4)))) for i in range(15)]
        taken = set(rng.sample(range(12), 3))
        want, seen = [], set(taken)
        for i, ids in done:
            if set(ids) - seen:
                want.append(i)
                seen |= set(ids)
        frame = spark.createDataFrame(done, "special_order_id long, candidates array<bigint>")
        got = so.adopted(frame, None, spark.createDataFrame([(x,) for x in taken], "order_id long"))
        assert sorted(r.special_order_id for r in got.collect()) == want


LINE = "vendor_id long, shop_id long, item_id long, sku string, qty_to_order long, lead_time_source string, lead_time_vendor_id long"
OPEN = "vendor_id long, shop_id long, order_id long, line_no long, item_id long, open_quantity double"


def test_reconciliation(spark):
    rows = [(1, 0, 1, "a", 5, "item_vendor", 1), (1, 0, 2, "b", 0, "default", None), (1, 0, 3, "c", 0, "default", None), (2, 0, 4, "d", 7, "default", None), (2, 0, 5, "e", 3, "preferred_vendor", 1), (None, 0, 6, "f", 9, "default", None), (1, None, 7, "g", 9, "default", None)]
    lines = purchasing.reconciled(spark.createDataFrame(rows, LINE), spark.createDataFrame([(1, 0, 30, 1, 2, 4.0), (1, 0, 20, 1, 9, 1.0), (1, 0, 30, 2, 1, 6.5)], OPEN))
    got = {r.item_id: (r.vendor_id, r.tag, r.line_target_id) for r in lines.collect()}
    assert got == {1: (1, "append_to_open_po", 20), 2: (1, "already_on_po", None), 4: (2, "new_po", None), 5: (1, "append_to_open_po", 20)}
    plan = {r.item_id: (r.action, r.order_id, r.line_quantity) for r in purchasing.push_plan(lines).collect()}
    assert plan == {1: ("updated_line", 30, 11), 4: ("created_po_line", None, 7), 5: ("appended_line", 20, 3)}
    head = {r.vendor_id: (r.lines, r.total_units, r.target_order_id, r.already_on_po) for r in purchasing.headers(lines).collect()}
    assert head == {1: (3, 8, 20, 1), 2: (1, 7, None, 0)}
    results = spark.createDataFrame([("d1", "success"), ("d1", "failed"), ("d2", "success")], "draft_id string, status string")
    assert {r.draft_id: r.status for r in purchasing.push_outcome(results).collect()} == {"d1": "failed", "d2": "pushed"}
    edited = spark.createDataFrame([("1", "3.9"), ("2", "x"), ("3", "-4"), (" ", "1"), (None, "1")], "item_id string, quantity string")
    assert {r.item_id: r.quantity for r in purchasing.checked_lines(edited).collect()} == {"1": 3, "2": 0, "3": 0}


def test_facets_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice("xy"), rng.random() < 0.5) for _ in range(80)]
    frame = spark.createDataFrame(rows, "p string, q string, r boolean")
    tiles = {"p": {v: F.col("p") == v for v in "abc"}, "q": {v: F.col("q") == v for v in "xy"}, "r": {"yes": F.col("r")}}
    active = {"p": ["a", "b"], "q": ["x"], "r": []}
    got = {(r.tile_group, r.tile): r.n for r in grid.facet_counts(frame, tiles, active).collect()}
    passes = {"p": lambda t: t[0] in "ab", "q": lambda t: t[1] == "x", "r": lambda t: True}
    own = {"p": 0, "q": 1, "r": 2}
    for group, tile in itertools.chain((("p", v) for v in "abc"), (("q", v) for v in "xy"), [("r", "yes")]):
        want = sum(all(f(t) for g, f in passes.items() if g != group) and t[own[group]] == (tile if group != "r" else True) for t in rows)
        assert got[group, tile] == want
    assert frame.where(grid.active_filter(tiles, active)).count() == sum(t[0] in "ab" and t[1] == "x" for t in rows)


def test_grid(spark):
    rows = spark.createDataFrame([("b", 1, ["Red"]), ("A", None, ["blue"]), (None, 3, []), ("c", 2, None)], "name string, n int, tags array<string>")
    up, down = ([r.n for r in rows.orderBy(grid.order_by(rows, "n", d)).collect()] for d in (False, True))
    assert up == [1, 2, 3, None] and down == [None, 3, 2, 1]
    assert [r.name for r in grid.page(rows, [grid.order_by(rows, "name")], 2, 2).collect()] == ["c", None]
    assert [r.name for r in grid.searched(rows, " RED ", ["name", "tags"]).collect()] == ["b"] and grid.searched(rows, " ", ["name"]).count() == 4
    assert grid.chosen(rows, {"n": [1, 3], "name": None}).count() == 2 and grid.chosen(rows, {"n": []}).count() == 4


def test_no_list_of_orders_is_made_for_many_rows(spark):
    """Keys alone give the consumed and adopted rows that lists of candidates give, however many rows and orders a sku has."""
    rng = random.Random(9)
    web = spark.createDataFrame([(i, f"#{i}", rng.choice(["a@x", "b@x", None, " "]), rng.choice(["s", "s", "t", "u", None, ""]), None, None) for i in range(60)], WEB)
    for _ in range(2):
        rows = spark.createDataFrame([order(i, email=rng.choice(["A@x", "c@x", None]), sku=rng.choice(["s", " t", "v", None])) for i in range(40)], ORDER)
        live, done = rows.where("special_order_id % 5 = 0 and trim(system_sku) = 't'"), rows.where("special_order_id % 5 <> 0")
        keys, lists = so.with_keys(done, web), so.with_match(done, web)
        assert "collect" not in keys._jdf.queryExecution().optimizedPlan().toString()
        assert {r.special_order_id: r.n_candidates for r in keys.collect()} == {r.special_order_id: len(r.candidates) for r in lists.collect()}
        taken = so.consumed(so.with_keys(live, web), web)
        want = {x for r in so.with_match(live, web).collect() for x in r.candidates}
        assert sorted(r.order_id for r in taken.collect()) == sorted(want)
        got = so.adopted(keys, web, taken)
        assert sorted(r.special_order_id for r in got.collect()) == sorted(r.special_order_id for r in so.adopted(lists, None, taken).collect())


def _unaided(spark, build):
    """The plan of build() as for tables that are too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_tables_of_orders_are_exchanged_once_for_their_keys(spark):
    rows, web = spark.createDataFrame([order(1)], ORDER), spark.createDataFrame([(1, "#1", "a@x", "s", None, None)], WEB)
    plan = _unaided(spark, lambda: so.with_keys(rows, so.keyed_orders(web)))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert "Join" not in plan and sum("hashpartitioning(k_sku#" in line and "REPARTITION_BY_COL" in line for line in exchanges) == 1


def test_rows_are_sorted_once_for_both_windows_of_their_match(spark):
    rows, web = spark.createDataFrame([order(1)], ORDER), spark.createDataFrame([(1, "#1", "a@x", "s", None, None)], WEB)
    lines = _unaided(spark, lambda: so.with_keys(rows, so.keyed_orders(web))).splitlines()
    above = lines[: next(i for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line)]
    assert sum("Sort [" in line for line in above) == 1 and sum("Window [" in line for line in above) == 2


def test_versions_are_told_apart_where_the_lines_of_a_sale_stand(spark, sf):
    from stockflow.sources import tables as t
    from stockflow.plans import stock

    assert "line_no" not in "".join(x for x in _unaided(spark, lambda: t.special_orders(spark, sf)).splitlines() if "Exchange" in x)
    assert "line_no" not in "".join(x for x in _unaided(spark, lambda: stock.item_metrics(spark, sf)).splitlines() if "Exchange" in x)
