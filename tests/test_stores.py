"""Versions of the store's tables: one writer for each, no lost rows, only touched buckets rewritten, batches that come again."""

import threading
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockflow.sources import stores
from stockflow.sources.commits import Commits, Conflict, Files
from stockflow.streaming import logs

AT = datetime(2020, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    return stores.Store(spark, f"file://{tmp_path}/store", buckets=16)


def rows(spark, name, *values):
    return spark.createDataFrame(list(values), stores.SCHEMAS[name])


def at_once(jobs):
    """What each job raised, or None; all run in threads of their own."""
    out = [None] * len(jobs)

    def run(i):
        try:
            jobs[i]()
        except Exception as e:
            out[i] = e

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_a_name_is_given_once(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/marks")
    got = []
    assert at_once([lambda i=i: got.append((i, files.put_if_absent("one", str(i)))) for i in range(8)]) == [None] * 8
    (winner,) = [i for i, ok in got if ok]
    assert files.text("one") == str(winner) and [n for n in files.names() if not n.startswith(".")] == ["one"]


def test_a_writer_of_an_older_version_always_fails(spark, store, monkeypatch):
    draft = lambda i: rows(spark, "po_drafts", (i, 1, 0, "draft", None, AT))
    store.replace("po_drafts", draft("d0"))
    for name in ("0", "z"):  # whatever its folder's name, and whoever is slower
        monkeypatch.setattr(stores.uuid, "uuid4", lambda name=name: type("U", (), {"hex": f"{name}{len(list(Path(store.folder[7:]).rglob('*')))}"}))
        old = store.version("po_drafts")
        stale = store._commits("po_drafts").newest()
        store.replace("po_drafts", draft("first"))
        with pytest.raises(Conflict):
            store.replace("po_drafts", draft("second"), read=old)
        with pytest.raises(Conflict):
            store._change("po_drafts", stale, range(16), lambda x: x.where("false"))
        assert [r.draft_id for r in store.read("po_drafts").collect()] == ["first"]
    commits = Commits(spark, f"{store.folder}/po_drafts.versions")
    with pytest.raises(Conflict):
        commits.claim(0, {"parts": []})


def test_appends_at_once_lose_nothing(spark, store):
    log = lambda i: rows(spark, "eta_log", (i, AT, None, None))
    assert at_once([lambda i=i: store.append("eta_log", log(i)) for i in range(6)]) == [None] * 6
    assert sorted(r.order_id for r in store.read("eta_log").collect()) == list(range(6)) and store.version("eta_log") == 6
    store.compact("eta_log")
    assert sorted(r.order_id for r in store.read("eta_log").collect()) == list(range(6))
    assert store.clean("eta_log", keep=1) == 0 and store.clean("eta_log", keep=1, older_than=-10) == 6
    assert store.read("eta_log").count() == 6


def test_one_of_two_pushes_gets_through(spark, store):
    store.replace("po_drafts", rows(spark, "po_drafts", *((f"d{i}", 1, 0, "draft", None, AT) for i in range(4))))
    raised = at_once([lambda: store.start_push("d1", AT), lambda: store.start_push("d1", AT), lambda: store.start_push("d2", AT)])
    assert sorted(type(e).__name__ for e in raised[:2]) == ["NoneType", "ValueError"] and raised[2] is None
    assert {r.draft_id: r.status for r in store.read("po_drafts").collect()} == {"d0": "draft", "d1": "pushing", "d2": "pushing", "d3": "draft"}


def test_merges_at_once_lose_nothing_in_silence(spark, store):
    change = lambda i: spark.createDataFrame([(f"s{i}", 0, i, i, False)], "sku string, location_id long, manual_reorder_point long, manual_desired_level long, locked boolean")
    raised = at_once([lambda i=i: store.merge("overrides", change(i), AT) for i in range(4)])
    assert all(e is None or isinstance(e, Conflict) for e in raised)
    assert {r.sku for r in store.read("overrides").collect()} == {f"s{i}" for i, e in enumerate(raised) if e is None}


def test_a_merge_leaves_other_buckets_alone(spark, store):
    old = [(f"sku{i}", str(i), "p", "b", "v", "c", "me", AT) for i in range(400)]
    store.replace("managed_skus", rows(spark, "managed_skus", *old))
    before = {tuple(p) for p in store._commits("managed_skus").newest()[1]["parts"]}
    stamps = {f: f.stat().st_mtime_ns for f in Path(store.folder[7:]).rglob("*.parquet")}
    new = rows(spark, "managed_skus", ("sku7", "0", "new", "b", "v", "c", "you", None), ("another", "1", "new", "b", "v", "c", "you", None), ("sku8", None, "new", "b", "v", "c", "you", None))
    store.merge("managed_skus", new, AT + timedelta(days=1))
    after = {tuple(p) for p in store._commits("managed_skus").newest()[1]["parts"]}
    assert len(before) == 16 and 13 <= len(before & after) < 16 and {f: f.stat().st_mtime_ns for f in stamps} == stamps
    got = {r.sku: r for r in store.read("managed_skus").collect()}
    assert len(got) == 401 and [got["sku7"].product, got["sku7"].item_id, got["sku7"].added_by, got["another"].added_by, got["sku9"].product] == ["new", "7", "me", "you", "p"]
    assert got["sku7"].updated_at == AT + timedelta(days=1) and got["sku9"].updated_at == AT


def test_a_batch_that_comes_again_changes_nothing(spark, store, tmp_path):
    hour = lambda h: AT + timedelta(hours=h)
    first = [(1, 1, 0, 5, hour(1)), (2, 1, 0, 4, hour(2)), (3, 2, 0, 9, hour(1)), (3, 2, 0, 9, hour(1))]
    second = [(4, 1, 0, 7, hour(1)), (5, 2, 0, 8, hour(5)), (6, 3, 1, 1, hour(0))]  # of item 1 nothing newer
    for values in (first, second):
        spark.createDataFrame(values, logs.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = logs.stock_stream(spark, f"{tmp_path}/in", files_at_once=1)
        logs.latest_into(stream, store, f"{tmp_path}/mark").awaitTermination(120)
    want = {(1, 0): 4, (2, 0): 8, (3, 1): 1}
    state = lambda: {(r.item_id, r.shop_id): r.qoh for r in store.read("latest_stock").collect()}
    version = store.version("latest_stock")
    assert state() == want
    again = spark.createDataFrame([(9, 1, 0, 99, hour(99))], logs.SCHEMA)
    for number in (0, 1):  # as if the checkpoint had been lost after the version was claimed
        store.merge("latest_stock", again, batch=("latest_stock", number))
        store.append("eta_log", rows(spark, "eta_log", (number, AT, None, None)), batch=("etas", 0))
    assert state() == want and store.version("latest_stock") == version and store.read("eta_log").count() == 1
    logs.latest_into(logs.stock_stream(spark, f"{tmp_path}/in"), store, f"{tmp_path}/other-mark").awaitTermination(120)  # a new checkpoint numbers from 0
    assert state() == want
    store.merge("latest_stock", again, batch=("latest_stock", version + 5))
    assert state() == want | {(1, 0): 99}
