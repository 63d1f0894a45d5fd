"""Pages by seeking, long series filled in ranges, the newest snapshot."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stockflow.operators import grid, stock
from stockflow.plans import worklists
from stockflow.sources import kept as k


@pytest.mark.parametrize("descending", [False, True])
def test_walking_all_pages_gives_each_row_once(spark, descending):
    rng = random.Random(1)
    values = [(i, rng.choice([None, 1.5, 2.5, 2.5, 7.0]), rng.choice([None, "a", "b", "é"])) for i in range(40)]
    rows = spark.createDataFrame(values, "id int, x double, s string").cache()
    for keys in ([("x", descending), ("id", False)], [("s", descending), ("x", not descending), ("id", descending)]):
        order = [F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_last() for c, d in keys]
        want, got, last = [r.id for r in rows.orderBy(*order).collect()], [], None
        while page := grid.seek_page(rows, keys, last, 11).collect():
            got += [r.id for r in page]
            last = [page[-1][c] for c, _ in keys]
        assert got == want and sorted(got) == list(range(40))


def test_a_seek_reaches_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    plan = grid.seek_page(spark.read.parquet(f"{tmp_path}/t"), [("id", False)], [90], 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_filling_in_ranges_is_filling(spark, span):
    rng = random.Random(span)
    days = lambda key, n: [(key, date(2020, 1, 1) + timedelta(days=i), rng.choice([None, None, None, i])) for i in rng.sample(range(900), n)]
    values = days("hot", 600) + [r for i in range(20) for r in days(f"k{i}", rng.randint(1, 60))] + days(None, 30) + [("none", date(2020, 5, i), None) for i in range(1, 9)]
    rows = spark.createDataFrame(values, "key string, day date, v int")
    want = stock.forward_fill(rows, ["key"], [F.col("day")], "v")
    got = stock.forward_fill_in_ranges(rows, ["key"], "day", "v", span)
    assert got.columns == rows.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    numbers = rows.withColumn("day", F.datediff("day", F.lit(date(2020, 6, 1))))
    want, got = stock.forward_fill(numbers, ["key"], [F.col("day")], "v"), stock.forward_fill_in_ranges(numbers, ["key"], "day", "v", span)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_newest_snapshot_reads_one_folder(spark, sf, tmp_path):
    rows = worklists.newest_levels(spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and rows.select("day").distinct().count() == 1
    empty = spark.createDataFrame([], "x int, day date")
    assert k.newest_snapshot(empty, "day").count() == 0


def test_bound_parameters(spark, sf):
    none = worklists.units_of_shops(spark, sf, shops=(99,))
    assert none.count() == 0 and worklists.units_of_shops(spark, sf, statuses=("' OR 1=1 --",)).count() == 0
