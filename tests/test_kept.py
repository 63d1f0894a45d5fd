"""Kept tables are seen by every driver, follow their inputs, and leave nothing behind; tables of days grow by the days that are missing."""

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockflow.operators import stock
from stockflow.plans import orders, stock as plans
from stockflow.sources import kept as k


def folders(place):
    return sorted(p.name for p in Path(place[7:]).iterdir() if p.is_dir())


def test_two_sessions_and_nested_files(spark, tmp_path):
    made, source = [], f"{tmp_path}/in.parquet"

    def build(session):
        made.append(1)
        return session.range(len(made))

    spark.range(6).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(source)
    other = spark.newSession()
    for s in (spark, other, spark):
        assert k.kept(s, "nested", [source], lambda s=s: build(s)).count() == 1
    assert len(made) == 1
    place = k.place_of(spark, "kept", "nested", [source])
    for n in (2, 3, 4):  # a change within a nested folder shows, and at most two tables stay
        spark.range(n).withColumn("p", F.lit(0)).write.mode("append").partitionBy("p").parquet(source)
        assert k.kept(other, "nested", [source], lambda: build(other)).count() == n == k.kept(spark, "nested", [source], lambda: build(spark)).count()
        assert len(folders(place)) == 2
    assert len(made) == 4


def test_the_second_of_two_builders_takes_the_first_ones_table(spark, tmp_path):
    source = f"{tmp_path}/in.parquet"
    spark.range(3).write.parquet(source)

    def slow():
        k.kept(spark, "race", [source], lambda: spark.range(7))  # another driver is done meanwhile
        return spark.range(5)

    assert k.kept(spark, "race", [source], slow).count() == 7


def test_days_are_made_once(spark, tmp_path):
    built = []

    def build(first, last):
        built.append((first.day, last.day))
        return spark.range(1, 29).select(F.col("id").alias("x"), F.make_date(F.lit(2020), F.lit(1), F.col("id").cast("int")).alias("day")).where(F.col("day").between(F.lit(first), F.lit(last)) & (F.col("x") != 7))

    days = k.Days(spark, f"file://{tmp_path}/days", "s")
    read = lambda a, b, late=0: sorted(r.x for r in days.read(date(2020, 1, a), date(2020, 1, b), build, late).collect())
    assert read(5, 10) == [5, 6, 8, 9, 10] and built == [(5, 10)]
    assert read(6, 11) == [6, 8, 9, 10, 11] and built[1:] == [(11, 11)]  # a day more costs a day
    assert read(3, 14) == [3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14] and built[2:] == [(3, 4), (12, 14)]
    assert read(4, 8) == [4, 5, 6, 8] and len(built) == 4
    assert read(12, 14, late=2) == [12, 13, 14] and built[4:] == [(13, 14)]
    assert read(7, 7) == []
    assert "day" in days.read(date(2020, 1, 7), date(2020, 1, 7), build).columns
    days = k.Days(spark, f"file://{tmp_path}/days", "changed")
    assert read(5, 6) == [5, 6] and built[5:] == [(5, 6)]


def test_another_day_reads_one_day_of_sales(spark, sf):
    """Metrics a day later from daily tables are those of the whole window, and only the added day is made."""
    as_of = plans.t.AS_OF - timedelta(days=1)
    plans.days_of(spark, sf, as_of)
    made = []
    real = plans.demand.daily_units
    plans.demand.daily_units = lambda sold, first, last=None: made.append((first, last)) or real(sold, first, last)
    try:
        units, levels = plans.days_of(spark, sf, plans.t.AS_OF)
    finally:
        plans.demand.daily_units = real
    assert made in ([], [(plans.t.AS_OF, plans.t.AS_OF)])  # none if another test has made it
    want = stock.days_without_stock(plans.target_log(spark, sf), plans.t.AS_OF, plans.SPANS)
    got = stock.out_of_days(levels, plans.t.AS_OF, plans.SPANS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and units.count() > 0


@pytest.mark.parametrize("query", [orders.unmatched_orders, orders.adopted_orders, orders.order_matches])
def test_matching_reads_its_sources_a_few_times(spark, sf, query):
    plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 15
