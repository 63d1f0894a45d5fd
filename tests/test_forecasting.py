import math

import pytest
from pyspark.sql import functions as F

from stockflow.operators import forecasting as fc


def indices(spark, totals, **options):
    rows = spark.createDataFrame([("k", m, None if u is None else float(u)) for m, u in totals.items()], "k string, month int, units double")
    return fc.seasonal_indices(rows, ["k"], **options).first().indices


def test_seasonal_indices(spark):
    assert indices(spark, dict.fromkeys(range(1, 13), 100)) == pytest.approx([1] * 12)
    peak = dict.fromkeys(range(1, 13), 100) | {7: 300}
    got = indices(spark, peak)
    assert got[6] == pytest.approx(2.5714285714) and sum(got) == pytest.approx(12)
    assert 1 < indices(spark, peak, smoothing=2)[6] < got[6]
    assert indices(spark, dict.fromkeys(range(1, 13), 0)) == [1] * 12
    assert indices(spark, {1: 3}, min_total=5) == [1] * 12
    assert indices(spark, {1: -4, 2: 12, 13: 9, 0: 9})[0] == 0
    with pytest.raises(ValueError):
        indices(spark, {1: 1}, smoothing=-1)
    empty = spark.createDataFrame([], "k string, month int, units double")
    assert fc.seasonal_indices(empty, ["k"]).count() == 0


def test_profiles(spark):
    rows = [("Trainers", "", m, 30.0 if m >= 10 else 2.0) for m in range(1, 13)] + [("Nutrition", None, m, 30.0 if 5 <= m <= 7 else 2.0) for m in range(1, 13)] + [("Rare", None, 1, 1.0)]
    history = spark.createDataFrame(rows, "category_top_level string, category_path string, month int, units double")
    got = {r.category: r for r in fc.hierarchical_profiles(history, ["category_path", "category_top_level"], min_group_total=5).collect()}
    assert set(got) == {"Trainers", "Nutrition"} and got["Trainers"].total_units == 108
    assert got["Trainers"].indices[10] > 1.5 and got["Trainers"].indices[5] < 0.5 < 1.5 < got["Nutrition"].indices[5]
    items = spark.createDataFrame([("Trainers", "none"), ("Rare", "none")], "category_top_level string, category_path string")
    found = fc.with_profile(items, fc.hierarchical_profiles(history, ["category_path", "category_top_level"], 5), ["category_path", "category_top_level"])
    assert {r.category_top_level: r.profile_level for r in found.collect()} == {"Trainers": "category_top_level", "Rare": None}


def fold(spark, values, f):
    return spark.createDataFrame([(values,)], "d array<double>").select(f(F.col("d"))).first()[0]


@pytest.mark.parametrize("demand, want", [([], 0), ([0.0] * 4, 0), ([5.0], 5), ([4.0] * 5, 4), ([0.0, 0.0, 0.0, 2.0] * 3, 0.5), ([None, None, 1.0], 1 / 3), ([3.0, None, None], 3)])
def test_croston(spark, demand, want):
    assert fold(spark, demand, fc.croston) == pytest.approx(want)


def test_croston_and_tsb_by_hand(spark):
    demand = [0.0, 3.0, 0.0, 0.0, 5.0, 1.0, 0.0]
    size, gap = 3.0, 2.0
    for v, since in ((5, 3), (1, 1)):
        size, gap = size + 0.1 * (v - size), gap + 0.1 * (since - gap)
    assert fold(spark, demand, fc.croston) == pytest.approx(size / gap)
    size, chance = 3.0, 3 / 7
    for v in demand:
        size, chance = (size + 0.1 * (v - size) if v else size), chance + 0.1 * ((v > 0) - chance)
    assert fold(spark, demand, fc.tsb) == pytest.approx(size * chance)
    assert fold(spark, [], fc.tsb) == 0 and fold(spark, [0.0, 0.0], fc.tsb) == 0 and fold(spark, None, fc.tsb) == 0
    assert fold(spark, [4.0] * 30, lambda d: fc.tsb(d, 0.3, 0.3)) == pytest.approx(4, abs=0.005)
    assert 0 < fold(spark, [3.0] * 3 + [0.0] * 30, lambda d: fc.tsb(d, 0.2, 0.2)) < 3
    for bad in (lambda: fc.croston(F.col("d"), 0), lambda: fc.croston(F.col("d"), 1.5), lambda: fc.tsb(F.col("d"), 0.1, 0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("month, lead, cover, want", [(8, 14, 30, (9, 10)), (8, 60, 30, (10, 11)), (12, 30, 30, (1, 2))])
def test_order_window(spark, month, lead, cover, want):
    first, last = fc.order_window(month, F.lit(float(lead)), F.lit(float(cover)))
    row = spark.range(1).select(first, last, fc.months_between(first, last)).first()
    assert tuple(row[:2]) == want and row[2] == [*range(want[0], want[1] + 1)]


def series(spark, values):
    rows = [("k", 2024 + i // 12, i % 12 + 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, year int, month int, units double")


def flat(spark):
    return spark.range(1).select(F.lit("k").alias("k"), fc.neutral().alias("indices"))


def test_trend_and_forecast(spark):
    even = series(spark, [120] * 12)
    trend = fc.level_trend(even, ["k"], flat(spark))
    got = fc.monthly_forecast(trend, flat(spark), ["k"], 12).orderBy("step").collect()
    assert [r.month for r in got] == [*range(1, 13)] and all(r.units == pytest.approx(120) for r in got)
    assert [r.month for r in fc.monthly_forecast(trend, flat(spark), ["k"], 8, 3).orderBy("step").collect()] == [9, 10, 11]
    growing = fc.level_trend(series(spark, [100 * 1.2 ** (i / 12) for i in range(24)]), ["k"], flat(spark)).first()
    assert growing.annual_growth == pytest.approx(1.2) and growing.monthly_growth == pytest.approx(1.2 ** (1 / 12))
    steep = fc.level_trend(series(spark, [100 * 1.2**i for i in range(24)]), ["k"], flat(spark)).first()
    assert steep.monthly_growth == pytest.approx(1.3 ** (1 / 12))
    short = fc.level_trend(series(spark, [100 * 1.2**i for i in range(12)]), ["k"], flat(spark)).first()
    assert 1 < short.monthly_growth < steep.monthly_growth
    two = fc.level_trend(series(spark, [10, 20]), ["k"], flat(spark)).first()
    assert (two.level, two.monthly_growth, two.months_observed) == (15, 1, 2)
    assert spark.range(1).select(fc.damped(F.lit(3), 0.9)).first()[0] == pytest.approx(0.9 + 0.81 + 0.729)


def test_blended(spark):
    rows = spark.createDataFrame([([2.0] * 6 + [0.0] * 6, [1.0] * 12, 12), (None, [1.0] * 12, 0), ([3.0] * 12, None, 0), (None, None, 5)], "a array<double>, b array<double>, n int")
    got = [r[0] for r in fc.blended(rows, "a", "b", "n").select("indices").collect()]
    assert got == [[1.5] * 6 + [0.5] * 6, [1.0] * 12, [3.0] * 12, [1.0] * 12]


def test_weeks_of_cover(spark):
    rows = [(1, 100.0, 0.0, 0.0, None), (2, 0.0, 0.0, 0.0, None), (3, 100.0, 0.0, 1.0, None), (4, 100.0, 50.0, 1.0, None), (5, 100.0, 0.0, 1.0, [3.0] + [1.0] * 11), (6, None, -5.0, 2.0, [])]
    got = {}
    table = spark.createDataFrame(rows, "id int, on_hand double, on_order double, velocity double, indices array<double>")
    for r in fc.weeks_of_cover(table, 12).orderBy("id", "step").collect():
        got.setdefault(r.id, []).append((r.weeks, r.stockout_risk))
    assert got[1] == [(52.0, "healthy")] * 12 and got[2] == [(0.0, "healthy")] * 12
    weeks = [w for w, _ in got[3]]
    assert weeks[0] == pytest.approx(round(100 / 7, 1)) and weeks == sorted(weeks, reverse=True) and got[3][-1] == (0.0, "critical")
    left = 100.0
    for (w, _), days in zip(got[3], fc.MONTH_DAYS, strict=True):
        assert w == pytest.approx(round(left / 7, 1))
        left = max(0.0, left - days)
    assert got[4][0][0] > got[3][0][0] > got[5][0][0] and got[6][0] == (0.0, "critical")
    first = {r.id: r.steps_to_critical for r in fc.first_critical(fc.weeks_of_cover(table, 12), ["id"]).collect()}
    assert first[1] == 12 and first[6] == 0 and first[3] == next(i for i, (_, risk) in enumerate(got[3]) if risk == "critical")


def test_peaks_take_the_first_of_ties(spark):
    rows = spark.createDataFrame([("k", [1.0, 2.0, 2.0, 0.5, 0.5] + [1.0] * 7)], "k string, indices array<double>")
    assert tuple(fc.peaks(rows, ["k"]).first()) == ("k", 2, 4)
    assert math.isclose(sum(r.seasonal_index for r in fc.by_month(rows).collect()), 13.0)


def test_the_mean_of_indices_does_not_hang_on_their_order(spark):
    """Added up from the left, ten tenths and larger numbers lose their last digits."""
    values = [0.1] * 10 + [1e16, 4.4, -1e16, 0.0]
    rows = spark.createDataFrame([(values,), (values[::-1],), ([0.1, None],)], "x array<double>")
    assert [r.s for r in rows.select(fc.exact_sum("x").alias("s")).collect()] == [math.fsum(values)] * 2 + [None]
    tenths = [0.1] * 10 + [0.2] * 2
    row = fc.mean_one(spark.createDataFrame([(tenths,)], "x array<double>"), "x").first()
    assert row.x == [v / (math.fsum(tenths) / 12) for v in tenths]
