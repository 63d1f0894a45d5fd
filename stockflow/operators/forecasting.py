"""Seasonal indices, trends and projections. A profile is an array of twelve indices, month 1 first, with a mean of 1."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import clamp, half_even, month_after

MONTHS = 12
# Days of each month.
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def neutral(n: int = MONTHS) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def exact_sum(values: str) -> Column:
    """The sum of an array of doubles with what each addition rounds off put back at the end (Neumaier), so that its last digit doesn't hang on their order; null if one is null."""

    def step(s: Column, x: Column) -> Column:
        both = s["sum"] + x
        lost = F.when(F.abs(s["sum"]) >= F.abs(x), (s["sum"] - both) + x).otherwise((x - both) + s["sum"])
        return F.struct(both.alias("sum"), (s["lost"] + lost).alias("lost"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost")), step, lambda s: s["sum"] + s["lost"])


def mean_one(rows: DataFrame, column: str, n: int = MONTHS) -> DataFrame:
    """rows with the indices of a column over their mean; all 1 if that isn't above 0. The mean is a column of its own, so that it is computed once."""
    rows = rows.withColumn("mean_of_all", exact_sum(column) / n)
    mean = F.col("mean_of_all")
    return rows.withColumn(column, F.when(mean > 0, F.transform(column, lambda x: x / F.when(mean > 0, mean))).when(F.col(column).isNotNull(), neutral(n))).drop("mean_of_all")


def seasonal_indices(history: DataFrame, keys: list[str], period: str = "month", units: str = "units", n: int = MONTHS, min_total: float = 0.0, smoothing: float = 0.0) -> DataFrame:
    """keys, total_units and indices: how each period's units stand to the mean over all periods.

    Units below 0 count as 0, periods out of range don't count. A period without rows is average, one with 0 units is 0. Smoothing pulls
    indices to 1. All are 1 if the total isn't above min_total. A key is n sums at most before it is one row.
    """
    if smoothing < 0:
        raise ValueError("smoothing is 0 or above")
    rows = history.where(F.col(period).between(1, n)).groupBy(*keys, period).agg(F.sum(F.coalesce(units, F.lit(0.0))).alias("u"))
    rows = rows.withColumn("u", F.greatest(F.col("u"), F.lit(0.0)).cast("double"))
    sums = rows.groupBy(*keys).agg(F.sum("u").alias("total_units"), F.map_from_entries(F.collect_list(F.struct(F.col(period).cast("int").alias("p"), "u"))).alias("by_period"))
    enough = (F.col("total_units") > min_total) & (F.col("total_units") > 0)
    share = F.when(enough, F.col("total_units") / n)
    raw = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda p: (F.coalesce(F.try_element_at("by_period", p) / share, F.lit(1.0)) + smoothing) / (1 + smoothing))
    rows = mean_one(sums.withColumn("indices", raw), "indices", n)
    return rows.withColumn("indices", F.when(enough, F.col("indices")).otherwise(neutral(n))).drop("by_period")


def by_month(profiles: DataFrame, value: str = "seasonal_index") -> DataFrame:
    """A row per month of each profile."""
    return profiles.select(*[c for c in profiles.columns if c != "indices"], F.posexplode("indices").alias("at", value)).withColumn("month", F.col("at") + 1).drop("at")


def index_of(indices: Column, month: Column) -> Column:
    """A month's index; 1 where there is none or it isn't above 0."""
    x = F.get(indices, month.cast("int") - 1)
    return F.when(x > 0, x).otherwise(1.0)


def hierarchical_profiles(history: DataFrame, levels: list[str], min_group_total: float = 0.0, smoothing: float = 0.0) -> DataFrame:
    """(level, category, total_units, indices) for each category of each level, from one read of the history.

    Categories without a name, and those of min_group_total units or fewer, have none.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).alias("category")) for c in levels)))
    rows = history.select(pairs.alias("at"), "month", "units").select("at.*", "month", "units").where(F.trim("category") != "")
    found = seasonal_indices(rows, ["level", "category"], smoothing=smoothing)
    return found.where((F.col("total_units") > min_group_total) & (F.col("total_units") > 0))


def with_profile(rows: DataFrame, profiles: DataFrame, levels: list[str]) -> DataFrame:
    """rows with profile and profile_level, those of the first of levels that has one; null if none has."""
    for i, level in enumerate(levels):
        own = profiles.where(F.col("level") == level).select(F.col("category").alias(level), F.col("indices").alias(f"profile_{i}"))
        rows = rows.join(own, level, "left")
    n = range(len(levels))
    name = F.coalesce(*(F.when(F.col(f"profile_{i}").isNotNull(), F.lit(levels[i])) for i in n))
    return rows.withColumns({"profile": F.coalesce(*(F.col(f"profile_{i}") for i in n)), "profile_level": name}).drop(*(f"profile_{i}" for i in n))


def blended(rows: DataFrame, own: str, category: str, months: str, full: float = 24.0) -> DataFrame:
    """rows with indices: own ones by the share of `full` months that were seen, the category's for the rest. Of one alone that one; of none 1."""
    if full <= 0:
        raise ValueError("full is above 0")
    w = clamp(F.col(months) / F.lit(full), 0.0, 1.0)
    rows = mean_one(rows.withColumn("both", F.zip_with(own, category, lambda a, b: w * a + (1 - w) * b)), "both")
    one = F.when(F.col(own).isNull(), F.coalesce(category, neutral())).when(F.col(category).isNull(), F.col(own))
    return rows.withColumn("indices", one.otherwise(F.col("both"))).drop("both")


def on_spine(history: DataFrame, keys: list[str], first: date, last: date, units: str = "units") -> DataFrame:
    """(keys, at, units) of every month from each key's first one with a row, or `first` if that is later, to `last`: 0 where a month has none.

    at counts months: year * 12 + month. Units of months are summed before months are filled in.
    """
    count = lambda d: d.year * 12 + d.month
    sums = history.withColumn("at", F.col("year") * 12 + F.col("month")).where(F.col("at").between(count(first), count(last))).groupBy(*keys, "at").agg(F.sum(units).cast("double").alias("own_units"))
    spans = sums.groupBy(*keys).agg(F.min("at").alias("from_at")).withColumn("at", F.explode(F.sequence(F.col("from_at"), F.lit(count(last))))).drop("from_at")
    return spans.join(sums, [*keys, "at"], "left").select(*keys, "at", F.coalesce("own_units", F.lit(0.0)).alias(units))


def demand_array(history: DataFrame, keys: list[str], order: str, units: str = "units") -> DataFrame:
    """keys and demand: the units of a key in order, oldest first, for the two folds below."""
    return history.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, units))), lambda x: x[units]).alias("demand"))


def croston(demand: Column, alpha: float = 0.1) -> Column:
    """Demand per period of a slow mover: smoothed size of demands over smoothed distance between them. 0 without demand; null is 0."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha is above 0, and 1 at most")
    start = F.struct(F.lit(0.0).alias("size"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("since"))

    def step(s: Column, value: Column) -> Column:
        v, since = F.coalesce(value.cast("double"), F.lit(0.0)), s["since"] + 1
        first = s["size"] <= 0
        size, gap = F.when(first, v).otherwise(s["size"] + alpha * (v - s["size"])), F.when(first, since).otherwise(s["gap"] + alpha * (since - s["gap"]))
        return F.struct(F.when(v > 0, size).otherwise(s["size"]).alias("size"), F.when(v > 0, gap).otherwise(s["gap"]).alias("gap"), F.when(v > 0, 0.0).otherwise(since).alias("since"))

    return F.coalesce(F.aggregate(demand, start, step, lambda s: F.when(s["gap"] > 0, s["size"] / F.when(s["gap"] > 0, s["gap"])).otherwise(0.0)), F.lit(0.0))


def tsb(demand: Column, alpha: float = 0.1, beta: float = 0.1) -> Column:
    """As croston, with the smoothed chance of demand in a period in place of the distance, so that it fades once an item stops selling."""
    if not 0 < alpha <= 1 or not 0 < beta <= 1:
        raise ValueError("alpha and beta are above 0, and 1 at most")
    values = F.transform(F.coalesce(demand, F.array().cast("array<double>")), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    sold = F.filter(values, lambda x: x > 0)
    share = F.size(sold) / F.greatest(F.size(values), F.lit(1))
    start = F.struct(F.coalesce(F.get(sold, F.lit(0)), F.lit(0.0)).alias("size"), share.cast("double").alias("chance"))

    def step(s: Column, v: Column) -> Column:
        size = F.when(v > 0, s["size"] + beta * (v - s["size"])).otherwise(s["size"])
        return F.struct(size.alias("size"), (s["chance"] + alpha * (F.when(v > 0, 1.0).otherwise(0.0) - s["chance"])).alias("chance"))

    return F.aggregate(values, start, step, lambda s: F.greatest(s["size"] * s["chance"], F.lit(0.0)))


def level_trend(history: DataFrame, keys: list[str], profiles: DataFrame, cap: tuple[float, float] = (0.85, 1.30), full: float = 24.0) -> DataFrame:
    """keys, level, monthly_growth, annual_growth and months_observed, from (keys, year, month, units) and profiles (keys, indices).

    Units over their seasonal index are the level of a month; months without rows are left out. The level is the mean of the last 3.
    Growth is that of the last 12 months to the 12 before, or to all before if there are fewer, from 18 months on; below, it is that of a line through
    the logs of levels. It is held within cap and pulled to 1 where fewer than `full` months were seen. Below 3 months, and
    where the level isn't above 0, the level is the mean of units and there is no growth.
    """
    months = history.groupBy(*keys, "year", "month").agg(F.sum("units").cast("double").alias("units"))
    rows = months.join(profiles.select(*keys, "indices"), keys, "left")
    rows = rows.withColumn("level", F.col("units") / index_of(F.col("indices"), F.col("month")))
    own = Window.partitionBy(*keys)
    rows = rows.withColumns({"nth": F.row_number().over(own.orderBy("year", "month")), "n": F.count("*").over(own)}).withColumn("back", F.col("n") - F.col("nth") + 1)
    mean = lambda a, b: F.avg(F.when(F.col("back").between(a, b), F.col("level")))
    up = F.col("level") > 0
    sums = rows.groupBy(*keys).agg(
        F.max("n").alias("months_observed"),
        mean(1, 3).alias("last_3"),
        mean(1, 12).alias("last_12"),
        mean(13, 24).alias("before"),
        F.sum(F.greatest("units", F.lit(0.0))).alias("total"),
        F.count_if(up).alias("points"),
        F.regr_slope(F.ln(F.when(up, F.col("level"))), F.when(up, F.col("nth").cast("double"))).alias("slope"),
    )
    yearly = F.when(F.col("before") > 0, F.col("last_12") / F.when(F.col("before") > 0, F.col("before"))).otherwise(1.0)
    line = F.when(F.col("points") >= 2, F.exp(F.coalesce("slope", F.lit(0.0)) * 12)).otherwise(1.0)
    growth = F.when(F.col("months_observed") >= 18, yearly).otherwise(line)
    weight = clamp(F.col("months_observed") / F.lit(full), 0.0, 1.0)
    trusted = (F.col("months_observed") >= 3) & (F.col("last_3") > 0)
    annual = 1 + (clamp(growth, *cap) - 1) * weight
    return sums.select(
        *keys,
        F.when(trusted, F.col("last_3")).otherwise(F.col("total") / F.col("months_observed")).alias("level"),
        F.when(trusted, F.pow(annual, F.lit(1 / 12))).otherwise(1.0).alias("monthly_growth"),
        F.when(trusted, annual).otherwise(1.0).alias("annual_growth"),
        growth.alias("raw_growth"),
        "months_observed",
    )


def damped(step: Column, damping: float) -> Column:
    """damping + damping^2 + ... + damping^step."""
    return step.cast("double") if damping == 1 else (1 - F.pow(F.lit(damping), step)) * (damping / (1 - damping))


def monthly_forecast(trend: DataFrame, profiles: DataFrame, keys: list[str], month: int, horizon: int = 12, damping: float = 0.9) -> DataFrame:
    """keys, step, month, units and seasonal_index of the months after `month`: level, damped growth and season."""
    rows = trend.join(profiles.select(*keys, "indices"), keys, "left").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    rows = rows.withColumn("month", month_after(F.lit(month), F.col("step"))).withColumn("index", index_of(F.col("indices"), F.col("month")))
    units = F.col("level") * F.pow("monthly_growth", damped(F.col("step"), damping)) * F.col("index")
    return rows.select(*keys, "step", "month", units.alias("units"), F.col("index").alias("seasonal_index"))


def order_window(month: int | Column, lead_days: Column, cover_days: Column) -> tuple[Column, Column]:
    """First and last month that an order placed in `month` covers."""
    month = F.lit(month) if isinstance(month, int) else month
    periods = lambda days: F.greatest(F.lit(1), half_even(days / F.lit(30.0), 0).cast("int"))
    start = periods(lead_days)
    return month_after(month, start), month_after(month, start + periods(cover_days))


def months_between(first: Column, last: Column) -> Column:
    """The months from first to last, over the end of the year if need be."""
    return F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(MONTHS))), lambda i: month_after(first, i))


def weeks_of_cover(rows: DataFrame, month: int, horizon: int = 12, critical: float = 2.0, low: float = 4.0) -> DataFrame:
    """A row for each of rows (on_hand, on_order, velocity, indices, and any others) and month ahead: weeks that the stock at the month's start would last.

    What is on hand and on order shrinks by each month's demand and stops at 0. Demand isn't negative, so the start of a month is
    the first stock less all demand before it: sums over the array of twelve indices, and no row waits for another.
    """
    rows = rows.withColumns({"stock": F.greatest(F.coalesce("on_hand", F.lit(0)).cast("double"), F.lit(0.0)) + F.greatest(F.coalesce("on_order", F.lit(0)).cast("double"), F.lit(0.0)), "v": F.greatest(F.coalesce("velocity", F.lit(0.0)), F.lit(0.0))})
    days = F.array(*(F.lit(float(d)) for d in MONTH_DAYS))
    ahead = lambda k: month_after(F.lit(month), k)
    demand = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.col("v") * F.get(days, ahead(k) - 1) * index_of(F.col("indices"), ahead(k)))
    rows = rows.withColumn("demand", demand).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    before = F.aggregate(F.slice("demand", F.lit(1), F.col("step") - 1), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumns({"month": ahead(F.col("step")), "left": F.greatest(F.col("stock") - before, F.lit(0.0))})
    weekly = F.col("v") * 7 * index_of(F.col("indices"), F.col("month"))
    weeks = F.when(weekly > 0, F.least(F.lit(52.0), half_even(F.col("left") / F.when(weekly > 0, weekly), 1))).otherwise(F.when(F.col("left") > 0, 52.0).otherwise(0.0))
    rows = rows.withColumn("weeks", weeks)
    risk = F.when((F.col("v") > 0) & (F.col("weeks") < critical), "critical").when((F.col("v") > 0) & (F.col("weeks") < low), "low").otherwise("healthy")
    return rows.withColumn("stockout_risk", risk).drop("stock", "v", "demand", "left")


def first_critical(cover: DataFrame, keys: list[str], horizon: int = 12) -> DataFrame:
    """keys and steps_to_critical: months until the first critical one, from 0; horizon if there is none."""
    return cover.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("stockout_risk") == "critical", F.col("step") - 1)), F.lit(horizon)).alias("steps_to_critical"))


def peaks(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Months of the highest and the lowest index; of equal ones the first."""
    rows = by_month(profiles)
    return rows.groupBy(*keys).agg(F.max_by("month", F.struct("seasonal_index", -F.col("month"))).alias("peak_month"), F.min_by("month", F.struct("seasonal_index", "month")).alias("trough_month"))


def pivoted(profiles: DataFrame, names: list[str]) -> DataFrame:
    """A row per month and a column per name of `category`; 1 where it has no profile."""
    rows = by_month(profiles)
    out = rows.groupBy("month").pivot("category", names).agg(F.first("seasonal_index"))
    return out.fillna(1.0, names)


def labelled_series(history: DataFrame, forecast: DataFrame, keys: list[str], year: int, month: int) -> DataFrame:
    """History and forecast as one series: keys, year, month, units, kind. Forecast years follow from `year`, in which `month` is the last known one."""
    ahead = forecast.withColumn("year", F.lit(year) + F.floor((F.lit(month - 1) + F.col("step")) / 12).cast("int"))
    parts = [history.select(*keys, "year", "month", F.col("units").cast("double"), F.lit("history").alias("kind")), ahead.select(*keys, "year", "month", "units", F.lit("forecast").alias("kind"))]
    return reduce(DataFrame.unionByName, parts)
