"""Queries on seasons, trends and projections. History starts in 1995 here, and looks back over seven years."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import demand, forecasting as fc
from ..sources import tables as t
from .stock import RECOMMENDED, all_recommendations, latest_lines
from .views import over

YEARS, FLOOR = 7, date(1995, 1, 1)
#: The month before as_of's is the last complete one.
LAST_MONTH = t.AS_OF.month - 1 or 12
LEVELS = ["category_path", "category_level_2", "category_top_level"]


def sold_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = demand.sold_lines(latest_lines(spark, sf_dir), t.sales(spark, sf_dir))
    return sold.join(t.items(spark, sf_dir).select("item_id", "sku", *LEVELS), "item_id")


def category_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = sold_with_items(spark, sf_dir).where(F.col("shop_id").isin(*t.TARGET_SHOPS))
    return demand.monthly_history(sold, [*LEVELS, "shop_id"], t.AS_OF, YEARS, FLOOR)


def monthly_category_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_months(spark, sf_dir)


def item_monthly_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of item 7."""
    sold = sold_with_items(spark, sf_dir).where((F.col("item_id") == 7) & F.col("shop_id").isin(*t.TARGET_SHOPS))
    rows = demand.monthly_history(sold, ["item_id"], t.AS_OF, YEARS, FLOOR)
    top = t.items(spark, sf_dir).groupBy("item_id").agg(F.min("category_top_level").alias("category_top_level"))
    return rows.join(top, "item_id")


def top_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = category_months(spark, sf_dir).groupBy(F.col("category_top_level").alias("category"), "year", "month").agg(F.sum("units").alias("units"))
    return rows


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes))


def seasonality_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fc.by_month(fc.seasonal_indices(top_history(spark, sf_dir), ["category"], smoothing=0.5)))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.hierarchical_profiles(category_months(spark, sf_dir), LEVELS, min_group_total=5.0)


def hierarchical_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices at the two upper levels, to four digits, with the units they rest on."""
    rows = fc.hierarchical_profiles(category_months(spark, sf_dir), LEVELS[1:], min_group_total=5.0)
    return rounded(fc.by_month(rows.withColumnRenamed("total_units", "sample_units")), 4)


def profile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items take their profile from each level."""
    rows = fc.with_profile(t.items(spark, sf_dir), profiles(spark, sf_dir), LEVELS)
    return rows.groupBy(F.coalesce("profile_level", F.lit("none")).alias("profile_level")).agg(F.count("*").alias("items"))


def item_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = sold_with_items(spark, sf_dir)
    return demand.monthly_history(sold, ["item_id", "category_top_level"], t.AS_OF, YEARS, FLOOR)


def blended_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item, its own indices and its top category's, by the months that it has history in."""
    months = item_months(spark, sf_dir)
    own = fc.seasonal_indices(months, ["item_id", "category_top_level"])
    seen = months.groupBy("item_id").agg(F.count_distinct(F.struct("year", "month")).alias("months"))
    category = fc.seasonal_indices(top_history(spark, sf_dir), ["category"]).select(F.col("category").alias("category_top_level"), F.col("indices").alias("of_category"))
    rows = own.join(seen, "item_id").join(category, "category_top_level", "left")
    rows = fc.blended(rows.withColumnRenamed("indices", "own"), "own", "of_category", "months")
    return rounded(fc.by_month(rows.select("item_id", "months", "indices")))


def trends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    history = top_history(spark, sf_dir)
    seasons = fc.seasonal_indices(history, ["category"])
    return fc.level_trend(history, ["category"], seasons), seasons


def level_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trends(spark, sf_dir)[0])


def loglinear_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual growth by a line through the logs of the last 17 months' units, which are too few to compare years."""
    history = top_history(spark, sf_dir).where("year * 12 + month > 2001 * 12 + 7 - 17")
    flat = history.select("category").distinct().withColumn("indices", fc.neutral())
    return rounded(fc.level_trend(history, ["category"], flat).select("category", "raw_growth", "annual_growth", "months_observed"))


def monthly_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend, seasons = trends(spark, sf_dir)
    return rounded(fc.monthly_forecast(trend, seasons, ["category"], LAST_MONTH), 4)


def demand_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and forecast of each top category in one series, with whether an order placed now covers the month."""
    trend, seasons = trends(spark, sf_dir)
    ahead = fc.monthly_forecast(trend, seasons, ["category"], LAST_MONTH)
    rows = fc.labelled_series(top_history(spark, sf_dir), ahead, ["category"], t.AS_OF.year, LAST_MONTH)
    first, last = fc.order_window(LAST_MONTH, F.lit(14.0), F.lit(60.0))
    covered = (F.col("kind") == "forecast") & F.array_contains(fc.months_between(first, last), F.col("month"))
    return rounded(rows.withColumn("covered", covered), 4)


def weeks_of_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recommendation's stock over the months ahead, by the indices of its category's most specific profile."""
    return cover(spark, sf_dir).select("item_id", "shop_id", "step", "month", "weeks", "stockout_risk")


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_recommendations(spark, sf_dir).select("item_id", "shop_id", "on_hand", "on_order", F.col("base_velocity").alias("velocity"))
    items = t.items(spark, sf_dir).select("item_id", *LEVELS)
    rows = fc.with_profile(rows.join(items, "item_id"), profiles(spark, sf_dir), LEVELS).withColumnRenamed("profile", "indices")
    return fc.weeks_of_cover(rows.drop(*LEVELS, "profile_level"), LAST_MONTH)


def first_stockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.first_critical(cover(spark, sf_dir), ["item_id", "shop_id"])


def slow_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Croston's and the TSB estimate of each item's units a month, from its first month with a sale to the last complete one, months without sales too."""
    months = fc.on_spine(item_months(spark, sf_dir), ["item_id"], FLOOR, date(t.AS_OF.year, LAST_MONTH, 1))
    rows = fc.demand_array(months, ["item_id"], "at")
    return rounded(rows.select("item_id", fc.croston(F.col("demand")).alias("croston"), fc.tsb(F.col("demand")).alias("tsb")))


def peak_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.peaks(fc.seasonal_indices(top_history(spark, sf_dir), ["category"]), ["category"])


def profile_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fc.seasonal_indices(top_history(spark, sf_dir), ["category"])
    return rounded(fc.pivoted(rows, ["ECONOMY", "PROMO", "NO SUCH"]).withColumnRenamed("NO SUCH", "none"))


QUERIES = {
    f.__name__: f
    for f in (
        monthly_category_history, item_monthly_history, seasonality_indices, hierarchical_profiles, profile_levels, blended_indices, level_trend, loglinear_growth,
        monthly_forecast, demand_series, weeks_of_cover, first_stockouts, slow_movers, peak_months, profile_pivot,
    )
}


def _indices(history: str, keys: str, smoothing: float = 0.0) -> str:
    """SQL of (keys, total, month, x) from a relation with keys, month and units."""
    return f"""SELECT {keys}, total, month, CASE WHEN total > 0 THEN CASE WHEN m > 0 THEN raw / m ELSE 1 END ELSE 1 END AS x FROM (
    SELECT *, avg(raw) OVER (PARTITION BY {keys}) AS m FROM (
      SELECT {keys}, total, month, (coalesce(CASE WHEN total > 0 THEN u / (total / 12.0) END, 1.0) + {smoothing}::DOUBLE) / (1 + {smoothing}::DOUBLE) AS raw FROM (
        SELECT {keys}, sum(greatest(u, 0)) AS total FROM (SELECT {keys}, month, sum(units)::DOUBLE AS u FROM {history} GROUP BY ALL) GROUP BY ALL)
      CROSS JOIN (SELECT unnest(range(1, 13))::INTEGER AS month)
      LEFT JOIN (SELECT {keys}, month::INTEGER AS month, greatest(sum(units)::DOUBLE, 0) AS u FROM {history} GROUP BY ALL) USING ({keys}, month)))"""


_HISTORY = """SELECT {keys}, year(complete_time) AS year, month(complete_time) AS month, sum(quantity) AS units FROM sold JOIN items USING (item_id)
  WHERE complete_time::DATE >= DATE '1995-01-01' AND complete_time::DATE < DATE '2001-08-01' AND NOT is_warranty {where} GROUP BY ALL"""
_SHOPS = "AND shop_id IN (0, 1, 2)"
_MORE = {
    "months": _HISTORY.format(keys="category_path, category_level_2, category_top_level, shop_id", where=_SHOPS),
    "top_months": "SELECT category_top_level AS category, year, month, sum(units) AS units FROM months GROUP BY ALL",
    "own_months": _HISTORY.format(keys="item_id, category_top_level", where=""),
    "unpivoted": " UNION ALL ".join(f"SELECT '{c}' AS level, {c} AS category, month, units FROM months" for c in LEVELS),
    "top_index": _indices("top_months", "category"),
    "level_index": f"SELECT * FROM ({_indices('unpivoted', 'level, category')}) WHERE total > 5",
    "deseasoned": """SELECT *, row_number() OVER (PARTITION BY category ORDER BY year, month) AS nth, count(*) OVER (PARTITION BY category) AS n FROM (
    SELECT h.category, h.year, h.month, h.units, h.units / CASE WHEN i.x > 0 THEN i.x ELSE 1 END AS level FROM top_months h JOIN top_index i ON i.category = h.category AND i.month = h.month)""",
    "trend": """SELECT category, months_observed, raw_growth, CASE WHEN ok THEN l3 ELSE total / months_observed END AS level, CASE WHEN ok THEN annual ELSE 1 END AS annual_growth, CASE WHEN ok THEN pow(annual, 1 / 12::DOUBLE) ELSE 1 END AS monthly_growth FROM (
    SELECT *, 1 + (greatest(0.85::DOUBLE, least(1.3::DOUBLE, raw_growth)) - 1) * least(1, months_observed / 24.0) AS annual, months_observed >= 3 AND l3 > 0 AS ok FROM (
      SELECT *, CASE WHEN months_observed >= 18 THEN CASE WHEN prior > 0 THEN l12 / prior ELSE 1 END ELSE CASE WHEN points >= 2 THEN exp(coalesce(slope, 0) * 12) ELSE 1 END END AS raw_growth FROM (
        SELECT category, max(n) AS months_observed, avg(level) FILTER (n - nth < 3) AS l3, avg(level) FILTER (n - nth < 12) AS l12, avg(level) FILTER (n - nth >= 12 AND n - nth < 24) AS prior,
          sum(greatest(units, 0)) AS total, count(*) FILTER (level > 0) AS points, regr_slope(CASE WHEN level > 0 THEN ln(level) END, CASE WHEN level > 0 THEN nth END) AS slope FROM deseasoned GROUP BY 1)))""",
    "ahead": """SELECT t.category, step, i.month, t.level * pow(t.monthly_growth, (1 - pow(0.9::DOUBLE, step)) * (0.9::DOUBLE / (1 - 0.9::DOUBLE))) * CASE WHEN i.x > 0 THEN i.x ELSE 1 END AS units, CASE WHEN i.x > 0 THEN i.x ELSE 1 END AS seasonal_index
    FROM trend t CROSS JOIN (SELECT unnest(range(1, 13))::INTEGER AS step) JOIN top_index i ON i.category = t.category AND i.month = (6 + step) % 12 + 1""",
    "recommended": RECOMMENDED,
    "indexed": """SELECT r.item_id, r.shop_id, greatest(0, r.on_hand) + greatest(0, r.on_order) AS stock, r.v, s.step, (6 + s.step) % 12 + 1 AS month, CASE WHEN coalesce(a.x, b.x, c.x) > 0 THEN coalesce(a.x, b.x, c.x) ELSE 1 END AS x,
    [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][(6 + s.step) % 12 + 1] AS days
    FROM recommended r JOIN items i USING (item_id) CROSS JOIN (SELECT unnest(range(1, 13))::INTEGER AS step) s
    LEFT JOIN level_index a ON a.level = 'category_path' AND a.category = i.category_path AND a.month = (6 + s.step) % 12 + 1
    LEFT JOIN level_index b ON b.level = 'category_level_2' AND b.category = i.category_level_2 AND b.month = (6 + s.step) % 12 + 1
    LEFT JOIN level_index c ON c.level = 'category_top_level' AND c.category = i.category_top_level AND c.month = (6 + s.step) % 12 + 1""",
    "covered": """SELECT *, CASE WHEN v > 0 AND weeks < 2 THEN 'critical' WHEN v > 0 AND weeks < 4 THEN 'low' ELSE 'healthy' END AS stockout_risk FROM (
    SELECT *, CASE WHEN v * 7 * x > 0 THEN least(52, half_even(left_over / (v * 7 * x), 1)) WHEN left_over > 0 THEN 52 ELSE 0 END::DOUBLE AS weeks FROM (
      SELECT *, greatest(0, stock - coalesce(sum(v * days * x) OVER (PARTITION BY item_id, shop_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS left_over FROM indexed))""",
}

ORACLES = {
    "monthly_category_history": over("SELECT * FROM months", **_MORE),
    "item_monthly_history": over("SELECT item_id, year, month, units, category_top_level FROM only_7", only_7=_HISTORY.format(keys="item_id, category_top_level", where=_SHOPS + " AND item_id = 7")),
    "seasonality_indices": over("SELECT category, round(total, 6) AS total_units, month, round(x, 6) AS seasonal_index FROM smooth", smooth=_indices("top_months", "category", 0.5), **_MORE),
    "hierarchical_profiles": over("SELECT level, category, round(total, 4) AS sample_units, month, round(x, 4) AS seasonal_index FROM level_index WHERE level <> 'category_path'", **_MORE),
    "profile_levels": over(
        """SELECT CASE WHEN category_path IN (SELECT category FROM level_index WHERE level = 'category_path') THEN 'category_path' WHEN category_level_2 IN (SELECT category FROM level_index WHERE level = 'category_level_2') THEN 'category_level_2'
  WHEN category_top_level IN (SELECT category FROM level_index WHERE level = 'category_top_level') THEN 'category_top_level' ELSE 'none' END AS profile_level, count(*) AS items FROM items GROUP BY 1""",
        **_MORE,
    ),
    "blended_indices": over(
        """SELECT item_id, months, month, round(CASE WHEN cx IS NULL THEN x WHEN m > 0 THEN b / m ELSE 1 END, 6) AS seasonal_index FROM (
  SELECT *, avg(b) OVER (PARTITION BY item_id) AS m FROM (
    SELECT o.item_id, s.months, o.month, o.x, c.x AS cx, least(1, s.months / 24.0) * o.x + (1 - least(1, s.months / 24.0)) * c.x AS b
    FROM own_index o JOIN (SELECT item_id, count(*) AS months FROM (SELECT DISTINCT item_id, year, month FROM own_months) GROUP BY 1) s USING (item_id) LEFT JOIN top_index c ON c.category = o.category_top_level AND c.month = o.month))""",
        own_index=_indices("own_months", "item_id, category_top_level"),
        **_MORE,
    ),
    "level_trend": over("SELECT category, round(level, 6) AS level, round(monthly_growth, 6) AS monthly_growth, round(annual_growth, 6) AS annual_growth, round(raw_growth, 6) AS raw_growth, months_observed FROM trend", **_MORE),
    "loglinear_growth": over(
        """SELECT category, round(g, 6) AS raw_growth, round(CASE WHEN ok THEN 1 + (greatest(0.85::DOUBLE, least(1.3::DOUBLE, g)) - 1) * least(1, n / 24.0) ELSE 1 END, 6) AS annual_growth, n AS months_observed FROM (
  SELECT category, count(*) AS n, CASE WHEN count(*) FILTER (units > 0) >= 2 THEN exp(coalesce(regr_slope(CASE WHEN units > 0 THEN ln(units) END, CASE WHEN units > 0 THEN nth END), 0) * 12) ELSE 1 END AS g, count(*) >= 3 AND avg(units) FILTER (back <= 3) > 0 AS ok
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY year, month) AS nth, row_number() OVER (PARTITION BY category ORDER BY year DESC, month DESC) AS back FROM top_months WHERE year * 12 + month > 2001 * 12 + 7 - 17) GROUP BY 1)""",
        **_MORE,
    ),
    "monthly_forecast": over("SELECT category, step, month, round(units, 4) AS units, round(seasonal_index, 4) AS seasonal_index FROM ahead", **_MORE),
    "demand_series": over(
        """SELECT category, year, month, round(units, 4) AS units, 'history' AS kind, false AS covered FROM top_months
  UNION ALL SELECT category, 2001 + (6 + step) // 12, month, round(units, 4), 'forecast', month IN (8, 9, 10) FROM ahead""",
        **_MORE,
    ),
    "weeks_of_cover": over("SELECT item_id, shop_id, step, month, weeks, stockout_risk FROM covered", **_MORE),
    "first_stockouts": over("SELECT item_id, shop_id, coalesce(min(CASE WHEN stockout_risk = 'critical' THEN step - 1 END), 12) AS steps_to_critical FROM covered GROUP BY ALL", **_MORE),
    "slow_movers": over(
        """SELECT item_id, round(CASE WHEN c.gap > 0 THEN c.size / c.gap ELSE 0 END, 6) AS croston, round(greatest(0, b.size * b.chance), 6) AS tsb FROM (
  SELECT item_id,
    list_reduce(list_transform(d, lambda v: {'size': v, 'gap': 0.0::DOUBLE, 'since': 0.0::DOUBLE}), lambda s, x: {
      'size': CASE WHEN x.size > 0 THEN CASE WHEN s.size <= 0 THEN x.size ELSE s.size + 0.1::DOUBLE * (x.size - s.size) END ELSE s.size END,
      'gap': CASE WHEN x.size > 0 THEN CASE WHEN s.size <= 0 THEN s.since + 1 ELSE s.gap + 0.1::DOUBLE * (s.since + 1 - s.gap) END ELSE s.gap END,
      'since': CASE WHEN x.size > 0 THEN 0 ELSE s.since + 1 END}, {'size': 0.0::DOUBLE, 'gap': 0.0::DOUBLE, 'since': 0.0::DOUBLE}) AS c,
    list_reduce(list_transform(d, lambda v: {'size': v, 'chance': 0.0::DOUBLE}), lambda s, x: {
      'size': CASE WHEN x.size > 0 THEN s.size + 0.1::DOUBLE * (x.size - s.size) ELSE s.size END, 'chance': s.chance + 0.1::DOUBLE * (CASE WHEN x.size > 0 THEN 1 ELSE 0 END - s.chance)},
      {'size': coalesce(list_filter(d, lambda v: v > 0)[1], 0)::DOUBLE, 'chance': len(list_filter(d, lambda v: v > 0)) / len(d)::DOUBLE}) AS b
  FROM (SELECT item_id, list(coalesce(units, 0)::DOUBLE ORDER BY m) AS d FROM
      (SELECT item_id, unnest(range(min(year * 12 + month), 2001 * 12 + 8)) AS m FROM own_months GROUP BY 1) LEFT JOIN (SELECT item_id, year * 12 + month AS m, units FROM own_months) USING (item_id, m) GROUP BY 1))""",
        **_MORE,
    ),
    "peak_months": over("SELECT category, arg_max(month, (x, -month)) AS peak_month, arg_min(month, (x, month)) AS trough_month FROM top_index GROUP BY 1", **_MORE),
    "profile_pivot": over("SELECT m.month, round(coalesce(max(CASE WHEN category = 'ECONOMY' THEN x END), 1), 6) AS \"ECONOMY\", round(coalesce(max(CASE WHEN category = 'PROMO' THEN x END), 1), 6) AS \"PROMO\", 1.0::DOUBLE AS none FROM top_index m GROUP BY 1", **_MORE),
}
