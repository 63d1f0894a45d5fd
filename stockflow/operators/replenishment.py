"""Order recommendations: guarded velocity, reorder points, status of stock and momentum of demand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ceil_units, clamp, divided, half_even, ordered_case, positive, short_number

MODES = ("raw", "min_days", "cap", "shrink")
#: Weights of the last 14 days, days 15-30 and days 31-60.
PRESETS = {"stable": (0.2, 0.4, 0.4), "balanced": (0.4, 0.4, 0.2), "reactive": (0.6, 0.3, 0.1)}
# Statuses, from the one to look at first, with how urgent each is.
STATUSES = ("critical", "low", "warning", "healthy", "incoming", "on_target", "high", "overstock", "no_demand")
URGENCY = {"critical": 5, "low": 4, "warning": 3, "healthy": 2, "incoming": 2, "on_target": 1, "high": 1, "overstock": 1, "no_demand": 0}
LOCATIONS = {0: "North", 1: "Centre", 2: "South"}


@dataclass(frozen=True)
class Settings:
    """What a user may set. Weights are given all or not at all; without them, recent_30d_weight goes to days 15-30, the rest to older days."""

    weights: tuple[float | None, float | None, float | None] = (0.4, 0.4, 0.2)
    recent_30d_weight: float = 0.75
    mode: str = "shrink"
    safety_days: float = 7.0
    forecast_days: float | None = 60.0
    growth: float = 1.0

    def __post_init__(self):
        given = [w for w in self.weights if w is not None]
        if given and (len(given) < 3 or not all(0 <= w <= 1 for w in given) or abs(sum(given) - 1) > 0.001):
            raise ValueError("give three weights, each from 0 to 1, that sum to 1")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if self.safety_days < 0 or (self.forecast_days or 60) <= 0 or self.growth <= 0:
            raise ValueError("safety days may not be below 0; forecast days and growth are above 0")

    @property
    def shares(self) -> tuple[float, float, float]:
        if None not in self.weights:
            return self.weights
        w = min(1.0, max(0.0, self.recent_30d_weight))
        return 0.0, w, 1.0 - w


def active_days(days: int, out: Column, sale_days: Column) -> Column:
    """Days on which an item could be sold: at least 3 and those with sales, at most all."""
    return F.greatest(F.lit(1), F.least(F.lit(days), F.greatest(F.lit(days) - out, sale_days, F.lit(3))))


def daily_sales(units: Column, days: int, active: Column, mode: str = "shrink") -> Column:
    """Units a day. Few active days make the figure per active day shaky, so all modes but raw pull it to that of all days. Unknown modes shrink."""
    per_active, per_day = units / F.greatest(active, F.lit(1)), units / F.lit(float(days))
    if mode == "raw":
        return per_active
    if mode == "min_days":
        return F.when(active >= 7, per_active).otherwise(per_day)
    if mode == "cap":
        return F.least(per_active * days, units * 2) / F.lit(float(days))
    return per_day + (per_active - per_day) * F.least(F.lit(1.0), active / F.lit(10.0))


def windows(rows: DataFrame) -> DataFrame:
    """Units, days out of stock and sale days of days 15-30 and 31-60, as differences of those of 14, 30 and 60 days."""
    less = lambda name, a, b: F.greatest(F.lit(0), F.coalesce(f"{name}_{a}", F.lit(0)) - F.coalesce(f"{name}_{b}", F.lit(0)))
    out = {}
    for label, a, b, days in (("15_30", 30, 14, 16), ("31_60", 60, 30, 30)):
        out[f"units_{label}"] = less("units", a, b)
        out[f"days_out_of_stock_{label}"] = F.least(F.lit(days), less("days_out_of_stock", a, b))
        out[f"sale_days_{label}"] = F.least(F.lit(days), less("sale_days", a, b))
    return rows.withColumns(out)


def with_velocity(rows: DataFrame, settings: Settings = Settings(), trend: Column | None = None, season: Column | None = None) -> DataFrame:
    """Adds active days and daily sales of the three windows, and base_velocity: their weighted sum, times trend, season and growth."""
    rows = windows(rows)
    spans = (("14", 14), ("15_30", 16), ("31_60", 30))
    rows = rows.withColumns({f"active_days_{k}": active_days(n, F.coalesce(f"days_out_of_stock_{k}", F.lit(0)), F.coalesce(f"sale_days_{k}", F.lit(0))) for k, n in spans})
    rows = rows.withColumns({f"velocity_{k}": daily_sales(F.coalesce(f"units_{k}", F.lit(0.0)), n, F.col(f"active_days_{k}"), settings.mode) for k, n in spans})
    base = sum((F.col(f"velocity_{k}") * w for (k, _), w in zip(spans, settings.shares, strict=True)), F.lit(0.0))
    return rows.withColumn("base_velocity", enriched(base, trend, season) * settings.growth)


def enriched(base: Column, trend: Column | None = None, season: Column | None = None, croston: Column | None = None, blend: float = 0.0) -> Column:
    """base, mixed with an estimate for slow movers, times trend and season; what is below 0 counts as 0."""
    if not 0 <= blend <= 1:
        raise ValueError("blend is from 0 to 1")
    out = positive(base)
    if croston is not None and blend:
        out = F.when(croston.isNull(), out).otherwise((1 - blend) * out + blend * positive(croston))
    for factor in (trend, season):
        if factor is not None:
            out = out * F.when(factor.isNull(), 1.0).otherwise(positive(factor))
    return out


def order_quantity(desired: Column, on_hand: Column, on_order: Column) -> Column:
    return F.greatest(F.lit(0), (desired - (positive(on_hand) + on_order)).cast("long"))


def stock_status(on_hand: Column, on_order: Column, reorder_point: Column, desired: Column) -> Column:
    """One of STATUSES, by where the units at hand and on order stand between the reorder point and the desired level."""
    position, has_target, has_point = positive(on_hand) + on_order, desired > 0, reorder_point > 0
    return ordered_case(
        [
            ((reorder_point <= 0) & (desired <= 0), "no_demand"),
            (has_target & (position >= desired * 1.5), "overstock"),
            (has_target & (position >= desired * 1.2), "high"),
            (has_target & (position >= desired * 0.8) & has_point & (positive(on_hand) <= reorder_point), "incoming"),
            (has_target & (position >= desired * 0.8), "on_target"),
            (has_point & (position > reorder_point * 1.15), "healthy"),
            (has_point & (position > reorder_point), "warning"),
            (has_point & (position > reorder_point * 0.5), "low"),
        ],
        "critical",
    )


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status).cast("long")


def status_urgency(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in URGENCY.items() for x in pair)), status).cast("long")


def status_reason(status: Column, on_hand: Column, on_order: Column, reorder_point: Column, desired: Column) -> Column:
    """Why a row has its status, in words."""
    position = short_number(positive(on_hand) + on_order)
    against = lambda words, level: F.concat(F.lit(f"{words}: "), position, F.lit(" for "), short_number(level))
    words = {"no_demand": F.lit("Neither level is set"), "incoming": F.concat(F.lit("Orders reach the target, on hand is at the reorder point or below: "), short_number(positive(on_hand)), F.lit(" for "), short_number(reorder_point))}
    words |= {k: against(v, desired) for k, v in (("overstock", "From 150% of the target on"), ("high", "From 120% of the target on"), ("on_target", "Near the target"))}
    words |= {k: against(v, reorder_point) for k, v in (("healthy", "Over 115% of the reorder point"), ("warning", "Just over the reorder point"), ("low", "Over half of the reorder point"), ("critical", "Up to half of the reorder point"))}
    reason = F.coalesce(*(F.when(status == k, v) for k, v in words.items()))
    return F.when(on_hand < 0, F.concat(F.lit("On hand is negative ("), short_number(on_hand), F.lit(") and counts as 0. "), reason)).otherwise(reason)


def momentum(units_60: Column, units_14: Column, active: tuple[Column, Column, Column], velocity: tuple[Column, Column, Column]) -> Column:
    """How demand moves: from daily sales of the last 14 days, days 15-30 and days 31-60."""
    (act_a, act_b, act_c), (a, b, c) = active, velocity
    above = lambda new, old, by: F.when(old <= 0, new > 0).otherwise(new >= old * (1 + by))
    below = lambda new, old, by: F.when(old <= 0, False).otherwise(new <= old * (1 - by))
    return ordered_case(
        [
            ((units_60 <= 0) | (act_a < 3) | (act_b < 3) | (act_c < 7), "insufficient_data"),
            ((units_14 < 3) & (a > 0) & above(a, b, 1.0) & above(a, c, 1.0), "spiky"),
            (above(a, c, 0.75) & above(a, b, 0.35), "surging"),
            ((above(a, b, 0.40) & (b >= c)) | (above(a, c, 0.25) & above(b, c, 0.25)), "rising"),
            ((below(a, b, 0.40) & (b <= c)) | (below(a, c, 0.25) & below(b, c, 0.25)), "cooling"),
        ],
        "flat",
    )


def with_momentum(rows: DataFrame) -> DataFrame:
    keys = ("14", "15_30", "31_60")
    active, velocity = (tuple(F.col(f"{x}_{k}") for k in keys) for x in ("active_days", "velocity"))
    return rows.withColumn("momentum", momentum(F.coalesce("units_60", F.lit(0.0)), F.coalesce("units_14", F.lit(0.0)), active, velocity))


def with_status(rows: DataFrame) -> DataFrame:
    """Adds what follows from on_hand, on_order, reorder_point and desired_level; used again after overrides."""
    levels = tuple(F.col(c) for c in ("on_hand", "on_order", "reorder_point", "desired_level"))
    rows = rows.withColumn("status", stock_status(*levels))
    changed = (F.coalesce("current_reorder_point", F.lit(0)) != F.col("reorder_point")) | (F.coalesce("current_desired_level", F.lit(0)) != F.col("desired_level"))
    return rows.withColumns(
        {
            "status_rank": status_rank(F.col("status")),
            "urgency": status_urgency(F.col("status")),
            "status_reason": status_reason(F.col("status"), *levels),
            "qty_to_order": order_quantity(levels[3], levels[0], levels[1]),
            "change_needed": changed,
        }
    )


def location_name(shop: Column) -> Column:
    names = F.create_map(*(F.lit(x) for k, v in LOCATIONS.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(names, shop.cast("int")), F.concat(F.lit("Shop "), shop.cast("string")))


def velocities(metrics: DataFrame, settings: Settings = Settings(), trend: Column | None = None, season: Column | None = None) -> DataFrame:
    """metrics (item_id, shop_id, units_N, days_out_of_stock_N, sale_days_N, on_hand, on_order, current levels, lead_time_days) with daily sales and
    momentum. Rows without an item id go.
    """
    rows = metrics.where(F.coalesce("item_id", F.lit(0)) != 0)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("on_hand", "on_order")})
    return with_momentum(with_velocity(rows, settings, trend, season))


def planned(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Recommendations from rows of velocities: levels, status and what follows. What these rows are computed from is best a table by then:
    each step names several columns of the one before it, so that one plan of all steps is longer than what Java compiles.
    """
    v = F.col("base_velocity")
    rows = rows.withColumn("safety_stock", ceil_units(v * settings.safety_days))
    rows = rows.withColumns({"reorder_point": ceil_units(v * F.col("lead_time_days") + F.col("safety_stock")), "desired_level": ceil_units(v * (settings.forecast_days or 60.0))})
    rows = rows.withColumns({"location": location_name(F.col("shop_id")), "days_of_stock": half_even(divided(positive(F.col("on_hand")), v), 1)})
    rows = rows.withColumns({f"adjusted_{k}": half_even(F.col(f"velocity_{k}") * n, 1) for k, n in (("14", 14), ("15_30", 16), ("31_60", 30))} | {"adjusted_30": half_even(v * 30, 1), "adjusted_60": half_even(v * 60, 1)})
    return with_status(rows)


def recommend(metrics: DataFrame, settings: Settings = Settings(), trend: Column | None = None, season: Column | None = None) -> DataFrame:
    """A recommendation for each row of metrics, in one plan."""
    return planned(velocities(metrics, settings, trend, season), settings)


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Puts manual levels (sku, location_id) in the place of recommended ones, and works out again what follows. A null level overrides nothing."""
    manual = overrides.select(F.col("sku").alias("o_sku"), F.col("location_id").alias("o_shop"), "manual_reorder_point", "manual_desired_level", F.col("locked").alias("o_locked"))
    rows = rows.join(manual, (F.col("sku") == F.col("o_sku")) & (F.col("shop_id") == F.col("o_shop")), "left")
    rows = rows.withColumns({"reorder_point": F.coalesce("manual_reorder_point", "reorder_point"), "desired_level": F.coalesce("manual_desired_level", "desired_level"), "locked": F.coalesce("o_locked", F.lit(False))})
    return with_status(rows.drop("o_sku", "o_shop", "o_locked", "manual_reorder_point", "manual_desired_level"))


def trend_coefficient(recent: Column, middle: Column, older: Column, low: float = 0.5, high: float = 2.0, sensitivity: float = 1.0) -> Column:
    """How recent daily sales stand to earlier ones, from low to high; 1 if there is nothing to compare."""
    if low <= 0 or high <= 0 or low > high or sensitivity < 0:
        raise ValueError("bounds are above 0 and in order, sensitivity is 0 or above")
    if not sensitivity:
        return F.lit(1.0)
    now, before = positive(recent), 0.6 * positive(middle) + 0.4 * positive(older)
    ratio = clamp(1 + (divided(now, before, 1.0) - 1) * sensitivity, low, high)
    return F.when((before <= 0) & (now <= 0), 1.0).when(before <= 0, high).when(now <= 0, low).otherwise(ratio)
