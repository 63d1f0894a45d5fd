"""Scalar expressions that several operators share. All are native columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F


def ceil_units(x: Column) -> Column:
    """Whole units, up; a float that misses an integer by an error of its last digits doesn't cost a unit."""
    return F.ceil(x - 1e-9).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def positive(x: Column) -> Column:
    """x, or 0 where it is null or below."""
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))


def divided(a: Column, b: Column, otherwise: float | Column = 0.0) -> Column:
    """a / b where b is above 0."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(otherwise)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x written and worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def half_even(x: Column, digits: int) -> Column:
    """x at so many decimal digits, to the nearest by its exact binary value; even only where that lies in the middle: 0.15 is below it, and gives 0.1.

    x * 10**digits is a double p and an exact remainder e, from the halves of x's bits. p's fraction against 0.5 decides, and e where that is even. From
    2**52 on p has no fraction.
    """
    scale = float(10**digits)

    def product(v: Column) -> Column:
        high = v * 134217729.0
        return F.struct(v.alias("v"), (v * scale).alias("p"), (high - (high - v)).alias("high"))

    def rounded(x: Column) -> Column:
        v, p, high = x["v"], x["p"], x["high"]
        rest = (high * scale - p) + (v - high) * scale
        whole = F.floor(p)
        above = F.when((rest > 0) | (rest == 0) & (whole % 2 != 0), 1).otherwise(0)
        up = F.when(p - whole > 0.5, 1).when(p - whole == 0.5, above).otherwise(0)
        return F.when(F.abs(p) < 2.0**52, (whole + up) / F.lit(scale)).otherwise(v)

    return let(let(x.cast("double"), product), rounded)


def half_even_sql(x: str, digits: int) -> str:
    """The same for DuckDB."""
    scale = f"{10**digits}::DOUBLE"
    product = f"{{'v': v, 'p': v * {scale}, 'h': v * 134217729::DOUBLE - (v * 134217729::DOUBLE - v)}}"
    rest, frac = f"((r.h * {scale} - r.p) + (r.v - r.h) * {scale})", "(r.p - floor(r.p))"
    up = f"CASE WHEN {frac} > 0.5 THEN 1 WHEN {frac} = 0.5 AND ({rest} > 0 OR {rest} = 0 AND floor(r.p) % 2 <> 0) THEN 1 ELSE 0 END"
    return f"list_transform(list_transform([({x})::DOUBLE], lambda v: {product}), lambda r: CASE WHEN abs(r.p) < 4503599627370496 THEN (floor(r.p) + {up}) / {scale} ELSE r.v END)[1]"


def whole_days(start: Column, end: Column) -> Column:
    """Whole periods of 24 hours from start to end, cut towards 0: 26 hours are 1."""
    return F.timestamp_diff("DAY", start, end)


def month_after(month: Column, steps: Column) -> Column:
    """1 to 12, so many months on."""
    return F.pmod(month - 1 + steps, F.lit(12)) + 1


def is_blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def blank_to_null(x: Column) -> Column:
    return F.when(~is_blank(x), x)


def name_key(x: Column) -> Column:
    """How names are compared: trimmed, in lower case."""
    return F.lower(F.trim(x))


def id_text(x: Column) -> Column:
    """An id as text; blank and "0" stand for none."""
    text = F.trim(x.cast("string"))
    return F.when(~text.isin("", "0"), text)


def says_true(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))) == "true", F.lit(False))


def date_of_text(x: Column) -> Column:
    """The calendar date at the front of an ISO date or time, in its own offset; null if it has none."""
    return F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd")


def number_or(x: Column, otherwise: float) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(otherwise))


def last_number(x: Column) -> Column:
    """The digits after the last slash of a resource name, as in gid://shop/Order/123."""
    return F.nullif(F.regexp_extract(x, r"/(\d+)$", 1), F.lit(""))


def person_name(first: Column, last: Column, company: Column) -> Column:
    """First and last name, or else the company."""
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", blank_to_null(first), blank_to_null(last))), F.lit("")), blank_to_null(company))


def link(base: str, x: Column) -> Column:
    """base and the id, or null where there is none."""
    return F.concat(F.lit(base), id_text(x))


def short_number(x: Column) -> Column:
    """A number without a fraction of zeros."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("double").cast("string"))


def ordered_case(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    first = lambda so_far, case: F.when(case[0], F.lit(case[1])).otherwise(so_far)
    return reduce(first, reversed(cases), F.lit(otherwise))


def as_list(x: Column) -> Column:
    """A relation that comes as one struct or none, as an array."""
    return F.when(x.isNull(), F.array()).otherwise(F.array(x))
