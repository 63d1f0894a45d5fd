"""What a table on a screen asks for: search, filters, sorted pages, counts beside each filter, and lists of choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def searched(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that hold text in one of columns, whatever its case; columns that are arrays are searched through. Blank text finds all."""
    if not (needle := text.strip().lower()):
        return rows
    kinds = dict(rows.dtypes)
    value = lambda c: F.lower(F.array_join(c, " ")) if kinds[c].startswith("array") else F.lower(F.col(c).cast("string"))
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(value(c).contains(needle), F.lit(False)) for c in columns)))


def chosen(rows: DataFrame, choices: dict[str, object]) -> DataFrame:
    """Rows with the chosen value, or one of several, in each column; a choice of None chooses nothing."""
    for column, value in choices.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.where(F.col(column).isin(*value)) if value else rows
        elif value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def ticked(rows: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """Rows in which every flag that is ticked holds; one that isn't ticked chooses nothing, and an unknown one in a row doesn't hold."""
    return rows.where(reduce(lambda a, b: a & b, (F.coalesce(F.col(c), F.lit(False)) for c, on in flags.items() if on), F.lit(True)))


def in_category(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a category, whichever level the name is of."""
    return rows.where((F.col("category_top_level") == name) | (F.col("category_path") == name) | (F.col("category_level_2") == name))


def order_by(rows: DataFrame, column: str, descending: bool = False) -> Column:
    """Text without regard to case; nulls last upwards, first downwards."""
    x = F.lower(column) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return x.desc_nulls_first() if descending else x.asc_nulls_last()


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """Page `number`, from 1, of rows in an order, which should leave no ties."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after(keys: list[tuple[Column, bool]], last: list[object]) -> Column:
    """True of rows that come after one with the keys `last`, in the order of keys, (column, descending); false or null of others. Nulls come last upwards and first downwards.

    It compares keys from the first on: later in one, and equal in those before it. Equality and comparison with a value are what a Parquet scan can skip by.
    """
    either, equal = F.lit(False), F.lit(True)
    for (x, descending), value in zip(keys, last, strict=True):
        if descending:
            later = x.isNotNull() if value is None else x < F.lit(value)
        else:
            later = F.lit(False) if value is None else x.isNull() | (x > F.lit(value))
        either = either | equal & later
        equal = equal & (x.isNull() if value is None else x == F.lit(value))
    return either


def seek_page(rows: DataFrame, keys: list[tuple[str, bool]], last: list[object] | None = None, size: int = 50) -> DataFrame:
    """The page that follows a row with the keys `last`, or the first: whatever comes before it is neither sorted nor skipped over, however far in the list the page is.

    keys: (column, descending), which together tell rows apart. Text stands by its bytes.
    """
    order = [F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last() for c, descending in keys]
    rows = rows if last is None else rows.where(after([(F.col(c), d) for c, d in keys], last))
    return rows.orderBy(*order).limit(size)


def active_filter(tiles: dict[str, dict[str, Column]], active: dict[str, list[str]]) -> Column:
    """Any of the active tiles of a group, in all groups."""
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (tiles[g][t] for t in names)) for g, names in active.items() if names), F.lit(True))


def facet_counts(rows: DataFrame, tiles: dict[str, dict[str, Column]], active: dict[str, list[str]]) -> DataFrame:
    """(tile_group, tile, n): rows of each tile that pass the active tiles of all other groups. One read of rows counts all."""
    counts = []
    for group, own in tiles.items():
        others = active_filter(tiles, {g: t for g, t in active.items() if g != group})
        counts += [(group, tile, F.count_if(F.coalesce(others & condition, F.lit(False)))) for tile, condition in own.items()]
    one = rows.agg(*(c.alias(f"c{i}") for i, (_, _, c) in enumerate(counts)))
    entries = F.array(*(F.struct(F.lit(g).alias("tile_group"), F.lit(t).alias("tile"), F.col(f"c{i}").alias("n")) for i, (g, t, _) in enumerate(counts)))
    return one.select(F.explode(entries).alias("e")).select("e.*")


def choices(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value): distinct values of each column, for lists to choose from."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).select("p.*").where(F.trim("value") != "").distinct()


def key_figures(rows: DataFrame) -> DataFrame:
    """One row of counts over recommendations."""
    status = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(
        F.count("*").alias("items"),
        F.count_if(F.col("qty_to_order") > 0).alias("needs_order"),
        status("critical").alias("critical"),
        status("low").alias("low"),
        status("overstock").alias("overstock"),
        F.count_if(F.col("change_needed")).alias("changes"),
        F.coalesce(F.sum("qty_to_order"), F.lit(0)).alias("units_to_order"),
    )
