"""Search for any part of a text by a table of trigrams: needles of three letters and more read the rows that may hold them, not all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .grid import searched

GRAM = 3


def folded(rows: DataFrame, column: str) -> Column:
    """A column's text as grid.searched compares it."""
    return F.lower(F.array_join(column, " ")) if dict(rows.dtypes)[column].startswith("array") else F.lower(F.col(column).cast("string"))


def grams(text: Column) -> Column:
    """Distinct runs of GRAM code points of a text; none in a shorter one or a null."""
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM)))))


def grams_of(needle: str) -> list[str]:
    return sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})


def place(key: Column, block: int) -> Column:
    """What stands for a key in a table: itself, or of keys that are numbers the number of its block, each of as many numbers as block says."""
    return key if block == 1 else F.floor(key / block)


def index(rows: DataFrame, key: str, columns: list[str], block: int = 1) -> DataFrame:
    """(gram, field, key): a row for each gram of each column of a row, sorted by gram, so that a scan for some grams skips the rest.

    Ranges go by gram and key, so that a gram which nearly all rows hold takes several parts. A key that recurs has the grams of all its rows. With a block above 1 key is the number of a block of
    keys (place), whose rows meet in one task and have each text, then each gram once: the table grows with the blocks, not with all letters of all rows.
    """
    if block > 1:
        return index_of_parts([(rows.select(place(F.col(key), block).alias("place"), *columns).repartition("place"), columns)], "place", columns)
    return dealt(texts(rows, key, columns, columns).select("key", "field", F.explode(grams(F.col("text"))).alias("gram")))


def texts(rows: DataFrame, key: str, own: list[str], columns: list[str]) -> DataFrame:
    """(key, field, text): a row for each of the columns `own` of a row, whose field is its number among columns."""
    each = F.explode(F.array(*(F.struct(F.lit(columns.index(c)).alias("field"), folded(rows, c).alias("text")) for c in own)))
    return rows.select(F.col(key).alias("key"), each.alias("of")).select("key", "of.field", "of.text")


def index_of_parts(parts: list[tuple[DataFrame, list[str]]], key: str, columns: list[str]) -> DataFrame:
    """index() by blocks, of rows whose columns come from several relations: each has the number of a block (place) as key, and its share of columns.

    Texts of other tables need not be carried with rows: what meets such a table is the block and its id. Each part has each text of a block once before it has grams.
    """
    each = [texts(rows, key, own, columns).distinct().select("key", "field", F.explode(grams(F.col("text"))).alias("gram")).distinct() for rows, own in parts]
    return dealt(reduce(DataFrame.unionByName, each))


def dealt(each: DataFrame) -> DataFrame:
    return each.select("gram", "field", "key").repartitionByRange("gram", "key").sortWithinPartitions("gram", "key")


def candidates(table: DataFrame, needle: str) -> DataFrame:
    """(key), distinct: those of which one column has all grams of the needle. They may stand apart in it."""
    wanted = grams_of(needle)
    found = table.where(F.col("gram").isin(wanted)).groupBy("key", "field").agg(F.count_distinct("gram").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("key").distinct()


def search(rows: DataFrame, table: DataFrame, text: str, key: str, columns: list[str], block: int = 1) -> DataFrame:
    """grid.searched's rows. table: index() of rows, or of more rows than these, by the same key, columns and block.

    A needle under GRAM letters has no gram, and all rows are read. Rows with a null key are found like others.
    """
    needle = text.strip().lower()
    if len(needle) >= GRAM:
        keys = candidates(table, needle).withColumnRenamed("key", "key_of_text")
        rows = rows.join(keys, place(rows[key], block).eqNullSafe(keys["key_of_text"]), "left_semi")
    return searched(rows, text, columns)
