"""Where items drop out on their way into the recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .stock import current_levels


def report(items: DataFrame, log: DataFrame, shops: tuple[int, ...], examples: list[tuple[int, str]]) -> DataFrame:
    """One row: qualified_items, latest_items, target_rows, by_shop (array of shop_id, n) and examples (array of item_id, expected, qualified, known, shops).

    An item qualifies by being in the stock log; known are those of items that do; target rows are their newest levels in shops. Every fact is
    counted for itself, and the few rows that come of it meet in one aggregate: nothing is joined without a key. `examples` are a few given items, which come
    back in their order by id, with what was expected of them.
    """
    qualified = log.select("item_id").where("item_id is not null").distinct()
    known = items.select("item_id").distinct().join(qualified, "item_id", "left_semi")
    pairs = current_levels(log.where(F.col("shop_id").isin(*shops))).select("item_id", "shop_id").join(known, "item_id", "left_semi")
    given = items.sparkSession.createDataFrame(examples, "item_id long, expected string")
    wanted = [i for i, _ in examples]
    of_wanted = lambda rows: rows.where(F.col("item_id").isin(wanted))
    status = given.join(of_wanted(qualified).withColumn("is_qualified", F.lit(True)), "item_id", "left").join(of_wanted(known).withColumn("is_known", F.lit(True)), "item_id", "left")
    status = status.join(of_wanted(pairs).groupBy("item_id").agg(F.sort_array(F.collect_set("shop_id")).alias("held")), "item_id", "left")
    seen = lambda c: F.coalesce(c, F.lit(False)).alias(c.removeprefix("is_"))
    example = F.struct("item_id", "expected", seen("is_qualified"), seen("is_known"), F.coalesce("held", F.array().cast("array<bigint>")).alias("shops")).alias("example")
    number = lambda kind, rows: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    facts = [
        number("qualified", qualified),
        number("known", known),
        pairs.groupBy("shop_id").agg(F.count("*").alias("n")).select(F.lit("shop").alias("kind"), "n", F.struct("shop_id", "n").alias("shop")),
        status.select(F.lit("example").alias("kind"), example),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long"))
    return together.agg(
        of("qualified").alias("qualified_items"), of("known").alias("latest_items"), of("shop").alias("target_rows"),
        F.sort_array(F.collect_list("shop")).alias("by_shop"), F.sort_array(F.collect_list("example")).alias("examples"),
    )
