"""Items ordered for customers: where each stands, what is late, and which web order it belongs to."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import ordered_case
from .grid import searched

# Stages of procurement, flags by how grave they are, words that mean an order is in.
STAGES = ("open_pool", "unordered_po", "ordered", "received")
FLAG_RANK = {"none": 0, "no_eta": 1, "overdue": 2, "ready_not_called": 2, "overdue_mid": 3, "critical": 4}
RECEIVED_WORDS = ("received", "ready", "arrived", "pickup", "checked in", "in stock")
# What a flag is called within its stage, and its tone.
TRIAGE = {
    "open_pool": {"critical": ("Open Order 12d+", "danger"), "overdue_mid": ("Open Order 7-11d", "danger"), "overdue": ("Open Order 5-6d", "danger"), "healthy": ("Healthy (0-4d)", "ok")},
    "unordered_po": {"critical": ("Unordered 12d+", "danger"), "overdue_mid": ("Unordered 7-11d", "danger"), "overdue": ("Unordered 5-6d", "danger"), "healthy": ("Healthy (0-4d)", "ok")},
    "ordered": {"critical": ("PO Critically Overdue (8d+)", "danger"), "overdue_mid": ("PO Overdue (3-7d)", "danger"), "overdue": ("PO Overdue (1-2d)", "danger"), "no_eta": ("No ETA", "warn"), "healthy": ("Healthy", "ok")},
    "received": {"ready_not_called": ("Ready, Not Called", "warn"), "healthy": ("Healthy", "ok")},
}
#: Web orders that are over.
SHIPPED, PAID_BACK = "FULFILLED", ("REFUNDED", "PARTIALLY_REFUNDED", "VOIDED")


def says_received(status: Column) -> Column:
    return F.coalesce(F.lower(F.trim(status)).rlike("|".join(RECEIVED_WORDS)), F.lit(False))


def status_class(status: Column) -> Column:
    """What a status text means, by the first words that it holds."""
    text = F.lower(F.coalesce(status, F.lit("")))
    return ordered_case([(text.contains("not ordered"), "not_ordered"), (text.contains("ready"), "ready"), (text.contains("received"), "received"), (text.contains("ordered"), "ordered")], "other")


def with_stage(rows: DataFrame) -> DataFrame:
    """Adds stage: received, else ordered with a vendor, else on an order that wasn't placed, else in no order."""
    stage = ordered_case([(says_received(F.col("status_text")), "received"), (F.col("po_id").isNotNull() & F.col("po_ordered_date").isNotNull(), "ordered"), (F.col("po_id").isNotNull(), "unordered_po")], "open_pool")
    return rows.withColumn("stage", stage)


def with_flag(rows: DataFrame, today: date) -> DataFrame:
    """Adds age_days, expected_date, days_overdue and flag.

    The web order's promised date goes before that of the purchase order. Ordered items are late by the days after that date; items that
    nobody ordered, by the days that they have waited beyond 4.
    """
    age = F.datediff(F.lit(today), "created_date")
    eta = F.col("eta") if "eta" in rows.columns else F.lit(None).cast("date")
    expected = F.coalesce(eta, F.when(F.col("stage") == "ordered", F.col("po_arrival_date")))
    rows = rows.withColumns({"age_days": age, "expected_date": expected}).withColumn("late", F.datediff(F.lit(today), "expected_date"))
    ordered = F.when(F.col("late").isNull(), "no_eta").when(F.col("late") > 7, "critical").when(F.col("late") >= 3, "overdue_mid").when(F.col("late") >= 1, "overdue").otherwise("none")
    waits = F.col("age_days") - 4
    waiting = F.when(F.col("age_days").isNull() | (F.col("age_days") < 5), "none").when(waits > 7, "critical").when(waits >= 3, "overdue_mid").otherwise("overdue")
    flag = F.when(F.col("stage") == "received", F.when(F.col("contacted"), "none").otherwise("ready_not_called")).when(F.col("stage") == "ordered", ordered).otherwise(waiting)
    days = F.when(F.col("stage") == "ordered", F.col("late")).when(F.col("stage") == "received", None).otherwise(F.when(flag != "none", F.col("age_days")))
    return rows.withColumns({"flag": flag, "days_overdue": days}).drop("late")


def flag_rank(flag: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in FLAG_RANK.items() for x in pair)), flag)


def triage_names(spark: SparkSession) -> DataFrame:
    """(stage, sub_key, label, tone): a row for each of TRIAGE."""
    return spark.createDataFrame([(stage, key, *words) for stage, own in TRIAGE.items() for key, words in own.items()], "stage string, sub_key string, label string, tone string")


def sub_key(flag: Column) -> Column:
    return F.when(flag == "none", "healthy").otherwise(flag)


def with_triage(rows: DataFrame) -> DataFrame:
    """rows (stage, flag) with sub_key, label and tone; a flag that its stage doesn't have is called healthy."""
    names = triage_names(rows.sparkSession).select(F.col("stage").alias("t_stage"), F.col("sub_key").alias("t_key"), "label", "tone")
    rows = rows.withColumn("sub_key", sub_key(F.col("flag")))
    rows = rows.join(names, (F.col("stage") == F.col("t_stage")) & (F.col("sub_key") == F.col("t_key")), "left")
    return rows.withColumns({"label": F.coalesce("label", F.lit("Healthy")), "tone": F.coalesce("tone", F.lit("ok"))}).drop("t_stage", "t_key")


def triage_counts(rows: DataFrame) -> DataFrame:
    """(stage, sub_key, label, n) of each of TRIAGE, also those without rows."""
    counts = rows.groupBy("stage", sub_key(F.col("flag")).alias("sub_key")).agg(F.count("*").alias("n"))
    return triage_names(rows.sparkSession).drop("tone").join(counts, ["stage", "sub_key"], "left").fillna(0, ["n"])


def with_vendors(rows: DataFrame, best: DataFrame) -> DataFrame:
    """rows (brand, shop_id) with available_vendors: those of best (brand_name, shop_id, place, ...), which has a few for each brand and shop, in their order."""
    entry = F.struct("place", "vendor_id", "vendor_name", "lead_time_days", "lead_time_source", "distinct_items")
    lists = best.groupBy(F.col("brand_name").alias("b_brand"), F.col("shop_id").alias("b_shop")).agg(F.sort_array(F.collect_list(entry)).alias("available_vendors"))
    empty = F.array().cast(lists.schema["available_vendors"].dataType)
    rows = rows.join(lists, (F.col("brand") == F.col("b_brand")) & (F.col("shop_id") == F.col("b_shop")), "left")
    return rows.withColumn("available_vendors", F.coalesce("available_vendors", empty)).drop("b_brand", "b_shop")


#: The columns that a search looks through, and the longest that a live order has waited.
SEARCHED, LIVE_DAYS = ["customer_name", "customer_email", "description", "system_sku", "brand", "vendor_name", "po_id", "special_order_id", "web_order_name", "vendor_names"], 365


def found(rows: DataFrame, text: str = "", flagged_only: bool = False, shop: int | None = None, live_only: bool = True) -> DataFrame:
    """Enriched rows that hold text in one of SEARCHED, and pass what else is asked for; an order of unknown age is live."""
    if flagged_only:
        rows = rows.where("flag <> 'none'")
    if shop is not None:
        rows = rows.where(F.col("shop_id") == shop)
    if live_only:
        rows = rows.where(F.col("age_days").isNull() | (F.col("age_days") <= LIVE_DAYS))
    return searched(rows, text, SEARCHED)


def tagged(orders: DataFrame, tags: DataFrame, fields: DataFrame, lines: DataFrame, tag: str = "so", owner: str = "ORDER") -> DataFrame:
    """Lines of orders that have a tag, whatever its case, with the text of their field if the owner has one. An order with two tags that match comes twice."""
    tags = tags.where(F.lower("tag") == tag).select("order_id")
    fields = fields.where(F.upper("owner") == owner).select("order_id", "field")
    return orders.join(tags, "order_id").join(fields, "order_id", "left").join(lines, "order_id")


def by_gravity(rows: DataFrame) -> list[Column]:
    """The order of a work list: gravest first, then latest, then oldest."""
    return [F.desc(flag_rank(F.col("flag"))), F.desc(F.coalesce("days_overdue", F.lit(0))), F.desc(F.coalesce("age_days", F.lit(0))), F.asc("special_order_id")]


def summary(rows: DataFrame) -> DataFrame:
    """(stage, total, flagged, and a count for each flag): all stages, also those without rows."""
    counts = rows.groupBy("stage").agg(F.count("*").alias("total"), F.count_if(F.col("flag") != "none").alias("flagged"), *(F.count_if(F.col("flag") == f).alias(f) for f in FLAG_RANK))
    stages = rows.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    return stages.join(counts, "stage", "left").fillna(0)


def open_web_orders(orders: DataFrame) -> DataFrame:
    """Rows of web orders that still wait for goods. An unknown status isn't open."""
    return orders.where((F.col("fulfillment_status") != SHIPPED) & ~F.col("financial_status").isin(*PAID_BACK) & ~F.coalesce("voided", F.lit(False)))


def _key(c: str) -> Column:
    return F.lower(F.trim(c))


def keyed_orders(orders: DataFrame) -> DataFrame:
    """(k_email, k_sku, order_id, order_name, eta) of open web orders, distinct; name and eta are the order's own, whatever its lines say. What all matching starts from."""
    own = Window.partitionBy("order_id")
    rows = orders.withColumns({"k_email": _key("email"), "k_sku": F.trim("sku")}).where("k_sku <> ''")
    return rows.select("k_email", "k_sku", "order_id", F.min("order_name").over(own).alias("order_name"), F.min("eta").over(own).alias("eta")).distinct()


def keyed_rows(rows: DataFrame) -> DataFrame:
    """rows (customer_email, system_sku) with k_email and k_sku, by which they meet orders."""
    return rows.withColumns({"k_email": _key("customer_email"), "k_sku": F.trim("system_sku")})


def _keyed(orders: DataFrame) -> DataFrame:
    return orders if "k_sku" in orders.columns else keyed_orders(orders)


def _candidates(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct orders of each key: their number, and the least of them with its name and promised date."""
    facts = F.struct("order_id", "order_name", "eta")
    return orders.select(*keys, "order_id", "order_name", "eta").distinct().groupBy(*keys).agg(F.count("*").alias("n"), F.min(facts).alias("first"))


def with_keys(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """rows (customer_email, system_sku; or those of keyed_rows, with any columns) with web_match, web_order_id, web_order_name, eta, n_candidates, k_email and k_sku. orders: open ones, or those of keyed_orders.

    Orders of the same email and sku are candidates; without an email, or if there are none, those of the sku. One candidate is a
    match, several are ambiguous. Each key is one row of a count and a least order before it is joined, so no row is paired with single
    orders, and no list of orders is made. k_email and k_sku are the key that a row's candidates have: k_email is null where those of
    the sku are meant, k_sku where there are none.
    """
    orders = _keyed(orders)
    both = _candidates(orders.where("k_email <> ''"), ["k_email", "k_sku"]).select("k_email", "k_sku", F.col("n").alias("n2"), F.col("first").alias("first2"))
    alone = _candidates(orders, ["k_sku"]).select("k_sku", F.col("n").alias("n1"), F.col("first").alias("first1"))
    rows = (rows if "k_sku" in rows.columns else keyed_rows(rows)).withColumn("is_row", F.lit(True))
    # one sort, of rows without what windows add, serves both windows: Spark would sort by k_sku first, and again by both
    rows = rows.unionByName(both, allowMissingColumns=True).unionByName(alone, allowMissingColumns=True).repartition("k_sku").sortWithinPartitions("k_sku", "k_email")
    own, sku = Window.partitionBy("k_sku", "k_email"), Window.partitionBy("k_sku")
    known = F.col("k_sku").isNotNull()
    rows = rows.withColumns({c: F.when(known & F.col("k_email").isNotNull(), F.max(c).over(own)) for c in ("n2", "first2")})
    rows = rows.withColumns({c: F.when(known, F.max(c).over(sku)) for c in ("n1", "first1")}).where("is_row")
    rows = rows.withColumns({"n_candidates": F.coalesce("n2", "n1", F.lit(0)), "only": F.coalesce("first2", "first1")})
    n, match = F.col("n_candidates"), lambda c: F.when(F.col("n_candidates") == 1, F.col("only")[c])
    rows = rows.withColumns({"web_match": F.when(n == 0, "none").when(n == 1, "matched").otherwise("ambiguous"), "web_order_id": match("order_id"), "web_order_name": match("order_name"), "eta": match("eta")})
    rows = rows.withColumns({"k_email": F.when(F.col("n2").isNotNull(), F.col("k_email")), "k_sku": F.when(n > 0, F.col("k_sku"))})
    return rows.drop("n1", "n2", "first1", "first2", "only", "is_row")


def with_match(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """with_keys' rows with the list of their candidates in place of the keys: for a look at a few rows, as a list holds all orders of its key."""
    rows, orders = with_keys(rows, orders), _keyed(orders)
    wanted = rows.select("k_email", "k_sku").where("k_sku is not null").distinct()
    lists = of_keys(orders.select("k_email", "k_sku", "order_id"), wanted).groupBy("k_email", "k_sku").agg(F.sort_array(F.collect_set("order_id")).alias("candidates"))
    lists = lists.select(F.col("k_email").alias("l_email"), F.col("k_sku").alias("l_sku"), "candidates")
    rows = rows.join(lists, F.col("k_email").eqNullSafe(F.col("l_email")) & (F.col("k_sku") == F.col("l_sku")), "left")
    return rows.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<bigint>"))).drop("n_candidates", "k_email", "k_sku", "l_email", "l_sku")


def of_keys(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """(k_email, k_sku, order_id and what else keys has): the orders of each distinct key; an order has two keys at most, its own and that of its sku, without an email."""
    more = [F.col(f"asked.{c}") for c in keys.columns if c not in ("k_email", "k_sku")]
    own = F.explode(F.array_distinct(F.array("k_email", F.lit(None).cast("string")))).alias("k_email")
    given = keyed.select(own, "k_sku", "order_id").alias("given")
    same = F.col("given.k_email").eqNullSafe(F.col("asked.k_email")) & (F.col("given.k_sku") == F.col("asked.k_sku"))
    return given.join(keys.alias("asked"), same).select("given.k_email", "given.k_sku", "given.order_id", *more)


def consumed(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """order_id of the orders that are candidates of rows (of with_keys)."""
    return of_keys(_keyed(orders), rows.select("k_email", "k_sku").where("k_sku is not null").distinct()).select("order_id").distinct()


def adopted(done: DataFrame, orders: DataFrame | None, consumed: DataFrame) -> DataFrame:
    """Of finished rows (special_order_id, and the keys of with_keys, or else candidates) those that hold an order which neither
    `consumed` (order_id) nor a row that was adopted before it has; by special_order_id.

    A row is adopted if one of its candidates is still free when its turn comes. A free order goes to the first row that holds it:
    every row that is first for one of its free orders is adopted, and a row that is first for none finds all of them taken. Rows of
    a key hold the same orders, so only the first row of each key meets them.
    """
    if "k_sku" in done.columns:
        first_of_key = done.where("k_sku is not null").groupBy("k_email", "k_sku").agg(F.min("special_order_id").alias("special_order_id"))
        pairs = of_keys(_keyed(orders), first_of_key).select("special_order_id", "order_id")
    else:
        pairs = done.select("special_order_id", F.explode("candidates").alias("order_id"))
    free = pairs.join(consumed.select("order_id").distinct(), "order_id", "left_anti")
    first = free.groupBy("order_id").agg(F.min("special_order_id").alias("special_order_id")).select("special_order_id").distinct()
    return done.join(first, "special_order_id", "left_semi")


def unmatched(orders: DataFrame, consumed: DataFrame) -> DataFrame:
    """A row for each web order that nothing refers to, with its skus."""
    left = orders.join(consumed.select("order_id").distinct(), "order_id", "left_anti")
    return left.groupBy("order_id").agg(F.min("order_name").alias("order_name"), F.min("email").alias("email"), F.min("eta").alias("eta"), F.min("created_at").alias("created_at"), F.sort_array(F.collect_set("sku")).alias("skus"))


def by_promise() -> list[Column]:
    return [F.asc_nulls_last("eta"), F.asc("order_name"), F.asc("order_id")]


def as_special_orders(web: DataFrame) -> DataFrame:
    """Unmatched web orders in the shape of special orders, to stand in one list with them."""
    return web.select((-F.col("order_id")).alias("special_order_id"), F.col("email").alias("customer_email"), F.get("skus", F.lit(0)).alias("system_sku"), F.to_date("created_at").alias("created_date"), "eta", F.lit("unmatched").alias("web_match"), F.col("order_id").alias("web_order_id"))


def tiles(rows: DataFrame, today: date) -> dict[str, dict[str, Column]]:
    """Conditions by which a work list is filtered: groups of tiles, and the condition of each tile."""
    return {
        "stage": {s: F.col("stage") == s for s in STAGES},
        "web": {"matched_unreceived": (F.col("web_match") == "matched") & (F.col("stage") != "received"), "matched_received": (F.col("web_match") == "matched") & (F.col("stage") == "received"), "not_matched": F.col("web_match") == "none"},
        "action": {"order_today": F.col("stage").isin("open_pool", "unordered_po") & (F.col("flag") != "none"), "follow_up": (F.col("stage") == "ordered") & F.col("flag").isin("no_eta", "overdue", "overdue_mid", "critical")},
    }


#: Flags of orders that are late.
LATE = ("overdue", "overdue_mid", "critical")


def created_day(line_time: Column, changed: Column) -> Column:
    """The day on which an order began: that of its line of a sale, or else of the record's last change, where it has no line or the line no time."""
    return F.to_date(F.coalesce(line_time, changed))


def link(template: str, key: Column) -> Column:
    """template with a key in place of {}; null without a key."""
    before, after = template.split("{}")
    return F.when(key.isNotNull(), F.concat(F.lit(before), key.cast("string"), F.lit(after)))


def recorded(rows: DataFrame, shops: dict[int, str], links: dict[str, tuple[str, str]]) -> DataFrame:
    """rows (of with_flag, with po_complete, num_received, upc and item_text, line_text) with what a page shows beside them.

    store, status (Unknown, if none is given), stage_index, is_overdue, po_ordered, po_complete, received_started, upc (null if blank), description (the item's, or else the
    line's), and a link for each of links: its name, a template and the column of its key.
    """
    names = F.create_map(*(F.lit(x) for pair in shops.items() for x in pair))
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    stage = ordered_case([(F.col("stage") == s, i) for i, s in enumerate(STAGES)], None)
    has_po = F.col("po_id").isNotNull()
    return rows.withColumns(
        {
            "store": F.try_element_at(names, F.col("shop_id").cast("int")),
            "status": F.coalesce("status_text", F.lit("Unknown")),
            "stage_index": stage,
            "is_overdue": F.col("flag").isin(*LATE),
            "po_ordered": has_po & F.col("po_ordered_date").isNotNull(),
            "po_complete": has_po & F.coalesce("po_complete", F.lit(False)),
            "received_started": has_po & F.coalesce(F.col("num_received") > 0, F.lit(False)),
            "upc": filled("upc"),
            "description": F.coalesce(filled("item_text"), "line_text"),
            **{name: link(template, F.col(c)) for name, (template, c) in links.items()},
        }
    )
