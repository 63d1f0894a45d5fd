"""Every query against its SQL on the smallest tables."""

import pytest

from conftest import canonical
from stockflow import plans


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    got, want = canonical(plans.QUERIES[name](spark, sf).toPandas()), canonical(duck.execute(plans.ORACLES[name]).df())
    assert got == want


def test_scenarios_have_all_classes(spark, sf):
    from stockflow.operators import replenishment as rp

    rows = plans.QUERIES["scenario_recommendations"](spark, sf).collect()
    assert {r.status for r in rows} == set(rp.STATUSES)
    assert {r.momentum for r in rows} == {"insufficient_data", "spiky", "surging", "rising", "cooling", "flat"}
    assert any(r.status_reason.startswith("On hand is negative") for r in rows)
    with pytest.raises(ValueError, match="mode"):
        rp.Settings(mode="none")


@pytest.mark.parametrize("name", ["grid_filter", "adopted_orders", "order_search", "promised_first", "drafts_with_lines", "tagged_web_orders"])
def test_query_has_rows(spark, sf, name):
    assert not plans.QUERIES[name](spark, sf).isEmpty()


def test_orders_of_any_age_are_adopted(spark, sf):
    """Finished orders older than ninety days take web orders, too."""
    ages = plans.orders.matched(spark, sf).selectExpr("special_order_id", "datediff(date'2001-08-01', created_date) AS age")
    assert not plans.QUERIES["adopted_orders"](spark, sf).join(ages, "special_order_id").where("age > 90").isEmpty()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "status" in entry.entry(spark).columns
