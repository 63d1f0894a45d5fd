"""Rounding by the exact binary value, in Spark and in DuckDB, against Python's own."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stockflow.functions.columns import half_even, half_even_sql
from stockflow.plans.views import with_rounding

VALUES = [0.15, 0.25, 0.35, 2.5, 3.5, 2.675, 27.45, 27.450000000000003, 1.005, -0.15, -2.675, -2.5, 0.05, 1e-9, 0.0, 1234567.85, 8.5e14, 12345678901.25, 5.015]


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    made = [round(rng.uniform(-500, 500), 2) * k for k in (1, 7, 30, 0.5) for _ in range(300)]
    return VALUES + made + [rng.randrange(-4000, 4000) / 8 for _ in range(200)]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_is_pythons_rounding(spark, values, digits):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.x for r in rows.select("i", half_even(F.col("v"), digits).alias("x")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(range(0, ?)) AS i, unnest(?::DOUBLE[]) AS v", [len(values), values])
    sql = dict(con.execute(f"SELECT i, {half_even_sql('v', digits)} FROM t").fetchall())
    for i, v in enumerate(values):
        assert got[i] == sql[i] == round(v, digits), v


def test_nulls_and_nesting(spark):
    row = spark.range(1).select(half_even(F.lit(None).cast("double"), 1).alias("a"), half_even(half_even(F.lit(2.675), 2) * 10, 0).alias("b"), half_even(F.lit(float("nan")), 1).alias("c")).first()
    assert row.a is None and row.b == 27.0 and row.c != row.c
    assert "half_even" not in with_rounding("SELECT half_even(half_even(a + (b), 1) * 3, 2)")
