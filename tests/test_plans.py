"""Shape of the physical plans: no pairs of everything, pushed filters, pruned columns."""

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
LAZY = [n for n in QUERIES if n[0] in "bcdfghijkn" and n not in ("b17_sites_of_region",)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_pushdown_and_pruning(spark, sf):
    from wattloom.plans import bindings

    df = bindings.table(spark, sf, "orders").filter("o_orderkey < 100").select("o_orderkey")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,100)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


def test_transformations_share_one_shuffle(spark, sf):
    from pyspark.sql import functions as F

    from wattloom.operators.transform import all_transformations

    rows = spark.range(1000).select(
        F.lit("a").alias("site"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("value")
    )
    text = plan(all_transformations(rows, ["site"], "ts", "value", 24))
    assert text.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


REQUESTS = [("", None), ("lag", 24), ("lag", -5), ("lag", 400), ("difference", 3), ("difference", -2), ("minimum", 6), ("maximum", 1)]


def test_requests_of_a_source_share_one_shuffle_and_agree(spark):
    from pyspark.sql import functions as F

    from wattloom.operators import transform

    rows = spark.range(3000).filter("id % 7 <> 3").select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("location"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
        F.when(F.col("id") % 11 != 4, (F.col("id") * 37 % 101).cast("double")).alias("value"))
    got = transform.unfold({"x": rows}, [("x", t, p) for t, p in REQUESTS])
    assert plan(got).split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert "Union" not in plan(got)
    for name, parameter in REQUESTS:
        one = transform.transform_input(rows, ["location"], "ts", "value", name, parameter).select("location", "ts", "value")
        mine = got.filter((F.col("transformation") == name) & (F.col("parameter") == ("" if parameter is None else str(parameter))))
        mine = mine.select("location", "ts", "value")
        assert one.count() == mine.count() and one.exceptAll(mine).count() == 0
