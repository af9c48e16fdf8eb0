"""Digests of buckets: what differs is found, what is equal never meets."""

import random

from conftest import assert_same_bag, bag
from pyspark.sql import functions as F

from tideview.operators import bags, digests
from tideview.sources.changes import diff_snapshots

ROW = "k int, a int, b int, s string"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_any_change_of_a_row_is_seen(spark):
    base = (1, None, 2, "x")
    for other in [(1, 2, None, "x"), (1, None, 3, "x"), (1, None, 2, None), (1, None, 2, ""), (2, None, 2, "x")]:
        hit = digests.buckets_that_differ(rows_of(spark, [base]), rows_of(spark, [other]), ["k"])
        assert len(hit) == 1 + (other[0] != 1), other
    assert digests.buckets_that_differ(rows_of(spark, [base] * 3), rows_of(spark, [base] * 2), ["k"]) != []
    swapped = rows_of(spark, [(1, 1, 2, "x"), (1, 3, 4, "y")])
    assert digests.buckets_that_differ(swapped, rows_of(spark, [(1, 3, 4, "y"), (1, 1, 2, "x")]), ["k"]) == []
    assert digests.buckets_that_differ(swapped, rows_of(spark, [(1, 1, 4, "x"), (1, 3, 2, "y")]), ["k"]) != []


def test_results_are_those_without_digests(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 0, 1, 2])
    old = [(k, value(), value(), rng.choice([None, "", "t"])) for k in range(300)]
    new = [r if rng.random() < 0.9 else (r[0], value(), value(), "u") for r in old if rng.random() < 0.9] + [(1000, 1, 1, "n")]
    a, b = rows_of(spark, old), rows_of(spark, new)
    assert bag(diff_snapshots(a, b, ["k"], digests=True)) == bag(diff_snapshots(a, b, ["k"]))
    assert_same_bag(bags.verify_view(a.union(a), b.union(a), digests=True), bags.verify_view(a.union(a), b.union(a)))
    assert diff_snapshots(a, a, ["k"], digests=True).isEmpty() and bags.verify_view(a, a, digests=True).isEmpty()
    none = rows_of(spark, [])
    assert diff_snapshots(none, none, ["k"], digests=True).isEmpty()
    assert diff_snapshots(none, a, ["k"], digests=True).count() == 300


def test_columns_of_another_order_and_null_keys(spark):
    a = rows_of(spark, [(None, 1, 2, "x"), (2, 1, 2, "x")])
    assert bags.verify_view(a, a.select("s", "b", "a", "k"), digests=True).isEmpty()
    assert bag(bags.verify_view(a, a.where("k is not null"), digests=True)) == ["(None, 1, 2, 'x', 'stale')"]


def test_one_changed_row_of_many_joins_one_bucket(spark):
    old = spark.range(200_000).select("id", F.col("id").cast("string").alias("s"))
    new = old.withColumn("s", F.when(F.col("id") == 777, "other").otherwise(F.col("s")))
    left, right = digests.where_they_differ(old, new, ["id"])
    assert 0 < left.count() < 200 and right.count() < 200
    assert [tuple(r.before) + tuple(r.after) for r in diff_snapshots(old, new, ["id"], digests=True).collect()] == [(777, "777", 777, "other")]


def test_rows_do_not_reach_the_shuffle_of_the_digests(spark):
    text = digests.digest(rows_of(spark, [(1, 1, 1, "x")]), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and text.count("HashAggregate") >= 2


def test_columns_without_an_exact_hash_are_compared_whole(spark):
    for kind in ("map<int,int>", "struct<x:int,y:int>", "array<int>"):
        a = spark.range(3).select("id", F.lit(None).cast(kind).alias("v"))
        assert digests.where_they_differ(a, a, ["id"]) == (a, a)
    a = spark.createDataFrame([(1, (None, 1))], "id int, v struct<x:int,y:int>")
    b = spark.createDataFrame([(1, (1, None))], "id int, v struct<x:int,y:int>")
    assert diff_snapshots(a, b, ["id"], digests=True).count() == 1


def test_zeros_and_nan_are_equal(spark):
    a = spark.sql("select 1 as id, 0.0D as v union all select 2, double('nan')")
    b = spark.sql("select 1 as id, -0.0D as v union all select 2, double('nan')")
    assert digests.buckets_that_differ(a, b, ["id"]) == []
    assert digests.buckets_that_differ(a, b.withColumn("v", F.lit(1.5)), ["id"]) != []
