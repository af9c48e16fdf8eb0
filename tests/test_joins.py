"""The spread joins against Spark's plain joins."""

import pytest
from conftest import assert_same_bag
from pyspark.sql import functions as F

from tideview import Workspace
from tideview.operators.joins import (
    HOT_SHARE,
    SALTS,
    SKEW_BYTES,
    TASK_BYTES,
    heavy_keys,
    hot_keys,
    row_width,
    skew_safe_join,
)


@pytest.fixture
def spread(spark):
    values = {SKEW_BYTES: "0", HOT_SHARE: "0.1", SALTS: "4", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k in values:
        spark.conf.unset(k)


def sides(spark):
    """A third of the right rows share one key; some keys are NULL or without partner."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).when(n % 10 == 1, F.lit(None)).otherwise(n % 50)
    right = spark.range(600).select(n.alias("rid"), key.cast("int").alias("k"), (n % 11).alias("v")).alias("r")
    key = F.when(n == 3, F.lit(None)).otherwise(n % 45)
    left = spark.range(90).select(n.alias("lid"), key.cast("int").alias("k"), (n % 5).alias("w")).alias("l")
    return left, right


def test_hot_keys_are_found(spark):
    _, right = sides(spark)
    expected = right.where("k = 7").select(F.xxhash64("k")).first()[0]
    found = hot_keys(right, [F.col("k")], 0.2)
    assert found == [expected]
    assert hot_keys(spark.range(10_000), [F.col("id")], 0.01) == []
    assert hot_keys(spark.range(0), [F.col("id")], 0.01) == []


@pytest.mark.parametrize("rest", [[], ["r.v > l.w"]], ids=["equal", "and_more"])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_hot_key(spark, spread, how, rest):
    left, right = sides(spark)
    out = skew_safe_join(left, right, [("l.k", "r.k")], rest, how, ["l.lid"], ["r.rid"])
    on = F.expr(" and ".join(["l.k = r.k", *rest]))
    columns = ["l.lid", "l.k as lk", "r.rid", "r.k as rk", "l.w", "r.v"]
    assert_same_bag(out.selectExpr(*columns), left.join(right, on, how).selectExpr(*columns))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_no_equality(spark, spread, how):
    """Neither side may be broadcast, and there is no key to shuffle by."""
    left, right = sides(spark)
    right = right.where("v < 8")
    out = skew_safe_join(left, right, [], ["r.v % 7 <> l.w"], how, ["l.lid"], ["r.rid"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    expected = left.join(right, F.expr("r.v % 7 <> l.w"), how)
    assert_same_bag(out.selectExpr("lid", "rid", "v", "w"), expected.selectExpr("lid", "rid", "v", "w"))


@pytest.mark.parametrize("wide,spread_it", [("bigint", True), ("smallint", True), ("double", False), ("string", False)])
def test_keys_of_different_types(spark, spread, wide, spread_it):
    left, right = sides(spark)
    left = left.selectExpr("l.lid", f"cast(l.k as {wide}) as k", "l.w").alias("l")
    out = skew_safe_join(left, right, [("l.k", "r.k")], [], "full", ["l.lid"], ["r.rid"])
    assert ("__la" in out._jdf.queryExecution().analyzed().toString()) == spread_it
    columns = ["l.lid", "r.rid", "l.w", "r.v"]
    assert_same_bag(out.selectExpr(*columns), left.join(right, F.expr("l.k = r.k"), "full").selectExpr(*columns))


def test_hot_preserved_rows_are_left_to_spark(spark, spread):
    left, right = sides(spark)
    out = skew_safe_join(right, left, [("r.k", "l.k")], [], "left", ["r.rid"], ["l.lid"], right_unique=True)
    assert "__la" not in out._jdf.queryExecution().analyzed().toString()


def test_a_key_is_hot_by_its_bytes(spark, spread):
    """A key of a small share, but of more bytes than a task should get, is cut into as many pieces as it needs."""
    spark.conf.set(HOT_SHARE, "0.9")
    left, right = sides(spark)
    width = row_width(right)
    keys = [F.col("k")]
    assert heavy_keys(right, keys, 0.9, 1e9) == ([], 0.0)
    hot, most = heavy_keys(right, keys, 0.9, 100 * width)
    assert hot == hot_keys(right, keys, 0.2) and most >= 200 * width
    spark.conf.set(TASK_BYTES, str(20 * width))
    try:
        out = skew_safe_join(left, right, [("l.k", "r.k")], [], "left", ["l.lid"], ["r.rid"])
        text = out._jdf.queryExecution().analyzed().toString()
        assert "__la" in text and "array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9" in text
        assert_same_bag(out.selectExpr("lid", "rid", "w", "v"), left.join(right, F.expr("l.k = r.k"), "left").selectExpr("lid", "rid", "w", "v"))
    finally:
        spark.conf.unset(TASK_BYTES)


def test_a_chain_of_joins_on_one_key_is_split(spark, tmp_path):
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        Workspace(spark, f"file://{tmp_path}/w")
        key = F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 200).alias("k")
        a = spark.range(0, 40_000, 1, 8).select(key, F.col("id").alias("x"))
        b, c = (spark.range(0, 200, 1, 4).select(F.col("id").alias("k"), F.lit(n).alias(n)) for n in ("b", "c"))
        out = a.join(b, "k").join(c, "k")
        assert len(out.collect()) == 40_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in [*low, "spark.sql.adaptive.forceOptimizeSkewedJoin"]:
            spark.conf.unset(k)
