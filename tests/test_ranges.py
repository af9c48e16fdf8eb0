"""Joins on inequalities against Spark's plain joins, and how many pairs they try."""

import pytest
from conftest import assert_same_bag
from pyspark.sql import functions as F

from tideview.operators.joins import RANGE_BYTES, SKEW_BYTES, skew_safe_join
from tideview.operators.ranges import Band, cells, find_band

LOW = {RANGE_BYTES: "0", SKEW_BYTES: "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def spread(spark):
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k in LOW:
        spark.conf.unset(k)


def sides(spark, kind="double"):
    n = F.col("id")
    x = F.when(n % 17 == 0, F.lit(None)).when(n % 4 == 0, F.lit(500)).otherwise(n * 7919 % 1000)
    left = spark.range(240).select(n.alias("lid"), x.cast(kind).alias("x"), (x + n % 30).cast(kind).alias("x2")).alias("l")
    lo = F.when(n % 13 == 0, F.lit(None)).otherwise(n * 104729 % 1000)
    width = F.when(n % 50 == 7, 1200).when(n % 9 == 0, -3).otherwise(n % 6)  # a few very wide, some the wrong way round
    right = spark.range(150).select(n.alias("rid"), lo.cast(kind).alias("lo"), (lo + width).cast(kind).alias("hi")).alias("r")
    return left, right


CONDITIONS = {
    "point in range": ("full", ["l.x < r.hi", "l.x > r.lo"]),
    "between": ("inner", ["l.x between r.lo and r.hi and l.lid <> r.rid"]),
    "ranges overlap": ("full", ["l.x <= r.hi", "r.lo <= l.x2"]),
    "below": ("full", ["l.x < r.lo"]),
    "above": ("inner", ["r.hi < l.x"]),
    "with arithmetic": ("inner", ["l.x + 1 > r.lo - 2", "l.x + 1 <= r.lo + 2"]),
    "range of the left": ("inner", ["r.lo >= l.x", "r.lo < l.x2"]),
}


@pytest.mark.parametrize("how,rest", CONDITIONS.values(), ids=CONDITIONS)
def test_inequalities(spark, spread, how, rest):
    left, right = sides(spark)
    out = skew_safe_join(left, right, [], rest, how, ["l.lid"], ["r.rid"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "__rcell" in plan
    columns = ["lid", "x", "rid", "lo"]
    assert_same_bag(out.selectExpr(*columns), left.join(right, F.expr(" and ".join(rest)), how).selectExpr(*columns))


@pytest.mark.parametrize("kind,how", [("decimal(9,2)", "left"), ("date", "right"), ("timestamp", "left")])
def test_kinds_of_values(spark, spread, kind, how):
    left, right = sides(spark, "long")
    if kind in ("date", "timestamp"):
        given = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c) * 86400).cast(kind))
    else:
        given = lambda df, c: df.withColumn(c, F.col(c).cast(kind))
    left, right = given(given(left, "x"), "x2").alias("l"), given(given(right, "lo"), "hi").alias("r")
    rest = ["l.x >= r.lo", "l.x < r.hi"]
    out = skew_safe_join(left, right, [], rest, how, ["l.lid"], ["r.rid"])
    assert "__rcell" in out._jdf.queryExecution().executedPlan().toString()
    expected = left.join(right, F.expr(" and ".join(rest)), how)
    assert_same_bag(out.selectExpr("lid", "rid"), expected.selectExpr("lid", "rid"))


def test_infinite_values_and_nan(spark, spread):
    odd = ["double('nan')", "double('infinity')", "double('-infinity')", "0D", "-0D", "1D", "null"]
    left = spark.sql(" union all ".join(f"select {i} as lid, {v} as x" for i, v in enumerate(odd))).alias("l")
    right = spark.sql(" union all ".join(f"select {i * 7 + j} as rid, {a} as lo, {b} as hi" for i, a in enumerate(odd) for j, b in enumerate(odd))).alias("r")
    for rest in (["l.x >= r.lo", "l.x <= r.hi"], ["l.x < r.hi"], ["l.x > r.hi"]):
        out = skew_safe_join(left, right, [], rest, "full", ["l.lid"], ["r.rid"])
        assert_same_bag(out.selectExpr("lid", "rid"), left.join(right, F.expr(" and ".join(rest)), "full").selectExpr("lid", "rid"))


def test_empty_sides_and_equal_values(spark, spread):
    left, right = sides(spark)
    one = left.withColumn("x", F.lit(5.0)).alias("l")
    for a, b in ((left.where("false"), right), (left, right.where("false")), (one, right), (one, right.selectExpr("rid", "5.0D as lo", "5.0D as hi").alias("r"))):
        rest = ["l.x <= r.hi", "l.x >= r.lo"]
        out = skew_safe_join(a, b, [], rest, "full", ["l.lid"], ["r.rid"])
        assert_same_bag(out.selectExpr("lid", "rid"), a.join(b, F.expr(" and ".join(rest)), "full").selectExpr("lid", "rid"))


def pairs_tried(left, right, band, copy_left=False):
    a, b, _ = cells(left, right, band, copy_left)
    a, b = (x.groupBy(f"__{s}grid", f"__{s}cell").count() for x, s in ((a, "l"), (b, "r")))
    return a.join(b.withColumnRenamed("count", "n"), F.expr("__lgrid = __rgrid and __lcell = __rcell")).agg(F.sum(F.col("count") * F.col("n"))).first()[0]


def test_a_band_tries_few_pairs(spark):
    n = F.col("id")
    left = spark.range(3000).select(n.alias("lid"), (n * 7919 % 100_003 / 7).alias("x")).alias("l")
    right = spark.range(2000).select(n.alias("rid"), (n * 104729 % 100_003 / 7).alias("z")).withColumn("y", F.col("z") + 3 + F.when(F.col("rid") % 100 == 0, 9000).otherwise(0)).alias("r")
    band = find_band(left, right, ["l.x < r.y and l.x > r.z"])
    assert band == Band("l.x", "r.y", "l.x", "r.z")
    matches = left.join(right, F.expr("l.x < r.y and l.x > r.z")).count()
    tried = pairs_tried(left, right, band)
    assert tried < 3000 * 2000 / 20 and tried < 3 * matches + 20_000
    half = pairs_tried(left, right, find_band(left, right, ["l.x < r.z"]), copy_left=True)
    assert half < 3000 * 2000 * 0.55


def test_what_is_no_band(spark):
    left, right = sides(spark)
    for text in ("l.x <> r.lo", "l.x < 5 and r.lo > 3", "l.x < r.lo or l.x > r.hi", "l.x + r.lo < 5", "cast(l.x as string) < cast(r.lo as string)"):
        assert find_band(left, right, [text]) is None
