"""What a step shuffles and writes follows the tables, not the pairs of a join without an equality."""

import time

from conftest import assert_same_bag
from pyspark.sql import functions as F

from tideview import Change, Workspace, bind, build_view, maintain, tables_after, visible
from tideview.operators.joins import RANGE_BYTES, skew_safe_join
from tideview.operators.ranges import find_band, range_join
from tideview.plans.maintain import maintenance_steps
from tideview.plans.spec import Table, ViewSpec, left
from tideview.sources.storage import Files, Staging
from tideview.sources.tables import keys_look_sound


def sides(spark):
    n = F.col("id")
    rows = spark.range(60).select(n.alias("id"), F.when(n % 11 != 0, n * 37 % 50).cast("double").alias("x"), F.lit("unread").alias("note"))
    points = spark.range(40).select(n.alias("id"), (n * 17 % 50 + 0.5).alias("y"))
    return rows, points


SPEC = ViewSpec(
    {"a": Table("rows", "id"), "b": Table("points", "id")},
    left("a", "b", "b.y < a.x + 2 and b.y > a.x - 2"),
    {"a_id": "a.id", "b_id": "b.id", "y": "b.y"},
)


def test_rows_stand_in_one_cell_where_the_others_are_points(spark):
    rows, points = sides(spark)
    a, b = rows.alias("a"), points.alias("b")
    on = "b.y < a.x + 2 and b.y > a.x - 2"
    joined = range_join(a, b, find_band(a, b, [on]), F.expr(on), "left")
    assert joined.once == "left"
    assert joined.left.count() == rows.where("x is not null").count()


def test_rows_with_one_id_keep_or_lose_their_partner_each_on_its_own(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 40.0), (None, 40.0), (2, None)], "id long, x double").alias("a")
    points = spark.createDataFrame([(7, 1.5)], "id long, y double").alias("b")
    on = "b.y < a.x + 2 and b.y > a.x - 2"
    spark.conf.set(RANGE_BYTES, "0")
    try:
        got = skew_safe_join(rows, points, [], [on], "left", ["a.id"], ["b.id"])
    finally:
        spark.conf.unset(RANGE_BYTES)
    assert_same_bag(got.selectExpr("a.id", "x", "y"), rows.join(points, F.expr(on), "left").selectExpr("a.id", "x", "y"))


def test_pairs_of_a_join_without_an_equality_are_not_written(spark, staging):
    rows, points = sides(spark)
    old = {"rows": rows, "points": points.where("id % 4 <> 1")}
    view = bind(SPEC, {"rows": rows, "points": points})
    change = {"points": Change(points.where("id % 4 = 0"), points.where("id % 4 = 1"))}
    spark.conf.set(RANGE_BYTES, "0")
    try:
        got = visible(view, maintain(view, build_view(view, old), old, change, staging))
        expected = visible(view, build_view(view, tables_after(view, old, change)))
        assert_same_bag(got, expected)
    finally:
        spark.conf.unset(RANGE_BYTES)
    assert not [n for n in Files(spark).names(staging.path) if "delta" in n]


def test_change_rows_are_written_without_columns_the_view_does_not_read(spark, staging):
    rows, points = sides(spark)
    tables = {"rows": rows, "points": points}
    view = bind(SPEC, tables)
    (step,) = maintenance_steps(view, tables, {"rows": Change(deleted=rows.where("id < 9"))}, staging)
    assert step.gone.columns == ["__a__id"]
    written = [n for n in Files(spark).names(staging.path) if "old-rows" in n]
    assert spark.read.parquet(f"{staging.path}/{written[0]}").columns == ["id", "x"]


def test_the_journal_holds_of_rows_that_leave_what_views_read(spark, tmp_path, monkeypatch):
    rows, points = sides(spark)
    work = Workspace(spark, f"file://{tmp_path}/work")
    work.add_table("rows", rows, ["id"])
    work.add_table("points", points, ["id"])
    work.register_view("v", SPEC)
    seen = []
    finish = work._finish
    monkeypatch.setattr(work, "_finish", lambda staged, *rest: (seen.append(staged["rows"].deleted.columns), finish(staged, *rest)))
    work.apply({"rows": Change(deleted=rows.where("id < 9"))})
    assert seen == [["id", "x"]]
    assert work.verify("v").isEmpty()
    assert_same_bag(work.table("rows"), rows.where("id >= 9"))


def test_sound_keys_are_known_from_their_hashes(spark):
    sound = spark.createDataFrame([(1, "a"), (1, "b")], "k long, l string")
    assert keys_look_sound(sound, ["k", "l"])
    assert not keys_look_sound(sound, ["k"])
    assert not keys_look_sound(spark.createDataFrame([(1, None)], "k long, l string"), ["k", "l"])


def test_rows_copied_into_cells_are_not_taken_for_as_small_as_their_files(spark, tmp_path):
    n = F.col("id")
    spark.range(0, 6000, 1, 1).select(n.alias("id"), (n % 40).cast("double").alias("x")).write.parquet(f"file://{tmp_path}/rows")
    spark.range(0, 4000, 1, 1).select(F.lit(1).cast("long").alias("id"), (n % 4 + 0.5).alias("y")).write.parquet(f"file://{tmp_path}/points")
    rows, points = (spark.read.parquet(f"file://{tmp_path}/{t}").alias(a) for t, a in (("rows", "a"), ("points", "b")))
    on = "b.y < a.x + 1 and b.y > a.x - 1"
    spark.conf.set(RANGE_BYTES, "0")
    try:
        for limit, broadcast in (("50000", False), ("10000000", True)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = skew_safe_join(rows, points, [], [on], "left", ["a.id"], ["b.id"])
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == broadcast and ("SortMergeJoin" in plan) != broadcast
            sums = [F.count("*"), F.count("y"), F.sum("a.id"), F.sum("y")]
            assert got.agg(*sums).collect() == rows.join(points, F.expr(on), "left").agg(*sums).collect()
    finally:
        spark.conf.unset(RANGE_BYTES)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_with_and_without_partner_are_shuffled_once(spark, staging):
    a, b = (staging.table(side).alias(name) for side, name in zip(sides(spark), "ab"))
    on = "b.y < a.x + 2 and b.y > a.x - 2"
    for name, value in ((RANGE_BYTES, "0"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        got = skew_safe_join(a, b, [], [on], "left", ["a.id"], ["b.id"]).selectExpr("a.id", "x", "b.id as b_id", "y")
        got.collect()
        assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(RANGE_BYTES)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_covered_and_lost_keys_come_from_one_pass_of_the_pairs(spark, staging, monkeypatch):
    rows, points = sides(spark)
    tables = {"rows": staging.table(rows), "points": staging.table(points)}
    view = bind(SPEC, tables)
    change = {"points": Change(deleted=points.where("id % 3 = 0"), inserted=points.where("id % 3 = 1").withColumn("id", F.col("id") + 100))}
    names, real = [], Staging.table
    monkeypatch.setattr(Staging, "table", lambda self, df, name="t": names.append((name, "__rcell" in df._jdf.queryExecution().optimizedPlan().toString())) or real(self, df, name))
    spark.conf.set(RANGE_BYTES, "0")
    try:
        got = maintain(view, build_view(view), tables, change, staging)
    finally:
        spark.conf.unset(RANGE_BYTES)
    assert sum(pairs for _, pairs in names) == 1
    assert_same_bag(got, build_view(view, tables_after(view, tables, change)))


def test_a_staged_table_leaves_no_shuffle_files(spark, staging):
    def files():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in every.split() if "/shuffle_" in f}

    before = files()
    written = staging.table(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert written.count() == 7
