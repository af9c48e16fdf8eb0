"""Folding removed keys into a clustered store."""

from conftest import assert_same_bag
from pyspark.sql import functions as F

from tideview.sources import snapshots
from tideview.sources.snapshots import Cluster, SnapshotStore, Step


def test_rows_of_a_clustered_store_are_shuffled_once_when_keys_are_folded_in(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 40).alias("k"), "id", F.lit("x").alias("v"))
    store = SnapshotStore.create(spark, f"file://{tmp_path}/s", rows, ["k", "id"], Cluster("k", 5))
    back = rows.where("id % 3 = 1 and id < 50")
    store.publish([Step(rows.where("id % 3 = 1").select("k", "id"), None)])
    store.publish([Step(None, back)])
    store.publish([Step(rows.where("id = 4").select("k", "id"), None)])
    written = []
    real = SnapshotStore._write_placed
    monkeypatch.setattr(SnapshotStore, "_write_placed", lambda self, df, folder: (written.append(df), real(self, df, folder)))
    monkeypatch.setattr(snapshots, "broadcast_limit", lambda df: 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert store.compact(0.0)
        plan = written[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # rows and removed keys
    assert store.manifest().gone == () and len(store.manifest().rows) == 1
    expected = rows.where("id % 3 <> 1").union(back.where("id <> 4"))
    assert_same_bag(store.read(), expected)
    assert store.read().where("k = 7").count() == expected.where("k = 7").count()
