"""The sequence log against a dict, and what it reads."""

import random

import pytest
from conftest import bag
from pyspark.sql import types as T

from tideview import Table, ViewSpec, Workspace
from tideview.sources.sequences import SequenceLog

KEYS = [T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]


def rows(spark, items):
    return spark.createDataFrame([(*k, s) for k, s in items], "a long, b string, seq long")


def test_random_batches_against_a_dict(spark, tmp_path):
    rng, log, known = random.Random(4), SequenceLog(spark, f"file://{tmp_path}/log", KEYS, bucket_rows=20), {}
    for number in range(9):
        batch = {(rng.randrange(60), rng.choice("xyz")): rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 60]))}
        log.append(rows(spark, batch.items()), ("w", number))
        log.append(rows(spark, [((1, "x"), 10**9)]), ("w", number))  # replayed: nothing happens
        for k, s in batch.items():
            known[k] = max(known.get(k, -1), s)
    assert sum(x.rows for x in log.layers) < 2 * len(known) + 100 and len(log.layers) <= 12
    asked = [(rng.randrange(80), rng.choice("xyz")) for _ in range(30)] + [(None, "x")]
    wanted = spark.createDataFrame(asked + asked[:3], "a long, b string")
    assert bag(log.last(wanted)) == sorted(repr((*k, known[k])) for k in set(asked) if k in known)
    every = spark.createDataFrame([(a, b) for a in range(60) for b in "xyz"], "a long, b string")
    assert bag(log.last(every)) == sorted(repr((*k, s)) for k, s in known.items())


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    log = SequenceLog(spark, f"file://{tmp_path}/log", KEYS, bucket_rows=100)
    log.append(spark.range(20_000).selectExpr("id as a", "'x' as b", "id as seq"), ("w", 0))
    log.append(rows(spark, [((3, "x"), 99)]), ("w", 1))
    assert [x.buckets for x in log.layers] == [256, 1]
    ten = spark.createDataFrame([(i * 7, "x") for i in range(10)], "a long, b string")
    few = log.last(ten)
    assert len(few.inputFiles()) <= 11  # ten buckets, and the small layer
    assert len(log.last(spark.range(20_000).selectExpr("id as a", "'x' as b")).inputFiles()) >= 256
    assert bag(few) == sorted(repr((i * 7, "x", i * 7)) for i in range(10))


def test_integers_of_other_width_fall_into_the_same_bucket(spark, tmp_path):
    log = SequenceLog(spark, f"file://{tmp_path}/log", KEYS, bucket_rows=1)
    log.append(spark.range(50).selectExpr("cast(id as int) as a", "'x' as b", "id as seq"), ("w", 0))
    assert bag(log.last(spark.sql("select cast(7 as smallint) as a, 'x' as b"))) == ["(7, 'x', 7)"]


def test_merged_layers_stay_few_and_keep_the_largest(spark, tmp_path):
    log = SequenceLog(spark, f"file://{tmp_path}/log", KEYS, bucket_rows=8)
    for number in range(9):
        log.append(rows(spark, [((k, "x"), 100 - number if k == 0 else number) for k in range(10)]), ("w", number))
    assert len(log.layers) <= 3 and sum(x.rows for x in log.layers) <= 30
    assert bag(log.last(spark.createDataFrame([(0, "x"), (9, "x")], "a long, b string"))) == ["(0, 'x', 100)", "(9, 'x', 8)"]


@pytest.mark.parametrize("crash", [False, True])
def test_a_stream_batch_reads_only_buckets_of_its_keys(spark, tmp_path, monkeypatch, crash):
    """A replay after a crash between the tables and the log changes nothing; late changes are dropped."""
    monkeypatch.setattr("tideview.sources.sequences.BUCKET_ROWS", 50)
    monkeypatch.setattr(SequenceLog.__init__, "__defaults__", (50,))
    work = Workspace(spark, f"file://{tmp_path}/work")
    work.add_table("t", spark.range(3000).selectExpr("id", "id as v"), ["id"])
    work.register_view("v", ViewSpec({"t": Table("t", "id")}, "t", {"id": "t.id", "v": "t.v"}))
    row = "struct<id:bigint,v:bigint>"

    def feed(changes):
        return spark.createDataFrame(changes, f"op string, before {row}, after {row}, seq long")

    work.apply_ordered({"t": feed([("U", (i, i), (i, i + 1), 10) for i in range(2000)])}, ("s", 0))
    late = [("U", (5, 6), (5, 0), 9), ("U", (6, 7), (6, 77), 11), ("D", (2500, 2500), None, 1)]
    files = []
    last = SequenceLog.last

    def watched(self, wanted):
        out = last(self, wanted)
        files.append(sum("/seqs/" in f for f in out.inputFiles()))
        return out

    monkeypatch.setattr(SequenceLog, "last", watched)
    if crash:
        with monkeypatch.context() as m:
            m.setattr(SequenceLog, "append", lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                work.apply_ordered({"t": feed(late)}, ("s", 1))
    work.apply_ordered({"t": feed(late)}, ("s", 1))
    work.apply_ordered({"t": feed(late)}, ("s", 1))
    assert files and max(files) <= 3 < work._seqs("t").layers[0].buckets
    got = {r.id: r.v for r in work.view("v").where("id in (5, 6, 7, 2500)").collect()}
    assert got == {5: 6, 6: 77, 7: 8} and work.verify("v").isEmpty()
