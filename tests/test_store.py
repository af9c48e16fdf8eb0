"""Stored versions, what survives a crash, put-off changes and streams."""

import uuid

import pytest
from conftest import assert_same_bag, bag
from pyspark.sql import functions as F

from tideview import Change, SnapshotStore, Table, UnsupportedView, ViewSpec, Workspace, full, left
from tideview.sources.changes import changes_of
from tideview.sources.snapshots import Step
from tideview.sources.storage import Files, Staging, shared_dir
from tideview.streaming import continuous

PAIR = "k int, v string"


def frame(spark, data, schema=PAIR):
    return spark.createDataFrame(data, schema).coalesce(1)


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def test_versions(spark, folder):
    store = SnapshotStore.create(spark, folder, frame(spark, [(1, "a"), (2, "b")]), ["k"])
    store.publish([Step(frame(spark, [(1,)], "k int"), frame(spark, [(3, "c")]))])
    assert bag(store.read()) == ["(2, 'b')", "(3, 'c')"]
    assert bag(store.read(0)) == ["(1, 'a')", "(2, 'b')"]
    # A key that went may come again, also within the steps of one publish.
    store.publish(
        [
            Step(None, frame(spark, [(1, "again")])),
            Step(frame(spark, [(1,), (3,)], "k int"), None),
            Step(frame(spark, [(2,)], "k int"), frame(spark, [(1, "last"), (2, "new")])),
        ]
    )
    expected = ["(1, 'last')", "(2, 'new')"]
    assert bag(store.read()) == expected
    assert not store.compact(above=100.0)
    assert store.compact(above=100.0, most_folders=2)
    assert bag(store.read()) == expected and len(store.manifest().gone) == 1
    assert store.compact()
    assert bag(store.read()) == expected and not store.manifest().gone
    store.expire(keep=1)
    assert bag(SnapshotStore(spark, folder).read()) == expected
    assert len(Files(spark).names(f"{folder}/data")) == 1
    store.replace(frame(spark, [(9, "z")]))
    assert bag(store.read()) == ["(9, 'z')"]
    store.drop()
    assert not SnapshotStore.exists(spark, folder)


def test_crash_before_the_switch_leaves_the_old_version(spark, folder, monkeypatch):
    store = SnapshotStore.create(spark, folder, frame(spark, [(1, "a")]), ["k"])

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_switch", crash)
        with pytest.raises(RuntimeError):
            store.publish([Step(None, frame(spark, [(2, "b")]))], ("w", 0))
    assert bag(SnapshotStore(spark, folder).read()) == ["(1, 'a')"]
    store.publish([Step(None, frame(spark, [(2, "b")]))], ("w", 0))
    store.publish([Step(None, frame(spark, [(2, "b")]))], ("w", 0))
    assert bag(store.read()) == ["(1, 'a')", "(2, 'b')"]
    store.publish([Step(None, frame(spark, [(3, "c")]))], ("another", 0))
    assert store.read().count() == 3


def test_slower_writer_fails(spark, folder):
    store = SnapshotStore.create(spark, folder, frame(spark, [(1, "a")]), ["k"])
    with pytest.raises(FileExistsError):
        store._switch(store.manifest())


A, B = "id int, x string", "id int, a_id int, y int"
SPEC = ViewSpec(
    {"a": Table("a", "id"), "b": Table("b", "id")},
    full("a", "b", "a.id = b.a_id"),
    {"x": "a.x", "y": "b.y"},
)


@pytest.fixture
def work(spark, folder):
    w = Workspace(spark, folder)
    w.add_table("a", frame(spark, [(1, "one"), (2, "two")], A), ["id"])
    w.add_table("b", frame(spark, [(10, 1, 5), (11, 3, 6)], B), ["id"])
    w.register_view("v", SPEC)
    return w


START = ["('one', 5)", "('two', None)", "(None, 6)"]


def test_workspace(spark, work):
    assert bag(work.view("v")) == START
    work.register_query("q", "select count(*) as n from {a}")
    work.apply(
        {
            "a": Change(frame(spark, [(1, "one")], A), frame(spark, [(3, "three")], A)),
            "b": Change(inserted=frame(spark, [(12, 2, 7)], B)),
        }
    )
    assert bag(work.view("v")) == ["('three', 6)", "('two', 7)", "(None, 5)"]
    assert work.verify("v").isEmpty() and bag(work.view("q")) == ["(2,)"]
    assert bag(Workspace(spark, work.root).view("v")) == bag(work.view("v"))
    work.refresh("v")
    assert work.verify("v").isEmpty() and work.verify("q").isEmpty()
    assert work.views() == ["q", "v"]
    work.drop_view("q")
    assert work.views() == ["v"]
    work.expire(1)
    assert work.verify("v").isEmpty()
    with pytest.raises(ValueError):
        work.add_table("c", frame(spark, [(1, "x"), (1, "y")], A), ["id"])
    with pytest.raises(ValueError):
        work.apply({"a": Change(inserted=frame(spark, [(1,)], "id int"))})
    with pytest.raises(UnsupportedView):
        spec = ViewSpec({"b": Table("b", "a_id")}, "b", {"y": "b.y"})
        work.register_view("w", spec)


def test_view_of_one_table(spark, work):
    work.register_view("single", ViewSpec({"a": Table("a", "id")}, "a", {"x": "upper(a.x)"}, "a.id > 1"))
    work.apply({"a": Change(frame(spark, [(2, "two")], A), frame(spark, [(5, "five"), (0, "zero")], A))})
    assert bag(work.view("single")) == ["('FIVE',)"]


def test_crash_between_view_and_tables(spark, work, monkeypatch):
    change = {"a": Change(inserted=frame(spark, [(3, "three")], A)), "b": Change(frame(spark, [(10, 1, 5)], B))}
    real = SnapshotStore.publish

    def crash_at_table_b(self, steps, batch=None):
        if self.root.endswith("/tables/b"):
            raise RuntimeError("lost")
        return real(self, steps, batch)

    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "publish", crash_at_table_b)
        with pytest.raises(RuntimeError):
            work.apply(change)
    # The view is published, table b is not: readers see neither.
    assert bag(work.view("v")) == START and work.table("a").count() == 2 and work.verify("v").isEmpty()
    later = Workspace(spark, work.root)
    later.recover()
    assert later.verify("v").isEmpty()
    assert bag(later.view("v")) == ["('one', None)", "('three', 6)", "('two', None)"]
    later.recover()
    later.apply({"a": Change(frame(spark, [(1, "one")], A))})
    assert later.verify("v").isEmpty()


def test_failure_before_anything_is_published(spark, work, monkeypatch):
    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "publish", crash)
        with pytest.raises(RuntimeError):
            work.apply({"a": Change(inserted=frame(spark, [(3, "three")], A))})
    work.recover()
    assert bag(work.view("v")) == START and work.table("a").count() == 2


def feed(spark, deleted, inserted, schema, seq=1):
    parts = [None if rows is None else frame(spark, rows, schema) for rows in (deleted, inserted)]
    return changes_of(*parts).withColumn("seq", F.lit(seq).cast("bigint"))


def test_deferred(spark, work):
    work.defer("a", feed(spark, None, [(3, "three")], A, 1))
    work.defer("a", feed(spark, [(3, "three")], [(4, "four")], A, 2))
    work.defer("b", feed(spark, [(10, 1, 5)], None, B))
    assert bag(work.view("v")) == START
    work.apply_deferred()
    assert bag(work.view("v")) == ["('four', None)", "('one', None)", "('two', None)", "(None, 6)"]
    work.apply_deferred()
    assert work.verify("v").isEmpty()


def test_stream(spark, work):
    folders = {s: f"{work.root}/incoming/{s}" for s in "ab"}
    checkpoint = f"{work.root}/checkpoint"
    feed(spark, None, [(3, "three")], A).write.parquet(folders["a"])
    feed(spark, [(10, 1, 5)], None, B).write.parquet(folders["b"])
    continuous.start(work, folders, checkpoint).awaitTermination()
    assert bag(work.view("v")) == ["('one', None)", "('three', 6)", "('two', None)"]
    feed(spark, [(3, "three")], None, A).write.mode("append").parquet(folders["a"])
    continuous.start(work, folders, checkpoint).awaitTermination()
    assert bag(work.view("v")) == ["('one', None)", "('two', None)", "(None, 6)"]
    assert work.verify("v").isEmpty()
    # A micro-batch that is handed over again changes nothing.
    rows = feed(spark, None, [(9, "nine")], A).selectExpr(
        "'a' as source", "op", "seq", "before as before_a", "after as after_a"
    )
    before = bag(work.view("v"))
    continuous.apply_batch(work, ["a"], rows, checkpoint, 0)
    assert bag(work.view("v")) == before
    continuous.apply_batch(work, ["a"], rows, "another stream", 0)
    assert len(bag(work.view("v"))) == len(before) + 1


def test_staged_size_is_not_hidden_by_compression(spark):
    """A value repeated many times must not look small enough to broadcast."""
    from tideview.sources.storage import plan_bytes

    with Staging(spark) as staging:
        rows = staging.table(spark.range(0, 500_000, 1, 1).select(F.lit(7).cast("bigint").alias("k")))
        assert plan_bytes(rows) >= 500_000 * 8


def test_left_join_tree_survives_json():
    spec = ViewSpec(
        {"a": Table("a", "id"), "b": Table("b", "id")},
        left("a", "b", [("a.id", "b.a_id"), "b.y > 0"]),
        {"x": "a.x"},
        "a.id > 0",
    )
    assert ViewSpec.from_json(spec.to_json()) == spec


def test_a_failed_load_of_a_table_leaves_nothing(spark, tmp_path):
    work = Workspace(spark, f"file://{tmp_path}/w")
    work.add_table("a", frame(spark, [(1, "one")], A), ["id"])
    bad = frame(spark, [(1, "x"), (2, "y")], A).withColumn("name", F.expr("raise_error('a bad row')").cast("string"))
    with pytest.raises(Exception, match="a bad row"):
        work.add_table("b", bad, ["id"], check=False)
    work.apply({"a": Change(inserted=frame(spark, [(2, "two")], A))})
    work.register_view("v", ViewSpec({"a": Table("a", "id")}, "a", {"id": "a.id"}))
    assert work.tables() == ["a"] and work.view("v").count() == 2
    work.add_table("b", frame(spark, [(1, "x")], A), ["id"])
    with pytest.raises(ValueError, match="read by v"):
        work.drop_table("a")
    work.drop_table("b")
    assert work.tables() == ["a"]
    work.add_table("b", frame(spark, [(7, "z")], A), ["id"])
    assert bag(work.table("b")) == ["(7, 'z')"]


def test_a_killed_load_leaves_no_table(spark, tmp_path, monkeypatch):
    work = Workspace(spark, f"file://{tmp_path}/w")
    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_switch", lambda *a: 1 / 0)  # as if it died: nothing is cleared
        with pytest.raises(ZeroDivisionError):
            work.add_table("a", frame(spark, [(1, "one")], A), ["id"])
    assert work.tables() == []
    work.add_table("a", frame(spark, [(2, "two")], A), ["id"])
    assert bag(work.table("a")) == ["(2, 'two')"]


@pytest.mark.parametrize("kind", ["view", "query"])
def test_a_failed_load_of_a_view_leaves_nothing(spark, tmp_path, kind):
    work = Workspace(spark, f"file://{tmp_path}/w")
    work.add_table("a", frame(spark, [(1, "one"), (0, "zero")], A), ["id"])
    with pytest.raises(Exception, match="(?i)zero"):
        if kind == "view":
            work.register_view("v", ViewSpec({"a": Table("a", "id")}, "a", {"x": "1 div a.id"}))
        else:
            work.register_query("v", "select 1 div id as x from {a}")
    assert work.views() == []
    work.apply({"a": Change(deleted=frame(spark, [(0, "zero")], A))})
    work.register_view("v", ViewSpec({"a": Table("a", "id")}, "a", {"x": "1 div a.id"}))
    with pytest.raises(FileExistsError):
        work.register_view("v", ViewSpec({"a": Table("a", "id")}, "a", {"x": "a.id"}))
    assert bag(work.view("v")) == ["(1,)"] and work.verify("v").isEmpty()


@pytest.mark.parametrize("call", ["add_table", "register_query", "refresh", "drop_view", "drop_table"])
def test_no_call_shows_half_a_batch(spark, tmp_path, monkeypatch, call):
    """A batch dies between the view and the table; whatever is called next finishes it first."""
    work = Workspace(spark, f"file://{tmp_path}/w")
    for name in ("a", "spare"):
        work.add_table(name, frame(spark, [(1, "one")], A), ["id"])
    for name in ("v", "other"):
        work.register_view(name, ViewSpec({"a": Table("a", "id")}, "a", {"id": "a.id"}))
    publish = SnapshotStore.publish
    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "publish", lambda self, *a: 1 / 0 if "/tables/" in self.root else publish(self, *a))
        with pytest.raises(ZeroDivisionError):
            work.apply({"a": Change(inserted=frame(spark, [(2, "two")], A))})
    assert work.verify("v").isEmpty() and work.view("v").count() == 1
    arguments = {"add_table": ("x", frame(spark, [(1, "x")], A), ["id"]), "register_query": ("q", "select count(*) as n from {a}"), "refresh": ("v",), "drop_view": ("other",), "drop_table": ("spare",)}
    getattr(work, call)(*arguments[call])
    assert work.verify("v").isEmpty() and work.view("v").count() == work.table("a").count() == 2
    if call == "register_query":
        assert bag(work.view("q")) == ["(2,)"]


def test_old_versions_are_dropped_by_the_count_of_commits(spark, tmp_path):
    work = Workspace(spark, f"file://{tmp_path}/w", keep=1, expire_every=2, compact_above=0.0)
    work.add_table("a", frame(spark, [(1, "one")], A), ["id"])
    for i in range(2, 6):
        work.apply({"a": Change(inserted=frame(spark, [(i, "x")], A))})
    assert len(work._files.names(f"{work.root}/tables/a/versions")) <= 3
