"""Feeds that aren't perfect, views from SQL text, and one state for all readers."""

import pytest
from conftest import bag
from pyspark.sql import functions as F

from tideview import BadChange, Change, Table, UnsupportedView, ViewSpec, Workspace, bind, left, view_from_sql
from tideview.operators.terms import remove_subsumed
from tideview.plans import workspace as workspace_module
from tideview.sources.changes import as_table_rows, changes_of, net_changes, split_changes
from tideview.sources.snapshots import SnapshotStore
from tideview.sources.tables import key_violations
from tideview.streaming import continuous

P = "id int, x int"
C = "pid int, n int, amt int"
SPEC = ViewSpec(
    {"p": Table("p", "id"), "c": Table("c", ["pid", "n"])}, left("p", "c", "c.pid = p.id"), {"id": "p.id", "x": "p.x", "amt": "c.amt"}
)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def work(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.add_table("p", frame(spark, [(1, 10), (2, 20)], P), ["id"])
    w.add_table("c", frame(spark, [(1, 1, 5), (2, 1, 6)], C), ["pid", "n"])
    w.register_view("v", SPEC)
    return w


@pytest.mark.parametrize(
    "on",
    [
        "c.pid = p.id and c.amt > 5", "`c`.pid = `p`.id", "(c.pid = p.id)", "c.amt > 5 and (p.id = c.pid and c.n < 9)",
        "c.pid + 1 = p.id - 1", [("c.pid", "p.id"), "c.amt > 5"], "cast(c.pid as bigint) = p.id AND c.amt is not null",
    ],
)
def test_equalities_are_found_however_they_are_written(spark, on):
    tables = {"p": frame(spark, [(1, 10)], P), "c": frame(spark, [(1, 1, 5)], C)}
    view = bind(ViewSpec(SPEC.tables, left("p", "c", on), SPEC.select), tables)
    assert len(view.root.pairs) == 1
    from tideview import build_view

    text = build_view(view)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "explode" not in text


def test_other_conditions_are_no_equalities(spark):
    tables = {"p": frame(spark, [(1, 10)], P), "c": frame(spark, [(1, 1, 5)], C)}
    view = bind(ViewSpec(SPEC.tables, left("p", "c", "c.pid = p.id or c.n = p.x"), SPEC.select), tables)
    assert view.root.pairs == [] and len(view.root.rest) == 1
    with pytest.raises(UnsupportedView):
        bind(ViewSpec(SPEC.tables, left("p", "c", "c.pid = nowhere.id"), SPEC.select), tables)


def test_rows_that_are_not_there_do_not_leave(spark, work):
    gone = frame(spark, [(1, 1, 5)], C)
    for rows in (frame(spark, [(1, 7, 0), (9, 1, 0)], C), gone, gone):
        work.apply({"c": Change(deleted=rows)})
    assert bag(work.view("v")) == ["(1, 10, None)", "(2, 20, 6)"] and work.verify("v").isEmpty()


def test_old_images_and_keys_alone_are_enough(spark, work):
    work.apply({"c": Change(deleted=frame(spark, [(1, 1, 777)], C))})
    work.apply({"c": Change(deleted=frame(spark, [(2, 1)], "pid long, n int").select(F.col("pid").cast("int"), "n"))})
    assert bag(work.view("v")) == ["(1, 10, None)", "(2, 20, None)"] and work.table("c").isEmpty()


@pytest.mark.parametrize(
    "rows, schema",
    [([(1, 1, 9)], C), ([(3, 1, 1), (3, 1, 2)], C), ([(None, 1, 1)], C), ([(3, 1, "x")], "pid int, n int, amt string"), ([(3, 1)], "pid int, n int"),
     ([(3, 1, 2**40)], "pid int, n int, amt bigint")],
)
def test_inserts_a_table_cannot_take(spark, work, rows, schema):
    with pytest.raises(BadChange):
        work.apply({"c": Change(inserted=frame(spark, rows, schema))})
    assert not work._files.names(f"{work.root}/journal")
    work.apply({"c": Change(inserted=frame(spark, [(1, 2, 8)], C))})  # the workspace goes on
    assert work.table("c").count() == 3 and work.verify("v").isEmpty()


def test_a_key_that_leaves_in_the_batch_may_enter_and_types_are_widened(spark, work):
    work.apply({"c": Change(frame(spark, [(1, 1, 0)], C), frame(spark, [(1, 1, 99)], "pid short, n byte, amt int"))})
    assert bag(work.view("v")) == ["(1, 10, 99)", "(2, 20, 6)"]
    rows = as_table_rows(frame(spark, [(1, None)], "b byte, a void"), frame(spark, [], "a string, b double").schema, "t")
    assert rows.dtypes == [("a", "string"), ("b", "double")]


@pytest.mark.parametrize("op", ["u", "R", None])
def test_unknown_ops_fail(spark, op):
    feed = changes_of(frame(spark, [(1, 1)], P), None).withColumn("op", F.lit(op)).withColumn("seq", F.lit(1))
    for broken in (split_changes(feed)[0], split_changes(feed)[1], net_changes(feed, ["id"])):
        with pytest.raises(Exception, match="unknown op"):
            broken.collect()


def test_a_feed_that_fails_leaves_the_workspace_usable(spark, work):
    feed = changes_of(frame(spark, [(1, 1)], P), None).withColumn("op", F.lit("x")).withColumn("seq", F.lit(1).cast("long"))
    with pytest.raises(Exception, match="unknown op"):
        work.apply_feed({"p": feed})
    work.apply({"p": Change(deleted=frame(spark, [(1, 10)], P))})
    assert work.verify("v").isEmpty()


def test_readers_between_two_writes_see_one_state(spark, work, monkeypatch):
    seen = []
    for name in ("publish", "compact"):
        real = getattr(SnapshotStore, name)

        def watch(self, *a, real=real, **k):
            reader = Workspace(spark, work.root)
            seen.append((bag(reader.view("v")), reader.table("p").count(), reader.table("c").count()))
            assert reader.verify("v").isEmpty()
            out = real(self, *a, **k)
            assert Workspace(spark, work.root).verify("v").isEmpty()
            return out

        monkeypatch.setattr(SnapshotStore, name, watch)
    work.apply({"p": Change(inserted=frame(spark, [(3, 30)], P)), "c": Change(frame(spark, [(1, 1, 0)], C), frame(spark, [(3, 1, 7)], C))})
    assert set(map(str, seen)) == {str((["(1, 10, 5)", "(2, 20, 6)"], 2, 2))}
    assert bag(work.view("v")) == ["(1, 10, None)", "(2, 20, 6)", "(3, 30, 7)"]


def test_deferred_feeds_are_applied_once_when_the_run_dies(spark, work, monkeypatch):
    feed = changes_of(None, frame(spark, [(3, 30)], P)).withColumn("seq", F.lit(1).cast("long"))
    work.defer("p", feed)
    with monkeypatch.context() as m:
        m.setattr(workspace_module.Workspace, "_close", lambda self, entry: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            work.apply_deferred()
    later = Workspace(spark, work.root)
    later.apply_deferred()
    later.apply_deferred()
    assert bag(later.view("v")) == ["(1, 10, 5)", "(2, 20, 6)", "(3, 30, None)"] and not later._files.names(f"{work.root}/deferred/p")


def test_old_versions_go_by_themselves(spark, work):
    work.keep, work.expire_every = 3, 1
    for i in range(6):
        work.apply({"p": Change(inserted=frame(spark, [(100 + i, i)], P))})
    assert len(work._files.names(f"{work.root}/tables/p/versions")) <= 4 and work.verify("v").isEmpty()


def test_a_late_change_of_a_stream_is_dropped(spark, work, tmp_path):
    folder = f"file://{tmp_path}/in"

    def send(op, before, after, seq):
        row = frame(spark, [(op, before, after, seq)], f"op string, before struct<{P.replace(' ', ':')}>, after struct<{P.replace(' ', ':')}>, seq long".replace(",:", ", "))
        row.coalesce(1).write.mode("append").parquet(folder)
        continuous.start(work, {"p": folder}, f"file://{tmp_path}/check", max_files=1).awaitTermination()

    send("U", (1, 10), (1, 13), 3)
    send("U", (1, 10), (1, 12), 2)
    send("D", (2, 20), None, 5)
    send("U", (2, 20), (2, 21), 4)
    send("U", (1, 13), (1, 14), 6)
    assert bag(work.table("p")) == ["(1, 14)"] and work.verify("v").isEmpty()


def test_of_a_late_move_only_the_late_half_is_dropped(spark, work):
    row = f"struct<{P.replace(' ', ':')}>".replace(",:", ",")
    number = iter(range(9))

    def send(op, before, after, seq):
        feed = frame(spark, [(op, before, after, seq)], f"op string, before {row}, after {row}, seq long")
        work.apply_ordered({"p": feed}, ("w", next(number)))

    send("I", None, (3, 33), 7)
    send("U", (1, 10), (3, 30), 5)  # key 3 has had 7
    assert bag(work.table("p")) == ["(2, 20)", "(3, 33)"] and work.verify("v").isEmpty()
    send("U", (2, 20), (2, 21), 9)
    send("U", (2, 20), (4, 40), 8)  # key 2 has had 9
    send("U", (3, 33), (2, 50), 6)  # both are late
    assert bag(work.table("p")) == ["(2, 21)", "(3, 33)", "(4, 40)"] and work.verify("v").isEmpty()


def test_a_clustered_table_is_read_where_the_change_is(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/k", compact_above=100)
    rows = spark.range(400)
    w.add_table("p", rows.selectExpr("cast(id as int) as id", "cast(id * 10 as int) as x"), ["id"], buckets=16)
    w.add_table("c", rows.selectExpr("cast(id % 350 as int) as pid", "cast(id as int) as n", "cast(id as int) as amt"), ["pid", "n"], buckets=16)
    w.register_view("v", SPEC)
    w.apply({"c": Change(deleted=w.table("c").where("pid in (5, 6)"))})
    w.apply({"p": Change(frame(spark, [(7, 0)], P), frame(spark, [(7, 71), (1000, 1)], P)), "c": Change(inserted=frame(spark, [(1000, 1, 1)], C))})
    assert w.verify("v").isEmpty() and w.view("v").where("id = 5 and amt is null").count() == 1
    assert w.table("c").columns == ["pid", "n", "amt"] and w.table("c").count() == 397

    wanted = frame(spark, [(9,)], "pid int").selectExpr("pid as __w")
    near = w._frame("c").near("pid", wanted, "__w")
    plan = near.meeting("c", wanted, F.expr("c.pid = __w"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan or "PartitionFilters: [(__bucket" in plan
    assert w._frame("c").near("n", wanted, "__w").base.count() == w._frame("c").base.count() > near.base.count()
    w._table("c").compact()
    assert w.table("c").count() == 397 and w.verify("v").isEmpty()


def test_large_removed_keys_are_compared_after_the_cut(spark, work):
    work = Workspace(spark, work.root, compact_above=100)
    work.apply({"c": Change(deleted=frame(spark, [(1, 1, 0)], C))})
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        from tideview.functions.expressions import keys_match, renamed

        wanted = frame(spark, [(2,)], "pid int").selectExpr(*renamed(["pid"], "__w"))
        text = work._frame("c").meeting("t", F.broadcast(wanted), F.expr(keys_match(["pid"], "__w")))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = text._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert plan.index("LeftAnti") < plan.index("LeftSemi") < plan.index("Relation")


SQL = "select p.id, p.x + 1 as y, c.amt from {p} p left join {c} c on c.pid = p.id and c.amt > 5 where p.id > 0"


def test_views_from_sql(spark, work):
    work.register_view("s", SQL)
    work.apply({"c": Change(frame(spark, [(2, 1, 0)], C), frame(spark, [(1, 5, 50)], C))})
    assert bag(work.view("s")) == ["(1, 11, 50)", "(2, 21, None)"] and work.verify("s").isEmpty()
    assert bag(Workspace(spark, work.root).view("s")) == bag(work.view("s"))


@pytest.mark.parametrize(
    "text",
    [
        "select count(*) as n from {p} p", "select p.id from {p} p order by 1", "select distinct p.id from {p} p", "select p.id from {p} p, {c} c",
        "select p.id, c.pid as id from {p} p join {c} c on c.pid = p.id", "select id from (select id from {p} p) q", "select 1 as one", "select p.id from {p}",
        "select nothing from {p} p", "select p.id from {p} p left semi join {c} c on c.pid = p.id", "select p.id from {p} p limit 3",
        "select id from {p} p join (select pid as id from {c} c) d using (id)", "select row_number() over (order by p.id) as n from {p} p",
    ],
)
def test_other_sql_is_refused(spark, work, text):
    with pytest.raises(UnsupportedView):
        work.register_view("s", text)
    assert work.views() == ["v"]


def test_sql_and_spec_are_the_same(spark):
    tables = {"p": frame(spark, [(1, 10)], P), "c": frame(spark, [(1, 1, 5)], C)}
    keys = {"p": ["id"], "c": ["pid", "n"]}
    kinds = ("inner join", "left join", "right outer join", "full join")
    spec = [view_from_sql(spark, f"select p.id from {{p}} p {k} {{c}} c on c.pid = p.id", tables, keys).tree.kind for k in kinds]
    assert spec == ["inner", "left", "right", "full"]


def test_names_that_used_to_clash(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/n")
    w.add_table("t", frame(spark, [(1, 2)], "n int, __n int"), ["n"])
    assert key_violations(frame(spark, [(1, 2), (1, 3)], "n int, x int"), ["n"]).collect() == [(1, 2)]
    tables = {"t": frame(spark, [(1, 1, 1, 1)], "k1 int, b__c int, c int, d int")}
    spec = ViewSpec({"a__b": Table("t", "c"), "a": Table("t", "b__c")}, left("a__b", "a", "a.k1 = a__b.k1"), {"d": "a.d"})
    names = bind(spec, tables).key_names()
    assert len(set(names)) == 2


def test_fields_with_odd_names(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/o")
    odd = "id int, s struct<`a-b`: int, `c``d`: array<struct<`e f`: map<string, int>>>>"
    w.add_table("p", frame(spark, [(1, (1, None)), (2, None)], odd), ["id"])
    w.add_table("c", frame(spark, [(1, 1, 5)], C), ["pid", "n"])
    w.register_view("v", ViewSpec({"c": Table("c", ["pid", "n"]), "p": Table("p", "id")}, left("c", "p", "c.pid = p.id"), {"amt": "c.amt", "s": "p.s"}))
    w.apply({"p": Change(deleted=frame(spark, [(1,)], "id int"))})
    assert bag(w.view("v")) == ["(5, None)"]


def test_remove_subsumed_reads_its_input_twice(spark, tmp_path):
    rows = [(1, 2, 3), (1, 2, None), (1, None, None), (None, 2, None), (4, None, None), (None, None, 3), (None, None, 9)]
    frame(spark, rows, "a int, b int, c int").write.parquet(f"{tmp_path}/r")
    out = remove_subsumed(spark.read.parquet(f"{tmp_path}/r"), {"a": ["a"], "b": ["b"], "c": ["c"]})
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") <= 2
    assert bag(out) == ["(1, 2, 3)", "(4, None, None)", "(None, None, 9)"]
