"""What maintenance shuffles and writes beside what it needs: keys, not whole rows."""

import pytest
from conftest import assert_same_bag

from tideview import Change, Join, Table, ViewSpec, bind, build_view, left, maintain
from tideview.plans.maintain import maintenance_steps
from tideview.plans.view import visible
from tideview.sources.storage import Files

TABLES = {"p": Table("p", "id"), "c": Table("c", ["pid", "n"])}
SELECT = {"x": "p.x", "amt": "c.amt", "pid": "c.pid"}


@pytest.fixture
def tables(spark):
    return {
        "p": spark.createDataFrame([(i, i * 10) for i in range(1, 7)], "id int, x int"),
        "c": spark.createDataFrame(
            [(1, 1, 5), (1, 2, 6), (2, 1, 7), (2, 2, 1), (3, 1, 9), (3, 1, 9), (4, 1, 2), (9, 1, 8), (None, 1, 8)],
            "pid long, n int, amt int",
        ),
    }


def staged(spark, staging, name):
    (folder,) = [n for n in Files(spark).names(staging.path) if n.endswith(name)]
    return spark.read.parquet(f"{staging.path}/{folder}")


@pytest.mark.parametrize("kind", ["left", "full"])
@pytest.mark.parametrize("gone", [[(1, 1)], [(1, 1), (1, 2)], [(2, 1)], [(3, 1), (9, 1)], [(4, 1), (77, 1), (None, 1)]])
def test_orphans_are_told_by_counts_of_the_join_columns(spark, tables, staging, kind, gone):
    view = bind(ViewSpec(TABLES, Join(kind, "p", "c", ("c.pid = p.id", "c.amt > 1")), SELECT), tables)
    rows = spark.createDataFrame(gone, "pid long, n int")
    got = maintain(view, build_view(view), tables, {"c": Change(deleted=rows)}, staging)
    left_over = tables["c"].join(rows, ["pid", "n"], "left_anti").select("pid", "n", "amt")
    assert_same_bag(visible(view, got), visible(view, build_view(view, {**tables, "c": left_over})))


def test_orphans_of_a_change_that_moves_rows(spark, tables, staging):
    view = bind(ViewSpec(TABLES, left("p", "c", ("c.pid = p.id", "c.amt > 1")), SELECT), tables)
    go = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (4, 1, 2)], "pid long, n int, amt int")
    come = spark.createDataFrame([(4, 1, 3), (5, 1, 4), (1, 1, 0)], "pid long, n int, amt int")
    got = maintain(view, build_view(view), tables, {"c": Change(go, come)}, staging)
    now = tables["c"].join(go.select("pid", "n"), ["pid", "n"], "left_anti").select("pid", "n", "amt").union(come)
    assert_same_bag(visible(view, got), visible(view, build_view(view, {**tables, "c": now})))


def test_rows_that_leave_are_written_without_the_select_list(spark, tables, staging):
    view = bind(ViewSpec(TABLES, Join("full", "p", "c", ("c.pid = p.id",)), SELECT), tables)
    rows = tables["c"].where("amt > 5")
    maintain(view, build_view(view), tables, {"c": Change(deleted=rows)}, staging)
    assert set(staged(spark, staging, "delta-c").columns) == {"__p__id", "__c__pid", "__enters"}


def test_steps_to_publish_name_all_keys(spark, tables, staging):
    view = bind(ViewSpec(TABLES, Join("full", "p", "c", ("c.pid = p.id",)), SELECT), tables)
    (step,) = maintenance_steps(view, tables, {"c": Change(deleted=tables["c"].where("n = 2"))}, staging)
    assert sorted(map(tuple, step.removed.select("__p__id", "__c__pid", "__c__n").collect())) == [(1, 1, 2), (2, 2, 2)]
    assert not set(view.outputs) & set(staged(spark, staging, "delta-c").columns)
