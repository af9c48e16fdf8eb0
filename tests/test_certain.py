"""Orphans that the delta alone decides: their partner was the only one."""

import pytest
from conftest import bag

from tideview import Change, Join, Table, ViewSpec, bind, build_view, left, maintain, view_from_sql
from tideview.plans import maintain as steps

P = "id int, x int, name string"
C = "pid int, n int, amt int"
TABLES = {"p": Table("p", "id"), "c": Table("c", ["pid", "n"])}
FULL = ViewSpec(TABLES, Join("full", "p", "c", ("c.pid = p.id",)), {"x": "p.x", "p": "p.name", "s": "coalesce(p.x, 0) + c.amt"}, "c.amt > 5 or p.x > 0")


@pytest.fixture
def tables(spark):
    return {
        "p": spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, None, None)], P),
        "c": spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7), (9, 1, 8)], C),
    }


def test_a_key_that_an_on_equates_is_the_only_partner(tables):
    view = bind(FULL, tables)
    assert view.certain_terms("p") == [frozenset("c")]  # a child has one parent
    assert view.certain_terms("c") == []  # a parent has many children
    both = bind(ViewSpec(TABLES, left("p", "c", "c.pid = p.id and c.n = p.x"), {"x": "p.x"}), tables)
    assert both.certain_terms("c") == [frozenset("p")]


def test_what_a_conversion_makes_equal_is_not_the_key(spark, tables):
    texts = {**tables, "p": tables["p"].selectExpr("cast(id as string) as id", "x", "name")}
    assert bind(FULL, texts).certain_terms("p") == []
    doubles = {**tables, "p": tables["p"].selectExpr("cast(id as double) as id", "x", "name")}
    assert bind(FULL, doubles).certain_terms("p") == []
    longs = {**tables, "p": tables["p"].selectExpr("cast(id as bigint) as id", "x", "name")}
    assert bind(FULL, longs).certain_terms("p") == [frozenset("c")]


def test_columns_without_their_alias_are_looked_up(tables):
    spec = ViewSpec(TABLES, FULL.tree, {"x": "x", "s": "amt"}, "amt > 5")
    assert bind(spec, tables).certain_terms("p") == []
    other = ViewSpec({"x": TABLES["p"], "c": TABLES["c"]}, Join("full", "x", "c", ("c.pid = x.id",)), {"o": "x", "i": "x.id"})
    assert bind(other, tables).certain_terms("x") == []  # an alias of a column's name


def no_tables(monkeypatch):
    real = steps.new_orphans

    def new_orphans(view, alias, delta, frames, staging, covered=None, certain=()):
        assert set(certain) == set(view.anchors(alias))
        return real(view, alias, delta, {}, staging, covered, certain)  # has no table to look at

    monkeypatch.setattr(steps, "new_orphans", new_orphans)


def test_a_delete_does_not_look_at_the_tables_again(spark, tables, staging, monkeypatch):
    no_tables(monkeypatch)
    view = bind(FULL, tables)
    gone = spark.createDataFrame([(1, 0, ""), (3, 0, ""), (77, 0, "")], P)
    after = maintain(view, staging.table(build_view(view)), tables, {"p": Change(deleted=gone)}, staging)
    # WHERE and the select list are those of the row without its parent: 5 goes, 6 stays.
    assert bag(after.select("x", "p", "s")) == ["(20, 'b', 27)", "(None, None, 6)", "(None, None, 8)"]


def test_an_update_keeps_what_finds_its_partner_again(spark, tables, staging, monkeypatch):
    no_tables(monkeypatch)
    view = bind(FULL, tables)
    old, new = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], P), spark.createDataFrame([(1, 11, "z"), (4, 20, "b")], P)
    after = maintain(view, staging.table(build_view(view)), tables, {"p": Change(old, new)}, staging)
    assert bag(after.select("x", "p", "s")) == ["(11, 'z', 16)", "(11, 'z', 17)", "(20, 'b', None)", "(None, None, 7)", "(None, None, 8)"]


def test_a_tuple_that_went_in_several_rows_comes_once(spark, tables, staging):
    tables = {**tables, "g": spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "pid int, k int, y int")}
    spec = ViewSpec(
        {**TABLES, "g": Table("g", ["pid", "k"])}, left("c", left("p", "g", "g.pid = p.id"), "c.pid = p.id"), {"amt": "c.amt", "y": "g.y"}
    )
    view = bind(spec, tables)
    assert view.certain_terms("p") == [frozenset("c")]
    gone = spark.createDataFrame([(1, 0, "")], P)
    after = maintain(view, staging.table(build_view(view)), tables, {"p": Change(deleted=gone)}, staging)
    assert bag(after.select("amt", "y")) == ["(5, None)", "(6, None)", "(7, None)", "(8, None)"]


def test_names_that_need_quotes_and_only_the_columns_shown(spark, staging):
    odd = spark.createDataFrame([(1, 10, "long")], "`a.id` int, `it's` int, unread string")
    tables = {"p": odd, "c": spark.createDataFrame([(1, 1, 5)], C)}
    spec = ViewSpec({"p": Table("p", "a.id"), "c": TABLES["c"]}, Join("full", "p", "c", (("c.pid", "p.`a.id`"),)), {"v": "p.`it's`", "a": "c.amt"})
    view = bind(spec, tables)
    assert list(view.shown_columns["p"].names) == ["it's"] and list(view.shown_columns["c"].names) == ["amt"]
    after = maintain(view, staging.table(build_view(view)), tables, {"p": Change(deleted=odd)}, staging)
    assert bag(after.select("v", "a")) == ["(None, 5)"]


def test_a_view_from_sql(spark, tables, staging):
    spec = view_from_sql(spark, "select p.x, c.amt from {c} c left join {p} p on p.id = c.pid", tables, {"p": ["id"], "c": ["pid", "n"]})
    view = bind(spec, tables)
    (name,) = [a for a in view.aliases if view.source(a) == "p"]
    assert len(view.certain_terms(name)) == 1
