"""Physical plans and what a maintenance step may read."""

import re

import pytest
from pyspark.sql import functions as F

import tideview.plans.maintain as maintain_module
import tideview.plans.view as view_module
from tideview import Change, bind, build_view, frames_of
from tideview.plans.maintain import maintenance_steps
from tideview.plans.view import delta_plan, delta_rows
from tideview.samples import BUSHY3, CHAIN3, FULL2, LEFT2, LEFT3, load
from tideview.sources.tables import base_table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_of(text, table):
    """The part of a plan that describes the scan of a table."""
    return next(line for line in text.splitlines() if f"/{table}.parquet" in line and "FileScan" in line)


def test_filter_and_columns_reach_the_files(spark):
    text = plan(build_view(bind(LEFT2, load(spark, FOLDER, LEFT2))))
    lines = scan_of(text, "lineitem")
    assert "l_extendedprice" not in lines and "l_quantity" in lines
    assert "GreaterThan(o_orderkey,0)" in scan_of(text, "orders") or "o_orderkey" in scan_of(text, "orders")


@pytest.mark.parametrize("alias", ["o", "l", "p"])
def test_joins_around_a_change_are_narrowed(spark, alias):
    view = bind(LEFT3, load(spark, FOLDER, LEFT3))
    kinds = {n.aliases: k for n, k in delta_plan(view, alias).kinds.items()}
    assert kinds == {
        "o": {("o", "l"): "left", ("o", "l", "p"): "left"},
        "l": {("o", "l"): "inner", ("o", "l", "p"): "left"},
        "p": {("o", "l"): "inner", ("o", "l", "p"): "inner"},
    }[alias]


def test_change_of_a_full_join_is_narrowed(spark):
    view = bind(FULL2, load(spark, FOLDER, FULL2))
    assert list(delta_plan(view, "o").kinds.values()) == ["left"]
    assert list(delta_plan(view, "l").kinds.values()) == ["right"]


@pytest.mark.parametrize("alias,source", [("o", "orders"), ("l", "lineitem"), ("p", "part")])
def test_base_tables_are_not_shuffled_for_a_small_change(spark, staging, alias, source):
    """Large tables are filtered where they are read, by the broadcast keys of the change."""
    tables = load(spark, FOLDER, LEFT3)
    view = bind(LEFT3, tables)
    rows = staging.table(tables[source].limit(20))
    # Sizes as on a cluster: the sample tables are above the threshold, the change is not.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    spark.conf.set("spark.tideview.skewBytes", "8000")
    try:
        seen = []
        real = type(staging).table

        def record(self, df, name="t"):
            seen.append(plan(df))
            return real(self, df, name)

        type(staging).table = record
        text = plan(delta_rows(view, alias, rows, frames_of(view), staging))
    finally:
        type(staging).table = real
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.tideview.skewBytes")
    whole = "\n".join([*seen, text])
    for table in ("lineitem", "orders"):
        if f"/{table}.parquet" in whole:
            for piece in [*seen, text]:
                for match in re.finditer(rf"(.*)FileScan[^\n]*/{table}\.parquet", piece):
                    above = piece[: match.start()].splitlines()[-4:]
                    assert not any("Exchange hashpartitioning" in line for line in above), piece
    assert "NestedLoop" not in whole and "Cartesian" not in whole


@pytest.mark.parametrize("spec", [LEFT2, LEFT3, FULL2, BUSHY3, CHAIN3])
def test_maintenance_does_not_recompute(spark, staging, spec, monkeypatch):
    """Neither the view is built anew nor the stored result read."""
    tables = load(spark, FOLDER, spec)
    view = bind(spec, tables)

    def refuse(*_):
        raise AssertionError("recomputed")

    monkeypatch.setattr(view_module, "build_view", refuse)
    assert not hasattr(maintain_module, "build_view")
    rows = tables["orders"].where(F.col("o_orderpriority") == "5-LOW")
    (step,) = maintenance_steps(view, tables, {"orders": Change(deleted=rows)}, staging)
    for part in (step.removed, step.added):
        if part is not None:
            assert "NestedLoop" not in plan(part) and "Cartesian" not in plan(part)


def test_an_update_of_a_value_needs_no_look_for_orphans(spark, staging):
    """All keys have their partner again, so the tables are not read a second time."""
    tables = load(spark, FOLDER, LEFT2)
    view = bind(LEFT2, tables)
    rows = tables["lineitem"].where("l_linenumber = 2")
    change = {"lineitem": Change(rows, rows.withColumn("l_quantity", F.col("l_quantity") + 1))}
    (step,) = maintenance_steps(view, tables, change, staging)
    orphans = step.added.where("__l__l_orderkey is null")
    assert orphans.isEmpty()


def test_no_driver_side_rows_or_local_checkpoints():
    import pathlib

    root = pathlib.Path(view_module.__file__).parents[1]
    for path in root.rglob("*.py"):
        text = path.read_text()
        for word in (".collect(", ".toPandas(", "localCheckpoint", "crossJoin", ".rdd"):
            assert word not in text, f"{path}: {word}"


def test_sample_tables_are_there(spark):
    assert base_table(spark, FOLDER, "orders").count() > 0
