"""

Every maintenance query starts from the view's content in the old state and
brings it to the new state from the changed rows; the SQL is the plain view query
on the new state. A change is everything with some property (returned lines,
low-priority orders, economy parts), so it grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview import (
    Change,
    Staging,
    Workspace,
    bind,
    build_view,
    frames_of,
    maintain,
    maintain_delete,
    maintain_insert,
    maintain_update,
    matched_orphans,
    new_orphans,
    primary_delta,
    tables_after,
    visible,
)
from tideview.operators import bags, joins, terms
from tideview.operators.joins import HOT_SHARE, RANGE_BYTES, SALTS, SKEW_BYTES
from tideview.plans.view import kept
from tideview.samples import BAND2, FULL2, KEYS, LEFT2, LEFT3, SHAPES, load
from tideview.sources.changes import (
    apply_changes,
    changes_of,
    diff_snapshots,
    net_changes,
    split_changes,
)
from tideview.sources.tables import base_table, key_violations, literal_rows
from tideview.streaming import continuous

# Training-data operators and the corpus pipeline are a part that can be left out.
try:
    import corpus_pipeline
    from tideview.llm import queries as llm
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "tideview.llm"):
        raise
    corpus_pipeline = llm = None

RETURNED = "l_returnflag = 'R'"
LOW = "o_orderpriority = '5-LOW'"
HIGH = "o_orderpriority = '2-HIGH'"
URGENT = "o_orderpriority = '1-URGENT'"
ECONOMY = "p_type = 'ECONOMY'"
HOUSEHOLD = "c_mktsegment = 'HOUSEHOLD'"
NEW_KEY = 10_000_000_000  # added to a key to make one that is not in use


def _but(tables, source, condition):
    """The tables without the rows of ``source`` that meet the condition."""
    return {**tables, source: tables[source].where(f"not ({condition})")}


def _setup(spark, sf_dir, spec):
    tables = load(spark, sf_dir, spec)
    return bind(spec, tables), tables, Staging(spark)


def view_query(shape, spark, sf_dir):
    view, _, _ = _setup(spark, sf_dir, SHAPES[shape])
    return visible(view, build_view(view))


def inserted_query(shape, source, condition, spark, sf_dir):
    """Old state: without the rows that meet the condition. Change: insert them."""
    view, tables, staging = _setup(spark, sf_dir, SHAPES[shape])
    old, rows = _but(tables, source, condition), tables[source].where(condition)
    return visible(view, maintain_insert(view, build_view(view, old), old, source, rows, staging))


def deleted_query(shape, source, condition, spark, sf_dir):
    """Old state: the whole tables. Change: delete the rows that meet the condition."""
    view, tables, staging = _setup(spark, sf_dir, SHAPES[shape])
    rows = tables[source].where(condition)
    return visible(view, maintain_delete(view, build_view(view), tables, source, rows, staging))


def updated_query(condition, column, spark, sf_dir):
    """Add one to a column of the lines that meet the condition."""
    view, tables, staging = _setup(spark, sf_dir, LEFT2)
    before = tables["lineitem"].where(condition)
    after = before.withColumn(column, F.col(column) + 1)
    return visible(view, maintain_update(view, build_view(view), tables, "lineitem", before, after, staging))


def maintain_phantom_delete(spark, sf_dir):
    """Returned lines leave twice, the second time from a table that lacks them."""
    view, tables, staging = _setup(spark, sf_dir, LEFT2)
    rows = tables["lineitem"].where(RETURNED)
    once = maintain_delete(view, build_view(view), tables, "lineitem", rows, staging)
    tables = tables_after(view, tables, {"lineitem": Change(deleted=rows)})
    return visible(view, maintain_delete(view, once, tables, "lineitem", rows, staging))


def maintain_keys_only_delete(spark, sf_dir):
    """Rows that leave are given by their keys alone."""
    view, tables, staging = _setup(spark, sf_dir, FULL2)
    rows = tables["lineitem"].where(RETURNED).select(*KEYS["lineitem"])
    return visible(view, maintain_delete(view, build_view(view), tables, "lineitem", rows, staging))


def view_hot_key_full(spark, sf_dir):
    """The full join with settings by which many keys are hot and spread."""
    with _settings(spark, {SKEW_BYTES: "1", HOT_SHARE: "0.0001", SALTS: "4"}):
        return view_query("full2", spark, sf_dir)


@contextmanager
def _settings(spark, values):
    """Settings that hold while a plan is made."""
    had = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in had.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def view_band2(spark, sf_dir):
    """A left join on two inequalities by ranges of values, as for sides that are too large to broadcast."""
    with _settings(spark, {RANGE_BYTES: "0"}):
        view, _, _ = _setup(spark, sf_dir, BAND2)
        return visible(view, build_view(view))


def maintain_band2(condition, spark, sf_dir):
    """Customers leave and others enter such a view; orders that lose their last one stay alone."""
    with _settings(spark, {RANGE_BYTES: "0"}):
        view, tables, staging = _setup(spark, sf_dir, BAND2)
        go, come = (tables["customer"].where(f"c_mktsegment = '{s}'") for s in condition)
        old = _but(tables, "customer", f"c_mktsegment = '{condition[1]}'")
        change = {"customer": Change(deleted=go, inserted=come)}
        return visible(view, maintain(view, build_view(view, old), old, change, staging))


def view_sql_left3(spark, sf_dir):
    """The three-level view from SQL text, kept over a change."""
    tables = load(spark, sf_dir, LEFT3)
    work = _workspace(spark, tables, "v", LEFT2)
    work.register_view(
        "s",
        """select p.p_partkey, o.o_orderkey, p.p_name, l.l_quantity from {orders} o
        left join {lineitem} l on l.l_orderkey = o.o_orderkey
        left join {part} p on p.p_partkey = l.l_partkey where o.o_orderkey > 0""",
    )
    work.apply({"lineitem": Change(deleted=tables["lineitem"].where(RETURNED))})
    return work.view("s")


def maintain_multi(spark, sf_dir):
    """Orders and lines deleted and lines added in one batch."""
    view, tables, staging = _setup(spark, sf_dir, FULL2)
    orders, lines = tables["orders"], tables["lineitem"]
    returned = lines.where(RETURNED)
    changes = {
        "orders": Change(deleted=orders.where(LOW)),
        "lineitem": Change(returned, returned.withColumn("l_orderkey", F.col("l_orderkey") + NEW_KEY)),
    }
    return visible(view, maintain(view, build_view(view), tables, changes, staging))


def maintain_literal_rows(spark, sf_dir):
    """New orders written out in the program."""
    view, tables, staging = _setup(spark, sf_dir, LEFT2)
    rows = literal_rows(
        spark,
        [(NEW_KEY, 1, "O", 10.0, None, "5-LOW"), (NEW_KEY + 1, 2, "O", 20.0, None, None)],
        tables["orders"].schema.simpleString(),
    )
    return visible(view, maintain_insert(view, build_view(view), tables, "orders", rows, staging))


# --- changes -----------------------------------------------------------------------


def orders_feed(spark, sf_dir) -> DataFrame:
    """Low-priority orders go, high-priority ones get dearer, urgent ones are doubled."""
    orders = base_table(spark, sf_dir, "orders")
    row = F.struct(*orders.columns)
    dearer = row.withField("o_totalprice", F.col("o_totalprice") + 1)
    copy = row.withField("o_orderkey", F.col("o_orderkey") + NEW_KEY)
    op = F.expr(f"case when {LOW} then 'D' when {HIGH} then 'U' when {URGENT} then 'I' end")
    return orders.where(op.isNotNull()).select(
        op.alias("op"),
        F.when(op != "I", row).alias("before"),
        F.when(op == "U", dearer).when(op == "I", copy).alias("after"),
        F.col("o_orderkey").alias("seq"),
    )


def split_query(side, spark, sf_dir):
    return split_changes(orders_feed(spark, sf_dir))[side].select("o_orderkey", "o_totalprice")


def _changed_orders(spark, sf_dir):
    orders = base_table(spark, sf_dir, "orders")
    return orders, apply_changes(orders, *split_changes(orders_feed(spark, sf_dir)), KEYS["orders"])


def apply_changes_orders(spark, sf_dir):
    return _changed_orders(spark, sf_dir)[1].select("o_orderkey", "o_custkey", "o_totalprice")


def diff_orders(spark, sf_dir, digests=False):
    old, new = _changed_orders(spark, sf_dir)
    return diff_snapshots(old, new, KEYS["orders"], digests).select(
        "op",
        F.coalesce("before.o_orderkey", "after.o_orderkey").alias("o_orderkey"),
        F.col("before.o_totalprice").alias("old_price"),
        F.col("after.o_totalprice").alias("new_price"),
    )


def net_changes_events(spark, sf_dir):
    """Events as changes of a row per user: signups add it, errors delete it."""
    events = base_table(spark, sf_dir, "events")
    op = F.expr("case event_type when 'signup' then 'I' when 'error' then 'D' else 'U' end")
    feed = events.select(
        op.alias("op"),
        F.when(op != "I", F.struct("user_id", "value")).alias("before"),
        F.when(op != "D", F.struct("user_id", (F.col("value") + 1).alias("value"))).alias("after"),
        F.col("event_id").alias("seq"),
    )
    return net_changes(feed, ["user_id"]).select(
        "op",
        F.coalesce("before.user_id", "after.user_id").alias("user_id"),
        F.col("before.value").alias("old_value"),
        F.col("after.value").alias("new_value"),
    )


# --- row sets ------------------------------------------------------------------------


def _bags(spark, sf_dir):
    """Lines without their keys, many of them equal, and a part of them."""
    lines = base_table(spark, sf_dir, "lineitem")
    names = ["l_suppkey", "l_quantity"]
    return lines.select(*names), lines.where(f"{RETURNED} and l_linenumber = 1").select(*names)


def delete_matching(spark, sf_dir):
    return bags.delete_matching(*_bags(spark, sf_dir))


def delete_bag(spark, sf_dir):
    return bags.delete_bag(*_bags(spark, sf_dir))


def insert_rows(spark, sf_dir):
    return bags.insert_rows(*_bags(spark, sf_dir))


def matching_rows(spark, sf_dir):
    return joins.matching_rows(*_bags(spark, sf_dir))


def delete_where_exists(spark, sf_dir):
    lines, delta = _bags(spark, sf_dir)
    return bags.delete_where_exists(lines, delta.where("l_quantity > 40"), ["l_suppkey"])


def restrict_keys(spark, sf_dir):
    wanted = base_table(spark, sf_dir, "lineitem").where(RETURNED).withColumnRenamed("l_orderkey", "o_orderkey")
    orders = base_table(spark, sf_dir, "orders")
    return joins.restrict_to_keys(orders, wanted, ["o_orderkey"]).select("o_orderkey", "o_custkey")


def key_violations_lineitem(spark, sf_dir):
    return key_violations(base_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- deltas ----------------------------------------------------------------------------


def primary_delta_query(alias, source, condition, spark, sf_dir):
    view, tables, staging = _setup(spark, sf_dir, FULL2)
    rows = staging.table(tables[source].where(condition))
    return visible(view, primary_delta(view, alias, rows, frames_of(view), staging))


def new_orphans_query(spark, sf_dir):
    """Orders that are left without lines."""
    view, tables, staging = _setup(spark, sf_dir, LEFT2)
    rows = staging.table(tables["lineitem"].where(RETURNED))
    delta = staging.table(primary_delta(view, "l", rows, frames_of(view), staging))
    after = apply_changes(tables["lineitem"], rows, None, KEYS["lineitem"])
    orphans = new_orphans(view, "l", delta, frames_of(view, {**tables, "lineitem": after}), staging)
    return visible(view, kept(orphans))


def matched_orphans_query(spark, sf_dir):
    """Orders that had no lines and get some."""
    view, tables, staging = _setup(spark, sf_dir, LEFT2)
    old = _but(tables, "lineitem", RETURNED)
    rows = staging.table(tables["lineitem"].where(RETURNED))
    delta = staging.table(primary_delta(view, "l", rows, frames_of(view, old), staging))
    return visible(view, matched_orphans(view, "l", delta, build_view(view, old)))


def null_variants(spark, sf_dir):
    """Each row of the three-level view, without its part, and without line and part."""
    view, _, _ = _setup(spark, sf_dir, LEFT3)
    rows = visible(view, build_view(view))
    columns = {"p": ["p_partkey", "p_name"], "l": ["l_quantity"]}
    return terms.null_variants(rows, columns, [{"p"}, {"l", "p"}], include_row=True)


def null_by_flag(spark, sf_dir):
    view, _, _ = _setup(spark, sf_dir, LEFT3)
    rows = visible(view, build_view(view))
    columns = {"p": ["p_partkey", "p_name"], "l": ["l_quantity"]}
    flags = {"p": F.expr("l_quantity > 25"), "l": F.expr("l_quantity > 40")}
    flags = {t: F.coalesce(f, F.lit(False)) for t, f in flags.items()}
    return terms.null_by_flag(rows, columns, flags)


def _full2_without_low(spark, sf_dir):
    view, tables, staging = _setup(spark, sf_dir, FULL2)
    rows = tables["orders"].where(LOW)
    return view, maintain_delete(view, build_view(view), tables, "orders", rows, staging)


def term_profile(spark, sf_dir):
    view, stored = _full2_without_low(spark, sf_dir)
    return terms.term_profile(stored, terms.view_keys(view))


def predicate_null_profile(spark, sf_dir):
    view, _, _ = _setup(spark, sf_dir, LEFT2)
    return terms.predicate_null_profile(view, frames_of(view))


def remove_subsumed(spark, sf_dir):
    """The full join put together from the inner join and both tables."""
    orders = base_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = base_table(spark, sf_dir, "lineitem").select(*KEYS["lineitem"], "l_quantity")
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_quantity") > 10)
    union = orders.join(lines, on, "inner")
    for part in (orders, lines):
        union = union.unionByName(part, allowMissingColumns=True)
    keys = {"o": KEYS["orders"], "l": KEYS["lineitem"]}
    return terms.remove_subsumed(union, keys).select("o_orderkey", "o_totalprice", "l_orderkey", "l_quantity")


def verify_clean(spark, sf_dir):
    view, stored = _full2_without_low(spark, sf_dir)
    now = tables_after(
        view, view.schemas, {"orders": Change(deleted=view.schemas["orders"].where(LOW))}
    )
    return bags.verify_view(visible(view, stored), visible(view, build_view(view, now)))


def verify_broken(spark, sf_dir, digests=False):
    """A view that was not told that the returned lines are gone."""
    view, tables, _ = _setup(spark, sf_dir, LEFT2)
    now = _but(tables, "lineitem", RETURNED)
    return bags.verify_view(visible(view, build_view(view)), visible(view, build_view(view, now)), digests)


# --- stored views ------------------------------------------------------------------------


def _workspace(spark, tables, name, spec) -> Workspace:
    work = Workspace(spark, Staging(spark).path + "-work")
    for source, rows in tables.items():
        work.add_table(source, rows, KEYS[source])
    work.register_view(name, spec)
    return work


def _returned_feeds(tables):
    """Returned lines go; low-priority orders go; high-priority ones get dearer twice,
    urgent ones come, get dearer and go again."""
    lines, orders = tables["lineitem"], tables["orders"]
    gone = changes_of(lines.where(RETURNED), None).withColumn("seq", F.lit(1).cast("bigint"))
    row = F.struct(*orders.columns)
    price = F.col("o_totalprice")
    dearer = lambda by: row.withField("o_totalprice", price + by)
    copy = row.withField("o_orderkey", F.col("o_orderkey") + NEW_KEY)
    none = F.lit(None).cast(orders.schema)
    step = lambda seq, op, before, after: F.struct(
        F.lit(op).alias("op"),
        before.cast(orders.schema).alias("before"),
        after.cast(orders.schema).alias("after"),
        F.lit(seq).cast("bigint").alias("seq"),
    )
    steps = F.expr(f"case when {LOW} then 1 when {HIGH} then 2 when {URGENT} then 3 end")
    history = (
        F.when(steps == 1, F.array(step(1, "D", row, none)))
        .when(steps == 2, F.array(step(1, "U", row, dearer(1)), step(2, "U", dearer(1), dearer(2))))
        .when(
            steps == 3,
            F.array(step(1, "I", none, copy), step(2, "U", copy, copy), step(3, "D", copy, none)),
        )
    )
    changed = orders.where(steps.isNotNull()).select(F.explode(history).alias("h")).select("h.*")
    return {"lineitem": gone, "orders": changed}


TOTAL_LINES = {**LEFT2.select, "o_totalprice": "o.o_totalprice"}


def _total_lines():
    return type(LEFT2)(LEFT2.tables, LEFT2.tree, TOTAL_LINES, LEFT2.where)


def deferred_refresh(spark, sf_dir):
    """Three feeds put aside, then folded and applied at once; the first run dies in between."""
    spec = _total_lines()
    tables = load(spark, sf_dir, spec)
    work = _workspace(spark, tables, "v", spec)
    feeds = _returned_feeds(tables)
    work.defer("lineitem", feeds["lineitem"])
    work.defer("orders", feeds["orders"].where("seq = 1"))
    work.defer("orders", feeds["orders"].where("seq > 1"))

    def dies(entry):
        raise RuntimeError("lost before the feeds were forgotten")

    work._close = dies
    try:
        work.apply_deferred()
    except RuntimeError:
        work = Workspace(spark, work.root)
    work.apply_deferred()
    return work.view("v")


def stored_view(spark, sf_dir):
    """Create, change twice, compact, drop old versions; a second view is dropped."""
    tables = load(spark, sf_dir, LEFT3)
    work = _workspace(spark, tables, "v", LEFT3)
    work.register_view("gone", LEFT2)
    work.apply({"lineitem": Change(deleted=tables["lineitem"].where(RETURNED))})
    work.drop_view("gone")
    work.apply({"part": Change(deleted=tables["part"].where(ECONOMY))})
    work.expire()
    return work.view("v")


def view_after_drop(spark, sf_dir):
    """A view is dropped and its name given to another one, which is kept over a change."""
    tables = load(spark, sf_dir, LEFT3)
    work = _workspace(spark, tables, "v", LEFT2)
    work.drop_view("v")
    work.register_view("v", LEFT3)
    work.apply({"part": Change(deleted=tables["part"].where(ECONOMY))})
    return work.view("v")


def verify_counts(spark, sf_dir):
    """How many rows the check finds wrong in a maintained view, and in one with rows missing and too many."""
    tables = load(spark, sf_dir, LEFT2)
    work = _workspace(spark, tables, "v", LEFT2)
    work.apply({"lineitem": Change(deleted=tables["lineitem"].where(RETURNED))})
    right, broken = work.view("v"), work.view("v").where("l_quantity <= 40 or l_quantity is null")
    broken = broken.unionByName(right.where("l_quantity = 1"))
    wrong = bags.verify_view(broken, right).groupBy("problem").agg(F.count("*").alias("n"))
    return wrong.unionByName(work.verify("v").agg(F.lit("none").alias("problem"), F.count("*").alias("n")))


def full_refresh(spark, sf_dir):
    """A view that cannot be maintained is renewed as a whole after a change."""
    tables = load(spark, sf_dir, LEFT2)
    work = _workspace(spark, tables, "v", LEFT2)
    work.register_query(
        "q", "select l_suppkey, count(*) as n, sum(l_quantity) as quantity from {lineitem} group by l_suppkey"
    )
    work.apply({"lineitem": Change(deleted=tables["lineitem"].where(RETURNED))})
    return work.view("q")


def stream_maintain(spark, sf_dir):
    """Change files taken in by a stream in four micro-batches, the last with older changes."""
    spec = _total_lines()
    tables = load(spark, sf_dir, spec)
    work = _workspace(spark, tables, "v", spec)
    folders = {s: f"{work.root}/incoming/{s}" for s in tables}
    feeds = _returned_feeds(tables)
    feeds["lineitem"].repartition(2).write.parquet(folders["lineitem"])
    checkpoint = f"{work.root}/checkpoint"
    for seq in (2, 3, 1):
        feeds["orders"].where(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(folders["orders"])
        continuous.start(work, folders, checkpoint, max_files=1).awaitTermination()
    return work.view("v")


# --- contract ------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """The two-level view after the returned lines come in."""
    return inserted_query("left2", "lineitem", RETURNED, spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        f"view_{shape}": partial(view_query, shape) for shape in SHAPES
    }
    lines = ("lineitem", RETURNED)
    for shape in ("left2", "left3", "full2", "right2", "inner2", "bushy3"):
        out[f"maintain_insert_child_{shape}"] = partial(inserted_query, shape, *lines)
    for shape in ("left2", "left3", "full2", "inner2", "bushy3"):
        out[f"maintain_delete_child_{shape}"] = partial(deleted_query, shape, *lines)
    for shape in ("left2", "full2", "chain3"):
        out[f"maintain_insert_root_{shape}"] = partial(inserted_query, shape, "orders", LOW)
        out[f"maintain_delete_root_{shape}"] = partial(deleted_query, shape, "orders", LOW)
    out |= {
        "maintain_insert_leaf3": partial(inserted_query, "left3", "part", ECONOMY),
        "maintain_delete_leaf3": partial(deleted_query, "left3", "part", ECONOMY),
        "maintain_delete_middle3": partial(deleted_query, "chain3", "customer", HOUSEHOLD),
        "maintain_insert_middle3": partial(inserted_query, "chain3", "customer", HOUSEHOLD),
        "maintain_self_join": partial(deleted_query, "self2", "part", "p_brand like 'Brand#1%'"),
        "maintain_theta": partial(inserted_query, "theta2", "supplier", "s_acctbal > 5000"),
        "maintain_update_value": partial(updated_query, "l_linenumber = 2", "l_quantity"),
        "maintain_update_parent": partial(updated_query, "l_linenumber = 3", "l_orderkey"),
        "maintain_insert_mixed_on": partial(inserted_query, "mixed_on", *lines),
        "maintain_phantom_delete": maintain_phantom_delete,
        "maintain_keys_only_delete": maintain_keys_only_delete,
        "view_hot_key_full": view_hot_key_full,
        "view_band2": view_band2,
        "maintain_band2": partial(maintain_band2, ("BUILDING", "MACHINERY")),
        "view_sql_left3": view_sql_left3,
        "maintain_multi": maintain_multi,
        "maintain_literal_rows": maintain_literal_rows,
        "split_deleted": partial(split_query, 0),
        "split_inserted": partial(split_query, 1),
        "apply_changes_orders": apply_changes_orders,
        "diff_orders": diff_orders,
        "diff_orders_digests": partial(diff_orders, digests=True),
        "net_changes_events": net_changes_events,
        "key_violations": key_violations_lineitem,
        "delete_matching": delete_matching,
        "delete_bag": delete_bag,
        "insert_rows": insert_rows,
        "matching_rows": matching_rows,
        "delete_where_exists": delete_where_exists,
        "restrict_keys": restrict_keys,
        "primary_delta_insert": partial(primary_delta_query, "l", *lines),
        "primary_delta_delete": partial(primary_delta_query, "o", "orders", LOW),
        "new_orphans": new_orphans_query,
        "matched_orphans": matched_orphans_query,
        "null_variants": null_variants,
        "null_by_flag": null_by_flag,
        "term_profile": term_profile,
        "predicate_null_profile": predicate_null_profile,
        "remove_subsumed": remove_subsumed,
        "verify_clean": verify_clean,
        "verify_broken": verify_broken,
        "verify_broken_digests": partial(verify_broken, digests=True),
        "deferred_refresh": deferred_refresh,
        "stored_view": stored_view,
        "view_after_drop": view_after_drop,
        "verify_counts": verify_counts,
        "full_refresh": full_refresh,
        "stream_maintain": stream_maintain,
    }
    if llm:
        out |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return out


def _shape_sql(shape: str, **tables: str) -> str:
    """The plain SQL of a view; ``tables`` replaces tables by subqueries."""
    t = {n: n for n in ("orders", "lineitem", "part", "customer", "nation", "supplier")} | tables
    lines = "o.o_orderkey, l.l_partkey, l.l_quantity"
    order = "l.l_orderkey = o.o_orderkey"
    large = f"{order} and l.l_quantity > 10"
    return {
        "left2": f"select {lines} from {t['orders']} o left join {t['lineitem']} l on {order} where o.o_orderkey > 0",
        "left3": f"""select p.p_partkey, o.o_orderkey, p.p_name, l.l_quantity
            from {t['orders']} o left join {t['lineitem']} l on {order}
            left join {t['part']} p on p.p_partkey = l.l_partkey where o.o_orderkey > 0""",
        "full2": f"""select {lines}, l.l_orderkey
            from {t['orders']} o full join {t['lineitem']} l on {large}""",
        "right2": f"select {lines} from {t['lineitem']} l right join {t['orders']} o on {order}",
        "inner2": f"select {lines} from {t['orders']} o join {t['lineitem']} l on {order}",
        "bushy3": f"""select c.c_custkey, c.c_name, {lines} from {t['customer']} c
            left join ({t['orders']} o join {t['lineitem']} l on {order}) on c.c_custkey = o.o_custkey""",
        "chain3": f"""select n.n_name, c.c_custkey, o.o_orderkey, o.o_totalprice from {t['nation']} n
            left join {t['customer']} c on n.n_nationkey = c.c_nationkey
            left join {t['orders']} o on c.c_custkey = o.o_custkey""",
        "theta2": f"""select s.s_suppkey, n.n_name from {t['supplier']} s
            left join {t['nation']} n on n.n_nationkey < s.s_nationkey""",
        "band2": f"""select o.o_orderkey, o.o_totalprice, c.c_custkey, c.c_acctbal from {t['orders']} o left join {t['customer']} c
            on c.c_acctbal < o.o_totalprice / 50 + 1 and c.c_acctbal > o.o_totalprice / 50 - 1""",
        "self2": f"""select p.p_partkey, q.p_partkey as next_partkey, q.p_name as next_name
            from {t['part']} p full join {t['part']} q
            on p.p_partkey + 1 = q.p_partkey and p.p_type = q.p_type""",
        "mixed_on": f"""select {lines} from {t['orders']} o left join {t['lineitem']} l
            on {order} and l.l_quantity > 10 and l.l_tax < 0.07""",
    }[shape]


def _rows_but(table: str, condition: str) -> str:
    return f"(select * from {table} where not ({condition}))"


def oracle_sql() -> dict[str, str]:
    view = {shape: _shape_sql(shape) for shape in SHAPES}
    out = {f"view_{shape}": sql for shape, sql in view.items()}
    lines_left = _rows_but("lineitem", RETURNED)
    orders_left = _rows_but("orders", LOW)
    for shape in ("left2", "left3", "full2", "right2", "inner2", "bushy3"):
        out[f"maintain_insert_child_{shape}"] = view[shape]
    for shape in ("left2", "left3", "full2", "inner2", "bushy3"):
        out[f"maintain_delete_child_{shape}"] = _shape_sql(shape, lineitem=lines_left)
    for shape in ("left2", "full2", "chain3"):
        out[f"maintain_insert_root_{shape}"] = view[shape]
        out[f"maintain_delete_root_{shape}"] = _shape_sql(shape, orders=orders_left)

    def lines_with(column, condition):
        changed = f"case when {condition} then {column} + 1 else {column} end as {column}"
        return f"(select * replace ({changed}) from lineitem)"

    moved = f"""(select * replace
        (case when {RETURNED} then l_orderkey + {NEW_KEY} else l_orderkey end as l_orderkey) from lineitem)"""
    changed_orders = f"""(
        select o_orderkey, o_custkey,
            case when {HIGH} then o_totalprice + 1 else o_totalprice end as o_totalprice
        from orders where not ({LOW})
        union all select o_orderkey + {NEW_KEY}, o_custkey, o_totalprice from orders where {URGENT})"""
    bag = "select l_suppkey, l_quantity from lineitem"
    part_of_bag = f"{bag} where {RETURNED} and l_linenumber = 1"
    same = "d.l_suppkey is not distinct from a.l_suppkey and d.l_quantity is not distinct from a.l_quantity"
    left3 = view["left3"]
    final = _shape_sql(
        "left2",
        lineitem=lines_left,
        orders=f"""(select * replace (case when {HIGH} then o_totalprice + 2 else o_totalprice end as o_totalprice)
            from orders where not ({LOW}))""",
    ).replace("l.l_quantity from", "l.l_quantity, o.o_totalprice from")
    before = _shape_sql("left2")
    after = _shape_sql("left2", lineitem=lines_left)
    orphans = f"""select o_orderkey, null::bigint as l_partkey, null::double as l_quantity from orders
        where o_orderkey > 0 and o_orderkey in (select l_orderkey from lineitem where {RETURNED})
        and o_orderkey not in (select l_orderkey from {lines_left})"""
    label = "concat_ws('+', case when o_orderkey is not null then 'o' end, case when l_orderkey is not null then 'l' end)"
    out |= {
        "maintain_insert_leaf3": left3,
        "maintain_delete_leaf3": _shape_sql("left3", part=_rows_but("part", ECONOMY)),
        "maintain_delete_middle3": _shape_sql("chain3", customer=_rows_but("customer", HOUSEHOLD)),
        "maintain_insert_middle3": view["chain3"],
        "maintain_self_join": _shape_sql("self2", part=_rows_but("part", "p_brand like 'Brand#1%'")),
        "maintain_theta": view["theta2"],
        "maintain_update_value": _shape_sql("left2", lineitem=lines_with("l_quantity", "l_linenumber = 2")),
        "maintain_update_parent": _shape_sql("left2", lineitem=lines_with("l_orderkey", "l_linenumber = 3")),
        "maintain_insert_mixed_on": view["mixed_on"],
        "maintain_phantom_delete": _shape_sql("left2", lineitem=lines_left),
        "maintain_keys_only_delete": _shape_sql("full2", lineitem=lines_left),
        "view_hot_key_full": view["full2"],
        "view_band2": _shape_sql("band2"),
        "maintain_band2": _shape_sql("band2", customer=_rows_but("customer", "c_mktsegment = 'BUILDING'")),
        "view_sql_left3": _shape_sql("left3", lineitem=lines_left),
        "maintain_multi": _shape_sql("full2", orders=orders_left, lineitem=moved),
        "maintain_literal_rows": f"""{before}
            union all select k, null, null from (values ({NEW_KEY}), ({NEW_KEY + 1})) t(k)""",
        "split_deleted": f"select o_orderkey, o_totalprice from orders where {LOW} or {HIGH}",
        "split_inserted": f"""select o_orderkey, o_totalprice + 1 as o_totalprice from orders where {HIGH}
            union all select o_orderkey + {NEW_KEY}, o_totalprice from orders where {URGENT}""",
        "apply_changes_orders": f"select * from {changed_orders}",
        "diff_orders": f"""select case when a.o_orderkey is null then 'I' when b.o_orderkey is null then 'D' else 'U' end as op,
            coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, a.o_totalprice as old_price, b.o_totalprice as new_price
            from orders a full join {changed_orders} b on a.o_orderkey = b.o_orderkey
            where a.o_totalprice is distinct from b.o_totalprice or a.o_custkey is distinct from b.o_custkey""",
        "net_changes_events": """with e as (select *,
                row_number() over (partition by user_id order by event_id) as first,
                row_number() over (partition by user_id order by event_id desc) as last from events),
            n as (select user_id,
                max(case when first = 1 and event_type <> 'signup' then value end) as old_value,
                max(case when last = 1 and event_type <> 'error' then value + 1 end) as new_value
                from e group by user_id)
            select case when old_value is null then 'I' when new_value is null then 'D' else 'U' end as op,
                user_id, old_value, new_value from n where old_value is distinct from new_value""",
        "key_violations": """select l_orderkey, l_linenumber, count(*) as n from lineitem
            group by l_orderkey, l_linenumber having count(*) > 1""",
        "delete_matching": f"select * from ({bag}) a where not exists (select 1 from ({part_of_bag}) d where {same})",
        "delete_bag": f"({bag}) except all ({part_of_bag})",
        "insert_rows": f"({bag}) union all ({part_of_bag})",
        "matching_rows": f"select * from ({bag}) a where exists (select 1 from ({part_of_bag}) d where {same})",
        "delete_where_exists": f"""select * from ({bag}) a where l_suppkey not in
            (select l_suppkey from ({part_of_bag}) d where l_quantity > 40)""",
        "restrict_keys": f"""select o_orderkey, o_custkey from orders where exists
            (select 1 from lineitem where l_orderkey = o_orderkey and {RETURNED})""",
        "primary_delta_insert": f"""select o_orderkey, l_partkey, l_quantity, l_orderkey from orders
            right join (select * from lineitem where {RETURNED}) on l_orderkey = o_orderkey and l_quantity > 10""",
        "primary_delta_delete": f"""select o_orderkey, l_partkey, l_quantity, l_orderkey
            from (select * from orders where {LOW})
            left join lineitem on l_orderkey = o_orderkey and l_quantity > 10""",
        "new_orphans": orphans,
        "matched_orphans": orphans,
        "null_variants": f"""with v as ({left3}) select * from v
            union all select null, o_orderkey, null, l_quantity from v
            union all select null, o_orderkey, null, null from v""",
        "null_by_flag": f"""select case when l_quantity > 25 then null else p_partkey end as p_partkey, o_orderkey,
            case when l_quantity > 25 then null else p_name end as p_name,
            case when l_quantity > 40 then null else l_quantity end as l_quantity from ({left3})""",
        "term_profile": f"""select {label} as term, count(*) as n
            from ({_shape_sql('full2', orders=orders_left)}) group by 1""",
        "predicate_null_profile": f"""select {label} as term, count(*) as n, count(*) filter (where o_orderkey > 0) as n_kept
            from orders left join lineitem on l_orderkey = o_orderkey group by 1""",
        "remove_subsumed": """select o_orderkey, o_totalprice, l_orderkey, l_quantity
            from orders full join lineitem on l_orderkey = o_orderkey and l_quantity > 10""",
        "verify_clean": "select o_orderkey, l_partkey, l_quantity, l_orderkey, 'x' as problem from "
        "orders join lineitem on false",
        "verify_broken": f"""select *, 'missing' as problem from (({after}) except all ({before}))
            union all select *, 'stale' as problem from (({before}) except all ({after}))""",
        "deferred_refresh": final,
        "stored_view": _shape_sql("left3", lineitem=lines_left, part=_rows_but("part", ECONOMY)),
        "view_after_drop": _shape_sql("left3", part=_rows_but("part", ECONOMY)),
        "verify_counts": f"""with v as ({_shape_sql("left2", lineitem=lines_left)})
            select 'missing' as problem, count(*) as n from v where l_quantity > 40
            union all select 'stale', count(*) from v where l_quantity = 1
            union all select 'none', 0""",
        "full_refresh": f"""select l_suppkey, count(*) as n, sum(l_quantity) as quantity
            from {lines_left} group by l_suppkey""",
        "stream_maintain": final,
    }
    out |= {f"{name}_digests": out[name] for name in ("diff_orders", "verify_broken")}
    if llm:
        out |= llm.oracle_sql()
    return out
