"""Base tables and the views kept over them, in one folder.

    work = Workspace(spark, "s3://…/work")
    work.add_table("orders", orders, ["o_orderkey"])
    work.add_table("lineitem", lineitem, [...])
    work.register_view("order_lines", spec)
    work.apply({"lineitem": Change(inserted=rows)})
    work.view("order_lines")
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import cols, keys_match, quoted, renamed
from tideview.operators.bags import verify_view
from tideview.operators.joins import distinct_if_large
from tideview.plans.maintain import Change, columns_read, maintenance_steps, stage_change, with_own_images
from tideview.plans.spec import UnsupportedView, View, ViewSpec, bind
from tideview.plans.sqlview import view_from_sql
from tideview.plans.view import Frame, build_view, visible
from tideview.sources.changes import BadChange, as_table_rows, net_changes, refused_inserts, split_changes
from tideview.sources.sequences import SequenceLog
from tideview.sources.snapshots import Batch, Cluster, SnapshotStore, Step
from tideview.sources.storage import Files, Staging, plan_bytes
from tideview.sources.tables import key_violations, keys_look_sound

# Writer name of batches that the caller does not number.
_OWN = "workspace"


class Workspace:
    """Keeps tables, views, and changes put off for later, below ``root``."""

    def __init__(
        self, spark: SparkSession, root: str, compact_above: float = 0.2, keep: int = 10, expire_every: int = 10
    ):
        """``keep`` versions of each store stay when old ones are dropped, about every ``expire_every`` batches."""
        self.spark = spark
        self.keep, self.expire_every = keep, expire_every
        self.root = root.rstrip("/")
        self.compact_above = compact_above
        self._files = Files(spark)
        self._bound: dict[str, View] = {}
        # Else a hot key stays in one task where the next join uses the same key.
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")

    # --- tables ------------------------------------------------------------------

    def add_table(
        self, name: str, rows: DataFrame, keys: Sequence[str], check: bool = True, buckets: int | None = None
    ) -> None:
        """Take over a base table. Its keys must be unique and not NULL.

        A large table is kept in buckets by its first key column (one for each 64 MB, 1024 at most,
        unless ``buckets`` says how many), so that maintenance reads those a change can meet.
        """
        if buckets is None:
            buckets = min(1024, plan_bytes(rows) // (64 << 20))
        cluster = Cluster(keys[0], int(buckets)) if buckets > 1 else None
        self.recover()
        if check and not keys_look_sound(rows, keys) and not key_violations(rows, keys).isEmpty():
            raise ValueError(f"{name}: {', '.join(keys)} is not a key")
        SnapshotStore.create(self.spark, self._table_root(name), rows, keys, cluster)
        self._commit()

    def drop_table(self, name: str) -> None:
        """Forget a table that no view reads, with its put-off changes."""
        self.recover()
        used = [v for v in self.views() if name in self._sources(v)]
        if used:
            raise ValueError(f"{name} is read by {', '.join(used)}")
        for folder in (f"seqs/{name}", f"deferred/{name}"):
            self._files.delete(f"{self.root}/{folder}")
        if SnapshotStore.exists(self.spark, self._table_root(name)):
            self._table(name).drop()
        self._commit()

    # --- one state of all tables and views -----------------------------------------

    def _state(self) -> dict[str, int]:
        """Which version of each store belongs to the last whole batch.

        Readers take all versions from one such file, so they see no table from
        after a batch beside a view from before it. Stores are published before, one by one.
        """
        names = [n for n in self._files.names(f"{self.root}/state") if n.endswith(".json")]
        return json.loads(self._files.read_text(f"{self.root}/state/{names[-1]}")) if names else {}

    def _commit(self) -> int:
        """Make what the stores hold now the state that readers see; its number.

        Only after ``recover``: else half of a batch that died would show.
        """
        names = [n for n in self._files.names(f"{self.root}/state") if n.endswith(".json")]
        versions = {f"tables/{n}": self._table(n).manifest().number for n in self.tables()}
        versions |= {f"views/{n}": self._store(n).manifest().number for n in self.views() if self._loaded(n)}
        number = int(names[-1][: -len(".json")]) + 1 if names else 0
        self._files.write_new(f"{self.root}/state/{number:010d}.json", json.dumps(versions))
        for old in names[:-4]:
            self._files.delete(f"{self.root}/state/{old}")
        return number

    def _loaded(self, name: str) -> bool:
        return SnapshotStore.exists(self.spark, self._view_root(name))

    def table(self, name: str) -> DataFrame:
        """The table as of the last whole batch."""
        return self._table(name).read(self._state().get(f"tables/{name}"))

    def tables(self) -> list[str]:
        """Tables that are loaded; one whose load was cut off is none."""
        return [n for n in self._files.names(f"{self.root}/tables") if SnapshotStore.exists(self.spark, self._table_root(n))]

    def _table_root(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def _table(self, name: str) -> SnapshotStore:
        return SnapshotStore(self.spark, self._table_root(name))

    # --- views -------------------------------------------------------------------

    def register_view(self, name: str, spec: ViewSpec | str) -> None:
        """Create a maintained view, from a spec or from SQL text (see ``view_from_sql``), and load it."""
        if isinstance(spec, str):
            used = {t: self.table(t) for t in self.tables() if "{" + t + "}" in spec}
            spec = view_from_sql(self.spark, spec, used, {t: self._table(t).keys for t in used})
        for table in spec.tables.values():
            if set(table.keys) != set(self._table(table.source).keys):
                raise UnsupportedView(f"{table.source} is kept by another key")
        self.recover()
        view = bind(spec, {s: self.table(s) for s in spec.sources()})
        self._register(name, build_view(view), view.key_names(), {"spec": spec.to_json()})

    def _register(self, name: str, rows: DataFrame, keys: Sequence[str], definition: Mapping) -> None:
        """Load a view, then write its definition, which makes it one. A load that fails leaves nothing."""
        if name in self.views():
            raise FileExistsError(self._definition(name))
        self._files.delete(self._view_root(name))  # of a run that died before it wrote the definition
        SnapshotStore.create(self.spark, self._view_root(name), rows, keys)
        self._files.write_new(self._definition(name), json.dumps(definition))
        self._commit()

    def register_query(self, name: str, sql: str) -> None:
        """Create a view of any SQL, renewed as a whole after each change.

        The text names tables in braces: ``select count(*) as n from {orders}``.
        For views the maintenance rules do not cover, such as aggregates.
        """
        self.recover()
        self._register(name, self._run(sql), [], {"sql": sql})

    def _run(self, sql: str) -> DataFrame:
        used = {t: self._table(t).read() for t in self.tables() if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    def drop_view(self, name: str) -> None:
        """Forget a view: first its definition, so nothing maintains it, then its data."""
        self.recover()
        self._files.delete(self._definition(name))
        self._bound.pop(name, None)
        self._files.delete(f"{self._view_root(name)}/versions")
        self._files.delete(self._view_root(name))
        self._commit()

    def views(self) -> list[str]:
        names = self._files.names(f"{self.root}/definitions")
        return [n[: -len(".json")] for n in names if n.endswith(".json")]

    def view(self, name: str, version: int | None = None) -> DataFrame:
        """What the view shows as of the last whole batch, or in an older version."""
        kind, _ = self._kind(name)
        rows = self._store(name).read(self._state().get(f"views/{name}") if version is None else version)
        return rows if kind == "sql" else visible(self._view(name), rows)

    def refresh(self, name: str, batch: Batch | None = None) -> None:
        """Compute a view anew from its tables."""
        if batch is None:
            self.recover()
        kind, text = self._kind(name)
        rows = self._run(text) if kind == "sql" else build_view(self._view(name), self._now(name))
        self._store(name).replace(rows, batch)
        if batch is None:
            self._commit()

    def verify(self, name: str) -> DataFrame:
        """Rows by which the view differs from its query; empty if all is well."""
        kind, text = self._kind(name)
        if kind == "sql":
            return verify_view(self.view(name), self._run(text), digests=True)
        view = self._view(name)
        now = {s: self.table(s) for s in view.spec.sources()}
        return verify_view(self.view(name), visible(view, build_view(view, now)), digests=True)

    def _definition(self, name: str) -> str:
        return f"{self.root}/definitions/{name}.json"

    def _view_root(self, name: str) -> str:
        return f"{self.root}/views/{name}"

    def _store(self, name: str) -> SnapshotStore:
        return SnapshotStore(self.spark, self._view_root(name))

    def _kind(self, name: str) -> tuple[str, str]:
        (item,) = json.loads(self._files.read_text(self._definition(name))).items()
        return item

    def _sources(self, name: str) -> list[str]:
        """The tables a view reads."""
        kind, text = self._kind(name)
        if kind == "sql":
            return [t for t in self.tables() if "{" + t + "}" in text]
        return ViewSpec.from_json(text).sources()

    def _view(self, name: str) -> View:
        if name not in self._bound:
            spec = ViewSpec.from_json(self._kind(name)[1])
            self._bound[name] = bind(spec, {s: self.table(s) for s in spec.sources()})
        return self._bound[name]

    def _now(self, name: str) -> dict[str, DataFrame]:
        return {s: self._table(s).read() for s in self._view(name).spec.sources()}

    def _frame(self, source: str) -> Frame:
        """The newest version of a table, so that it is cut down before keys that went are compared."""
        table = self._table(source)
        rows, gone = table.parts()
        return Frame(rows, tuple(table.keys), gone=gone, cluster=table.cluster)

    # --- changes -----------------------------------------------------------------

    def apply(
        self, changes: Mapping[str, Change], batch: Batch | None = None, done_with: Sequence[str] = ()
    ) -> None:
        """Apply a batch of changes to the tables and bring all views up to date.

        Rows that leave are found by key; keys the table lacks are ignored. Rows that
        enter need the table's columns, types that fit, and keys that are not NULL and new (or leave in the same
        batch): else ``BadChange`` is raised and nothing is applied. ``done_with`` are folders to delete with the batch.

        All or nothing: the change rows are written to a journal first. If the run
        dies, the next call (or ``recover``) finishes the batch; if it fails before
        anything was published, the batch is dropped. A numbered batch that
        was applied before is skipped.
        """
        self.recover()
        stores = [*map(self._table, self.tables()), *map(self._store, self.views())]
        if batch is None:
            last = max((s.manifest().batches.get(_OWN, -1) for s in stores), default=-1)
            batch = (_OWN, last + 1)
        elif all(s.done(batch) for s in map(self._table, changes)):
            return
        journal = Staging(self.spark, f"{self.root}/journal")
        try:
            staged = {s: self._checked(s, c, journal) for s, c in changes.items()}
        except Exception:
            journal.close()
            raise
        paths = {
            source: [r if r is None else journal.path_of(r) for r in (c.deleted, c.inserted)]
            for source, c in staged.items()
        }
        entry = {"batch": batch, "path": journal.path, "tables": paths, "done_with": list(done_with)}
        self._files.write_new(self._entry, json.dumps(entry))
        try:
            self._finish(staged, batch, journal)
        except Exception:
            if not any(s.done(batch) for s in stores):
                self._files.delete(self._entry)
                journal.close()
            raise
        self._close(entry)

    def _checked(self, source: str, change: Change, journal: Staging) -> Change:
        """The change as it is written to the journal: rows that leave as the table has them (rows
        it lacks go nowhere; of the others the keys and what a view reads), rows that enter with the table's types and keys it can take."""
        table, frame = self._table(source), self._frame(source)
        keys, deleted, inserted = table.keys, change.deleted, change.inserted
        if deleted is not None:
            lacking = [k for k in keys if k not in deleted.columns]
            if lacking:
                raise BadChange(f"rows that leave {source} lack {', '.join(lacking)}")
            wanted = as_table_rows(deleted.select(*cols(keys)), T.StructType([table.schema[k] for k in keys]), source)
            read = self._columns_read(source)
            deleted = with_own_images(Change(wanted, None), frame.columns([quoted(c) for c in read]), keys).deleted
        if inserted is not None:
            inserted = as_table_rows(inserted, table.schema, source)
        staged = stage_change(Change(deleted, inserted), source, journal)
        if inserted is not None:
            new = staged.inserted.selectExpr(*renamed(keys, "__gone"))
            there = frame.near(keys[0], new, "__gone0")
            there = there.meeting("t", distinct_if_large(new), F.expr(keys_match(keys, "__gone")))
            bad = refused_inserts(there, staged.deleted, staged.inserted, keys).first()
            if bad is not None:
                raise BadChange(f"{source}: a key that enters is not new or no key: {bad.asDict()}")
        return staged

    def _columns_read(self, source: str) -> list[str]:
        """The key columns of a table and those that a maintained view reads."""
        read = set(self._table(source).keys)
        for name in self.views():
            if self._kind(name)[0] != "sql" and source in self._sources(name):
                read |= set(columns_read(self._view(name))[source])
        return [c for c in self._table(source).schema.fieldNames() if c in read]

    def _close(self, entry: Mapping) -> None:
        """The batch is everywhere: show it, drop the feeds it came from, then forget it."""
        number = self._commit()
        for folder in entry.get("done_with", []):
            self._files.delete(folder)
        self._files.delete(self._entry)
        self._files.delete(entry["path"])
        if number % self.expire_every == 0:  # every commit has the next number, so none is stepped over
            self.expire(self.keep)

    @property
    def _entry(self) -> str:
        return f"{self.root}/journal/entry.json"

    def recover(self) -> None:
        """Finish a batch that a run before this one left half done."""
        if "entry.json" not in self._files.names(f"{self.root}/journal"):
            return
        entry = json.loads(self._files.read_text(self._entry))
        journal = Staging(self.spark, f"{self.root}/journal")
        staged = {}
        for source, paths in entry["tables"].items():
            schema = self._table(source).schema
            staged[source] = Change(*[p if p is None else journal.scan(p, schema) for p in paths])
        self._finish(staged, tuple(entry["batch"]), journal)
        self._close(entry)

    def _finish(self, changes: Mapping[str, Change], batch: Batch, staging: Staging) -> None:
        """Publish the batch wherever it is missing.

        Views go first, then tables. So while a view lacks the batch, all tables are
        as they were before it.
        """
        queries = []
        for name in self.views():
            if self._kind(name)[0] == "sql":
                queries.append(name)
                continue
            store, view = self._store(name), self._view(name)
            mine = {s: c for s, c in changes.items() if s in view.spec.sources()}
            if not store.done(batch):
                frames = {s: self._frame(s) for s in view.spec.sources()}
                store.publish(maintenance_steps(view, frames, mine, staging, own_images=True), batch)
                store.compact(self.compact_above)
        for source, change in changes.items():
            table = self._table(source)
            if not table.done(batch):
                removed = None if change.deleted is None else change.deleted.select(*cols(table.keys))
                table.publish([Step(removed, change.inserted)], batch)
                table.compact(self.compact_above)
        for name in queries:
            if not self._store(name).done(batch):
                self.refresh(name, batch)

    def apply_feed(
        self, feeds: Mapping[str, DataFrame], batch: Batch | None = None, done_with: Sequence[str] = ()
    ) -> None:
        """Apply change feeds (``op, before, after, seq``), folded per key."""
        with Staging(self.spark) as staging:
            changes = {}
            for source, feed in feeds.items():
                net = staging.table(net_changes(feed, self._table(source).keys), f"net-{source}")
                changes[source] = Change(*split_changes(net))
            self.apply(changes, batch, done_with)

    def apply_ordered(self, feeds: Mapping[str, DataFrame], batch: Batch) -> None:
        """As ``apply_feed``, for a numbered batch of a stream whose batches may come out of order.

        The last ``seq`` of each key is kept beside its table (``SequenceLog``: a batch reads only buckets that
        its keys fall into). A change that is
        older than what its key has had is dropped, so the newest wins whatever batch it comes in; of
        changes with one ``seq`` the later batch wins. Of an update that moves a row to another key only
        the half that is late is dropped.
        """
        self.recover()
        with Staging(self.spark) as staging:
            newer, reached = {}, {}
            for source, feed in feeds.items():
                store, keys = self._seqs(source), self._table(source).keys
                images = [F.col(i) for i in ("before", "after")]
                both = [F.struct(*[i.getField(k).alias(k) for k in keys], F.lit(n).alias("__i")) for n, i in enumerate(images)]
                each = F.explode(F.filter(F.array(*both), lambda k: k.getField(keys[0]).isNotNull()))
                if store.done(batch):
                    newer[source] = feed
                    continue
                number = feed.withColumn("__row", F.monotonically_increasing_id())
                number = staging.table(number, f"feed-{source}")
                of_key = number.select("__row", "seq", each.alias("__k")).select("__row", "seq", "__k.*")
                last = store.last(of_key).select(*[c.alias(f"__s{i}") for i, c in enumerate(cols(keys))], F.col("seq").alias("__seq"))
                late = of_key.join(last, F.expr(keys_match(keys, "__s") + " and seq < __seq"), "left_semi")
                late = late.groupBy("__row").agg(*[F.max(F.col("__i") == n).alias(f"__late{n}") for n in (0, 1)])
                before, after = (i.getField(keys[0]).isNotNull() for i in images)
                moved = (F.col("op") == "U") & before & after & (F.col("__late0") != F.col("__late1"))
                half = F.coalesce(moved, F.lit(False))  # the keys of other updates are late together
                judged = number.join(late, "__row", "left").where(half | F.col("__late0").isNull())
                newer[source] = judged.select(
                    F.when(half & F.col("__late0"), "I").when(half, "D").otherwise(F.col("op")).alias("op"),
                    F.when(~(half & F.col("__late0")), F.col("before")).alias("before"),
                    F.when(~(half & F.col("__late1")), F.col("after")).alias("after"),
                    "seq",
                )
                reached[source] = staging.table(of_key.groupBy(*cols(keys)).agg(F.max("seq").alias("seq")), f"seq-{source}")
            self.apply_feed(newer, batch)
            for source, seqs in reached.items():
                self._seqs(source).append(seqs, batch)

    def _seqs(self, source: str) -> SequenceLog:
        """Per key of a table the ``seq`` of its last change from a stream."""
        table = self._table(source)
        return SequenceLog(self.spark, f"{self.root}/seqs/{source}", [table.schema[k] for k in table.keys])

    def defer(self, source: str, feed: DataFrame) -> None:
        """Put a change feed aside; the views stay as they are until ``apply_deferred``."""
        feed.write.parquet(f"{self.root}/deferred/{source}/{uuid.uuid4().hex}")

    def apply_deferred(self) -> None:
        """Apply what was put aside as one folded batch.

        The journal names the folders, so a run that dies drops them with the batch and none is applied twice.
        """
        self.recover()
        feeds, folders = {}, []
        for source in self._files.names(f"{self.root}/deferred"):
            here = [
                f"{self.root}/deferred/{source}/{n}"
                for n in self._files.names(f"{self.root}/deferred/{source}")
            ]
            if here:
                feeds[source] = self.spark.read.parquet(*here)
                folders += here
        if not feeds:
            return
        self.apply_feed(feeds, done_with=folders)

    def expire(self, keep: int = 2) -> None:
        """Drop old versions of all tables and views."""
        for name in self.tables():
            self._table(name).expire(keep)
        for name in self.views():
            self._store(name).expire(keep)
