"""Bring a stored view up to date from changes of its base tables.

A maintenance step covers one alias and yields two row sets: the key tuples of
stored rows that go, and the rows that come. Neither needs the stored view to be
read, so the cost of a step follows the change, not the result.

Steps run one after another. Each sees the tables of earlier steps as they are
after the change and the others as they were before it, which is how a
change of several tables and a table used under two aliases are reduced to the
single-table rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.functions.expressions import cols, keys_match, null_text, quoted, renamed
from tideview.operators.joins import broadcast_limit, distinct_if_large
from tideview.plans.spec import KEEP, Node, View, hidden
from tideview.plans.view import ALONE, Frame, Frames, delta_rows, frames_of, kept, stage_large
from tideview.sources.changes import apply_changes
from tideview.sources.snapshots import Step, apply_steps
from tideview.sources.storage import Staging, plan_bytes

# Marks the changed rows: true for those that enter, false for those that leave.
ENTERS = "__enters"


@dataclass(frozen=True)
class Change:
    """Rows that leave and rows that enter one base table; either may be None."""

    deleted: DataFrame | None = None
    inserted: DataFrame | None = None


# --- deltas ----------------------------------------------------------------------


def primary_delta(
    view: View, alias: str, rows: DataFrame, frames: Frames, staging: Staging
) -> DataFrame:
    """Working rows of the view that contain one of ``rows`` of ``alias``."""
    return delta_rows(view, alias, rows, frames, staging)


def smaller_keys(view: View, alias: str, delta: DataFrame) -> DataFrame | None:
    """Key tuples of the rows that the delta rows cover, ``alias`` nulled out.

    Per delta row and per largest term without ``alias``: the row's keys with
    everything outside that term set to NULL; distinct. This is done in one pass
    with an array of variants per row. None if there is no such term.
    """
    found = _covered_keys(view, alias, delta)
    return None if found is None else found.distinct()


def _covered_keys(view: View, alias: str, delta: DataFrame, marks: Sequence[str] = ()) -> DataFrame | None:
    """``smaller_keys``, as often as delta rows cover them, with further columns of these rows."""
    nulls = {n: null_text(delta.schema[n].dataType) for n in view.key_names()}
    variants = []
    for term, labels in view.anchors(alias).items():
        row = [
            f"{quoted(n) if a in term else nulls[n]} as {quoted(n)}" for a in view.aliases for n in view.key_names([a])
        ]
        variants.append(F.when(view.has_label(*labels), F.expr(f"struct({', '.join(row)})")))
    if not variants:
        return None
    return delta.select(*cols(marks), F.explode(F.array(*variants)).alias("v")).where("v is not null").select("v.*", *cols(marks))


def _met_keys(view: View, alias: str, delta: DataFrame) -> DataFrame | None:
    """``smaller_keys`` of all rows found, with ``__came`` and ``__went``: whether one that enters, or one that leaves, covers them."""
    found = _covered_keys(view, alias, delta, [ENTERS])
    if found is None:
        return None
    met = F.max(ENTERS).alias("__came"), F.max(~F.col(ENTERS)).alias("__went")
    return found.groupBy(*cols(view.key_names())).agg(*met)


def matched_orphans(view: View, alias: str, delta: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows without ``alias`` that the delta of an insert now covers."""
    covered = smaller_keys(view, alias, delta)
    if covered is None:
        return stored.limit(0)
    return _by_keys(stored, distinct_if_large(covered), view.key_names(), "left_semi", null_safe=True)


def new_orphans(
    view: View,
    alias: str,
    delta: DataFrame,
    frames: Frames,
    staging: Staging,
    covered: DataFrame | None = None,
    certain: Sequence[frozenset[str]] = (),
) -> DataFrame | None:
    """Rows that appear because they lost their last partner in ``alias``.

    ``delta`` are the working rows that went, or the key tuples that they covered, and ``frames`` the tables after
    the change. For each largest term without ``alias`` one of its aliases is cut
    down to the keys in question and the view evaluated around it: the rows with
    exactly that term's label are the new ones. ``covered`` may give key tuples
    known to have a partner again; if that is all of them, the tables are not read.
    Nor are they for the terms ``certain``, whose rows the delta holds (``certain_orphans``). Where the delta
    is not written (see ``maintenance_step``), what was lost is.
    """
    parts = []
    for term, labels in view.anchors(alias).items():
        if term in certain:
            continue
        names = view.key_names(term)
        lost = delta.where(view.has_label(term, *labels)).select(*cols(names)).distinct()
        lost = _not_covered(view, lost, term, covered)
        if covered is not None or _many_pairs(view):
            lost = staging.table(lost, "lost-keys")
            if lost.isEmpty():
                continue
        anchor = _nearest(view, alias, term)
        keys = view.keys(anchor)
        anchor_keys = lost.selectExpr(*[f"{quoted(hidden(anchor, k))} as {quoted(k)}" for k in keys])
        if len(term) > 1:
            anchor_keys = distinct_if_large(anchor_keys)
        # Of the tables outside the term only the join columns matter here: a row
        # that contains one of them is dropped again.
        outside = {a: _join_columns_only(view, a, f) for a, f in frames.items() if a not in term}
        wanted = anchor_keys.selectExpr(*renamed(keys, "__w"))
        there = frames[anchor].near(keys[0], wanted, "__w0")
        rows = there.meeting(anchor, wanted, F.expr(keys_match(keys, "__w")))
        join = _plain_join(view, alias, term)
        if join is not None:
            rows = _without_partners(join, alias, rows, outside[alias])
            outside[alias] = Frame(outside[alias].rows().limit(0))
            anchor_keys = None
        rows = stage_large(rows, frames[anchor], staging, "lost").rows()
        found = delta_rows(view, anchor, rows, {**frames, **outside}, staging, row_keys=anchor_keys)
        found = found.where(view.has_label(term))
        if len(term) > 1:
            found = _by_keys(found, lost, names, "left_semi")
        parts.append(found)
    return reduce(DataFrame.unionByName, parts) if parts else None


def _plain_join(view: View, alias: str, term: frozenset[str]) -> Node | None:
    """The join of ``alias`` with the one table of ``term``, if what it asks for beside equalities is of ``alias`` alone."""
    for node in _joins(view.root):
        if node.left.leaf and node.right.leaf and {alias, *term} == set(node.aliases) and node.pairs:
            if all(c.names <= {alias} for c in node.on if c.right is None):
                return node
    return None


def _without_partners(join: Node, alias: str, rows: DataFrame, table: Frame) -> DataFrame:
    """The rows of the other side that meet no row of ``alias``.

    What its changes leave of ``alias`` is counted by the join's columns: rows there, less those that left (these
    are the table's own), and those that entered. So its keys need not be compared.
    """
    on_left = join.left.aliases == (alias,)
    (other,) = (join.right if on_left else join.left).aliases
    mine = [a if on_left else b for a, b in join.pairs]
    theirs = [b if on_left else a for a, b in join.pairs]
    names = [f"__p{i}" for i in range(len(mine))]
    wanted = rows.alias(other).selectExpr(f"{theirs[0]} as __w0")
    column = mine[0].replace("`", "").removeprefix(f"{alias}.")
    there = replace(table, changes=()).near(column, wanted, "__w0")
    if plan_bytes(wanted) <= broadcast_limit(wanted):
        base = there.meeting(alias, wanted, F.expr(f"({mine[0]}) = __w0"))
    else:
        base = there.rows()

    def signed(part: DataFrame, sign: int) -> DataFrame:
        part = part.alias(alias)
        for text in join.rest:
            part = part.where(F.expr(text))
        return part.selectExpr(*[f"{m} as {n}" for m, n in zip(mine, names)], f"{sign} as __n")

    parts = [signed(base, 1)]
    for deleted, inserted in table.changes:
        parts += [signed(part, sign) for part, sign in ((deleted, -1), (inserted, 1)) if part is not None]
    counted = reduce(DataFrame.unionByName, parts).groupBy(*names).agg(F.sum("__n").alias("__n"))
    on = " and ".join(f"({t}) = {n}" for t, n in zip(theirs, names))
    return rows.alias(other).join(counted.where("__n > 0"), F.expr(on), "left_anti")


def certain_orphans(
    view: View, alias: str, delta: DataFrame, terms: Sequence[frozenset[str]], covered: DataFrame | None = None
) -> DataFrame | None:
    """The new orphans of ``terms``, from the delta alone.

    A tuple of these terms has one partner in ``alias`` at most (``View.certain_terms``), so the one
    lost was the last. ``delta`` holds what is left of each row in ``__alone<i>``.
    """
    nulls = {hidden(a, k): null_text(view.schemas[view.source(a)].schema[k].dataType) for a in view.aliases for k in view.keys(a)}
    parts = []
    for i, term in enumerate(terms):
        labels, names = view.anchors(alias)[term], view.key_names(term)
        lost = _lost(view, delta, term, labels, covered)
        if any(len(label) > len(term) + 1 for label in labels):  # then several rows can hold the same tuple
            lost = lost.dropDuplicates(names)
        keys = [f"{quoted(n) if n in names else nulls[n]} as {quoted(n)}" for n in view.key_names()]
        parts.append(lost.selectExpr(*keys, f"{ALONE}{i}.*"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _lost(
    view: View, delta: DataFrame, term: frozenset[str], labels: Sequence[frozenset[str]], covered: DataFrame | None
) -> DataFrame:
    """The delta rows whose tuple of ``term`` lost a partner and did not find one in ``covered``."""
    return _not_covered(view, delta.where(view.has_label(*labels)), term, covered)


def _not_covered(view: View, lost: DataFrame, term: frozenset[str], covered: DataFrame | None) -> DataFrame:
    if covered is None:
        return lost
    names = view.key_names(term)
    return _by_keys(lost, covered.where(view.has_label(term)).select(*cols(names)), names, "left_anti")


def _join_columns_only(view: View, alias: str, frame: Frame) -> Frame:
    """The table with all columns NULL that no key or ON reads."""
    needed = view.join_columns(alias)
    return frame.columns(
        [
            quoted(f.name) if f.name in needed else f"{null_text(f.dataType)} as {quoted(f.name)}"
            for f in frame.fields
        ]
    )


def _nearest(view: View, alias: str, term: frozenset[str]) -> str:
    """An alias of the term that shares a join condition with ``alias`` if any does."""

    def walk(node):
        if node.leaf:
            return
        yield from walk(node.left)
        yield from walk(node.right)
        yield node

    for node in walk(view.root):
        for condition in node.on:
            near = condition.names & term
            if alias in condition.names and near:
                return min(near)
    return min(term)


def _by_keys(
    rows: DataFrame, wanted: DataFrame, names: Sequence[str], how: str, null_safe: bool = False
) -> DataFrame:
    """Semi or anti join on columns that have the same names on both sides."""
    wanted = wanted.selectExpr(*renamed(names, "__w"))
    on = keys_match(names, "__w", "<=>" if null_safe else "=")
    return rows.join(wanted, F.expr(on), how)


# --- steps -----------------------------------------------------------------------


def maintenance_step(
    view: View, alias: str, change: Change, frames: Frames, staging: Staging, published: bool = True
) -> tuple[Step, Frame]:
    """What a change of one alias does to the stored view, and its table after it.

    Rows that leave and rows that enter are joined with the other tables together,
    so an update reads these once. Rows covered both before and after need no look
    at the tables at all.

    Where a join has no equality, the rows found can be many times the tables. Then they are not written,
    and only the distinct keys of what is covered or lost are.

    Of rows that leave only keys are written, not the select list. If the step is not to be ``published`` and rows only
    leave, these are removed by the changed table's keys, and the rows found are needed for what they lose alone.
    """
    leaves, enters = change.deleted, change.inserted
    large = _many_pairs(view)
    after = frames[alias].after(leaves, enters)
    if enters is None and not published and not view.anchors(alias):
        return Step(None, None, _own_keys(view, alias, leaves)), after
    marked = [
        part.withColumn(ENTERS, F.lit(flag)) for part, flag in ((leaves, False), (enters, True)) if part is not None
    ]
    rows = reduce(DataFrame.unionByName, marked)
    certain = view.certain_terms(alias) if leaves is not None else []
    found = delta_rows(view, alias, rows, frames, staging, marks=[ENTERS], alone=certain)
    left = [f"{ALONE}{i}" for i in range(len(certain))]
    found = found.withColumns({c: F.when(~F.col(ENTERS), F.col(c)) for c in left}) if left else found
    if leaves is not None:
        found = _keys_of_leaving(view, alias, found, enters is None, published)
    delta = found if large else staging.table(found, f"delta-{alias}")
    keys = cols(view.key_names())
    removed, added, covered, met = [], [], None, None
    if large and leaves is not None and enters is not None:  # what is covered and what is lost are found by one pass of the pairs
        met = _met_keys(view, alias, delta)
        met = met if met is None else staging.table(met, "met")
    if enters is not None:
        came = delta.where(F.col(ENTERS)).drop(ENTERS, *left)
        covered = smaller_keys(view, alias, came) if met is None else met.where("__came").select(*keys)
        if covered is not None:
            covered = staging.table(covered, "covered") if large else covered
            removed.append(covered)
        added.append(kept(came))
    if leaves is not None:
        went = delta.where(~F.col(ENTERS)).drop(ENTERS)
        if enters is not None or published:
            removed.append(kept(went).select(*keys))
        lost, again = (went, covered) if met is None else (met.where("__went and not __came").select(*keys), None)
        looked_up = new_orphans(view, alias, lost, {**frames, alias: after}, staging, again, certain)
        for orphans in (certain_orphans(view, alias, went, certain, covered), looked_up):
            if orphans is not None:
                added.append(kept(orphans))

    def union(parts):
        return reduce(DataFrame.unionByName, parts) if parts else None

    if leaves is None or (enters is not None and not large):
        return Step(union(removed), union(added)), after
    return Step(union(removed), union(added), _own_keys(view, alias, leaves), covered), after


def _own_keys(view: View, alias: str, rows: DataFrame) -> DataFrame:
    return rows.selectExpr(*[f"{quoted(k)} as {quoted(hidden(alias, k))}" for k in view.keys(alias)])


def _keys_of_leaving(view: View, alias: str, found: DataFrame, only: bool, published: bool) -> DataFrame:
    """The rows found without the select list where they leave; if they ``only`` leave, without its columns, and if
    they need not be removed by all keys, with the keys that tell what they lose."""
    if not only:
        shown = {c: F.when(F.col(ENTERS), F.col(quoted(c))).alias(c) for c in view.outputs}
        return found.select(*[shown.get(c, F.col(quoted(c))) for c in found.columns])
    drop = set(view.outputs)
    if not published:
        used = {view.key_names([a])[0] for a in view.aliases}
        for term in view.anchors(alias):
            used |= set(view.key_names(term))
        drop |= {KEEP, *view.key_names()} - used
    return found.select(*cols([c for c in found.columns if c not in drop]))


def _joins(node: Node) -> Iterator[Node]:
    if not node.leaf:
        yield node
        yield from _joins(node.left)
        yield from _joins(node.right)


def _many_pairs(view: View) -> bool:
    """Whether a join has no equality."""
    return any(not node.pairs for node in _joins(view.root))


def maintenance_steps(
    view: View,
    tables: Mapping[str, DataFrame | Frame],
    changes: Mapping[str, Change],
    staging: Staging,
    own_images: bool = False,
    published: bool = True,
) -> list[Step]:
    """The steps for a batch of changes; ``tables`` are the sources before it.

    Steps that are not to be ``published``, only put on DataFrames, need not name all keys that go.

    Rows that leave are looked up in the table by key and taken from there, so a row
    the table lacks, or an old image of it, does no harm. ``own_images`` says that this
    has been done.
    """
    unknown = set(changes) - set(view.spec.sources())
    if unknown:
        raise ValueError(f"the view does not read {', '.join(sorted(unknown))}")
    frames = frames_of(view, tables)
    read = columns_read(view)
    frames = {a: f.columns([quoted(c) for c in read[view.source(a)]]) for a, f in frames.items()}

    def cut(rows, source):
        return rows if rows is None else rows.select(*cols(read[source]))

    if not own_images:
        of = {view.source(a): a for a in reversed(view.aliases)}
        changes = {s: with_own_images(c, frames[of[s]], frames[of[s]].keys) for s, c in changes.items()}
        changes = {s: Change(c.deleted, cut(c.inserted, s)) for s, c in changes.items()}
    changes = {source: stage_change(c, source, staging) for source, c in changes.items()}
    changes = {s: Change(cut(c.deleted, s), cut(c.inserted, s)) for s, c in changes.items()}
    steps = []
    for alias in view.aliases:
        change = changes.get(view.source(alias))
        if change is None or (change.deleted is None and change.inserted is None):
            continue
        step, frames[alias] = maintenance_step(view, alias, change, frames, staging, published)
        steps.append(step)
    return steps


def columns_read(view: View) -> dict[str, list[str]]:
    """Per source the columns that the view reads; all of them where that can't be told."""
    shown = view.shown_columns
    read: dict[str, set[str]] = {}
    for a in view.aliases:
        if shown is None:
            here = set(view.schemas[view.source(a)].columns)
        else:
            here = view.join_columns(a) | set(shown[a].names if a in shown else ())
        read.setdefault(view.source(a), set()).update(here)
    return {s: [c for c in view.schemas[s].columns if c in names] for s, names in read.items()}


def with_own_images(change: Change, table: Frame, keys: Sequence[str]) -> Change:
    """The change with the table's own rows in place of the deleted ones; these need their keys only."""
    if change.deleted is None:
        return change
    wanted = distinct_if_large(change.deleted.selectExpr(*renamed(keys, "__gone")))
    there = table.near(keys[0], wanted, "__gone0")
    return Change(there.meeting("t", wanted, F.expr(keys_match(keys, "__gone"))), change.inserted)


def stage_change(change: Change, source: str, staging: Staging) -> Change:
    """Write the change rows once, unless ``staging`` holds them already.

    They are read several times, and Spark then knows how few they are.
    """

    def written(rows, name):
        return rows if rows is None or staging.has(rows) else staging.table(rows, f"{name}-{source}")

    return Change(written(change.deleted, "old"), written(change.inserted, "new"))


def apply_to_view(view: View, stored: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Stored rows after the steps."""
    return apply_steps(stored, steps, view.key_names()) if steps else stored


def maintain(
    view: View,
    stored: DataFrame,
    tables: Mapping[str, DataFrame],
    changes: Mapping[str, Change],
    staging: Staging,
) -> DataFrame:
    """The stored view after ``changes``; ``stored`` and ``tables`` are from before.

    The result reads the staged tables, so use or save it before closing ``staging``.
    """
    return apply_to_view(view, stored, maintenance_steps(view, tables, changes, staging, published=False))


def maintain_insert(view, stored, tables, source, rows, staging) -> DataFrame:
    """The stored view after inserting ``rows`` into ``source``."""
    return maintain(view, stored, tables, {source: Change(inserted=rows)}, staging)


def maintain_delete(view, stored, tables, source, rows, staging) -> DataFrame:
    """The stored view after deleting from ``source`` the rows with the keys of ``rows``."""
    return maintain(view, stored, tables, {source: Change(deleted=rows)}, staging)


def maintain_update(view, stored, tables, source, before, after, staging) -> DataFrame:
    """The stored view after replacing rows; keys and parents may change."""
    return maintain(view, stored, tables, {source: Change(before, after)}, staging)


def tables_after(
    view: View, tables: Mapping[str, DataFrame], changes: Mapping[str, Change]
) -> dict[str, DataFrame]:
    """The source tables after the changes."""
    keys = {view.source(a): view.keys(a) for a in view.aliases}
    out = dict(tables)
    for source, change in changes.items():
        out[source] = apply_changes(tables[source], change.deleted, change.inserted, keys[source])
    return out
