"""Evaluate a view, or only the part of it that contains given rows of one alias.

A *working row* holds the hidden keys of every alias (NULL where the alias is
absent), the select list, and ``__keep``: whether WHERE holds. Stored rows are the
kept ones without the flag.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import cols, literal, null_text, quoted
from tideview.operators.joins import SKEW_BYTES, distinct_if_large, setting, skew_safe_join
from tideview.plans.spec import KEEP, Condition, Node, View, hidden
from tideview.sources.changes import apply_changes
from tideview.sources.snapshots import BUCKET, VERSION, Cluster, live_rows
from tideview.sources.storage import Staging, plan_bytes

# Structs that hold what remains of a row when tables are taken from it.
ALONE = "__alone"


@dataclass(frozen=True, eq=False)
class Frame:
    """A table as it is after changes that its files do not show yet.

    The changes are put on top of whatever part of the table is asked for. So a
    large table is first cut down to what can matter and only that is compared
    with the keys that left. The same holds for the keys that earlier versions of a stored
    table removed (``gone``); its rows then carry their version.
    """

    base: DataFrame
    keys: tuple[str, ...] = ()
    changes: tuple[tuple[DataFrame | None, DataFrame | None], ...] = ()
    gone: DataFrame | None = None
    cluster: Cluster | None = None

    def after(self, deleted: DataFrame | None, inserted: DataFrame | None) -> Frame:
        return replace(self, changes=(*self.changes, (deleted, inserted)))

    def rows(self) -> DataFrame:
        return self._each(lambda part: part)

    def meeting(self, alias: str, wanted: DataFrame, on: Column) -> DataFrame:
        """The rows that have a partner in ``wanted``."""
        return self._each(lambda part: part.alias(alias).join(wanted, on, "left_semi"))

    def near(self, column: str, wanted: DataFrame, name: str) -> Frame:
        """Without the buckets that hold none of the wanted values of a column.

        Helps if the table is clustered by that column. At most one number a bucket comes
        to the driver, and the others are not read.
        """
        if self.cluster is None or column != self.cluster.column:
            return self
        kind, given = self.base.schema[column].dataType, wanted.schema[name].dataType
        whole = isinstance(kind, T.IntegralType) and isinstance(given, T.IntegralType)
        if kind != given and not whole:  # values that are equal after a conversion need not share a bucket
            return self
        value = F.col(name).try_cast(kind)  # a value that doesn't fit has no partner
        hit = [r[0] for r in wanted.select(self.cluster.of(value)).distinct().take(self.cluster.buckets)]
        if len(hit) == self.cluster.buckets:
            return self
        return replace(self, base=self.base.where(F.col(BUCKET).isin(hit)))

    def columns(self, texts: Sequence[str]) -> Frame:
        """The table with other columns; the keys must be among them."""
        changes = tuple((d, i if i is None else i.selectExpr(*texts)) for d, i in self.changes)
        return replace(self, base=self.base.selectExpr(*texts, *self._own), changes=changes)

    @property
    def _own(self) -> list[str]:
        """Columns of the store, not of the table."""
        return [VERSION] * (self.gone is not None) + [BUCKET] * (self.cluster is not None)

    @property
    def fields(self) -> list[T.StructField]:
        return [f for f in self.base.schema.fields if f.name not in self._own]

    def _each(self, part) -> DataFrame:
        out = part(self.base)
        if self.gone is not None:
            out = live_rows(out, self.gone, [c for c in self.gone.columns if c != VERSION])
        out = out.drop(*self._own)
        for deleted, inserted in self.changes:
            out = apply_changes(out, deleted, None if inserted is None else part(inserted), self.keys)
        return out

    @cached_property
    def bytes(self) -> int:
        """What is read to get at the rows."""
        return plan_bytes(self.base) + sum(plan_bytes(i) for _, i in self.changes if i is not None)


Frames = Mapping[str, Frame]


def frames_of(view: View, tables: Mapping[str, DataFrame | Frame] | None = None) -> dict[str, Frame]:
    """One table per alias from one per source."""
    tables = view.schemas if tables is None else tables

    def frame(alias: str) -> Frame:
        table = tables[view.source(alias)]
        return replace(table, keys=view.keys(alias)) if isinstance(table, Frame) else Frame(table, view.keys(alias))

    return {a: frame(a) for a in view.aliases}


def working_rows(
    view: View,
    frames: Frames,
    kinds: Mapping[Node, str] | None = None,
    marks: Sequence[tuple[str, str]] = (),
    alone: Sequence[frozenset[str]] = (),
) -> DataFrame:
    """All rows of the join tree, before WHERE.

    ``marks`` are further (alias, column) pairs to carry along; they are part of
    what identifies a row of that alias. For the i-th term of ``alone`` a struct ``__alone<i>`` holds
    the select list and the flag as they are without the tables outside that term.
    """
    joined = _join_tree(view, view.root, frames, kinds or {}, marks)
    columns = [f"{quoted(a)}.{quoted(k)} as {quoted(hidden(a, k))}" for a in view.aliases for k in view.keys(a)]
    columns += view.result_texts()
    columns += [f"{quoted(a)}.{quoted(c)} as {quoted(c)}" for a, c in marks]
    return _with_alone(view, joined, columns, alone) if alone else joined.selectExpr(*columns)


def _with_alone(view: View, joined: DataFrame, columns: Sequence[str], alone: Sequence[frozenset[str]]) -> DataFrame:
    """Each alias becomes a struct of its name, or a NULL, so that the texts of the view apply as they are.
    Catalyst resolves the structs away again."""
    shown = view.shown_columns
    held = {a: f"__table{i}" for i, a in enumerate(shown)}
    tables = [
        f"named_struct({', '.join(f'{literal(f.name)}, {quoted(a)}.{quoted(f.name)}' for f in kind.fields)}) as {held[a]}"
        for a, kind in shown.items()
    ]
    rows = joined.selectExpr(*columns, *tables)
    for i, term in enumerate(alone):
        row = f"struct({', '.join(map(quoted, rows.columns))}) as __row"
        scope = [f"{held[a] if a in term else null_text(kind)} as {quoted(a)}" for a, kind in shown.items()]
        rows = rows.selectExpr(row, *scope).selectExpr("__row.*", f"struct({', '.join(view.result_texts())}) as {ALONE}{i}")
    return rows.drop(*held.values())


def _join_tree(view: View, node: Node, frames: Frames, kinds, marks) -> DataFrame:
    if node.leaf:
        alias = node.aliases[0]
        return frames[alias].rows().alias(alias)
    left = _join_tree(view, node.left, frames, kinds, marks)
    right = _join_tree(view, node.right, frames, kinds, marks)
    return skew_safe_join(
        left,
        right,
        node.pairs,
        node.rest,
        kinds.get(node, node.kind),
        left_id=_row_id(view, node.left, marks),
        right_id=_row_id(view, node.right, marks),
        left_bytes=_bytes(node.left, left, frames),
        right_bytes=_bytes(node.right, right, frames),
        left_unique=_unique(view, node.left, [a for a, _ in node.pairs]),
        right_unique=_unique(view, node.right, [b for _, b in node.pairs]),
    )


def _bytes(node: Node, rows: DataFrame, frames: Frames) -> int:
    """A bound of a side's size: what is read for it, and for a subtree Catalyst's estimate if that is larger."""
    read = sum(frames[a].bytes for a in node.aliases)
    return read if node.leaf else max(read, plan_bytes(rows))


def _row_id(view: View, node: Node, marks) -> list[str]:
    columns = [(a, k) for a in node.aliases for k in view.keys(a)]
    columns += [(a, c) for a, c in marks if a in node.aliases]
    return [f"{quoted(a)}.{quoted(c)}" for a, c in columns]


def _unique(view: View, node: Node, texts: Iterable[str]) -> bool:
    """Whether the side is one table joined on its whole key."""
    if not node.leaf:
        return False
    alias = node.aliases[0]
    return {f"{alias}.{k}" for k in view.keys(alias)} <= {t.replace("`", "").strip() for t in texts}


def kept(rows: DataFrame) -> DataFrame:
    """Working rows that pass WHERE, in stored form."""
    return rows.where(F.col(KEEP)).drop(KEEP)


def build_view(view: View, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The whole view in stored form (hidden keys and select list)."""
    return kept(working_rows(view, frames_of(view, tables)))


def visible(view: View, stored: DataFrame) -> DataFrame:
    """What the user sees of stored rows: the select list."""
    return stored.select(*cols(view.outputs))


# --- the part of a view that contains given rows ---------------------------------


@dataclass(frozen=True)
class Reduction:
    """Keep of alias ``into`` only what meets the rows of alias ``using``."""

    into: str
    using: str
    condition: Condition
    optional: bool


@dataclass(frozen=True)
class DeltaPlan:
    """How to evaluate the view when one alias is replaced by a few of its rows."""

    kinds: Mapping[Node, str]
    reductions: tuple[Reduction, ...]


def delta_plan(view: View, alias: str) -> DeltaPlan:
    """Narrow the joins around ``alias`` and find out what can be cut down by it.

    ``alias`` must be present in every row that is asked for. So on the way from
    its leaf to the root a full join keeps only its side, and a join that
    preserves the other side only becomes an inner join. What it meets on the
    other side can be cut down before that join, and from there on recursively:
    the alias met must be present too.
    """
    kinds: dict[Node, str] = {}
    reductions: list[Reduction] = []
    _walk(view.root, alias, kinds, reductions)
    needed = {r.using for r in reductions}
    return DeltaPlan(
        kinds, tuple(r for r in reductions if not r.optional or r.into in needed)
    )


def _walk(node: Node, anchor: str, kinds: dict, reductions: list) -> None:
    if node.leaf:
        return
    on_left = anchor in node.left.aliases
    mine, other = (node.left, node.right) if on_left else (node.right, node.left)
    _walk(mine, anchor, kinds, reductions)
    keeps_mine = node.kind in (("left", "full") if on_left else ("right", "full"))
    kinds[node] = ("left" if on_left else "right") if keeps_mine else "inner"
    reached = {anchor} | {r.into for r in reductions}
    best = None
    for condition in node.on:
        if condition.right is None or len(condition.names) != 2:
            continue
        (using,) = condition.names & set(mine.aliases)
        (into,) = condition.names & set(other.aliases)
        if using in reached and (best is None or using == anchor):
            best = Reduction(into, using, condition, optional=not keeps_mine and mine.leaf and other.leaf)
    if best is not None:
        reductions.append(best)
        _walk(other, best.into, kinds, reductions)


def delta_rows(
    view: View,
    alias: str,
    rows: DataFrame,
    frames: Frames,
    staging: Staging,
    row_keys: DataFrame | None = None,
    marks: Sequence[str] = (),
    alone: Sequence[frozenset[str]] = (),
) -> DataFrame:
    """Working rows that contain one of ``rows`` of ``alias``.

    ``frames`` give the other aliases. They are semi-joined with what they can
    meet, outward from ``rows``; each base table is read once, and only rows that
    are part of the answer reach a shuffle. Large tables cut down this way are
    staged, because they are used again and their real size is then known.

    ``row_keys`` may give the keys of ``rows`` where these are cheaper to read than
    ``rows``. ``marks`` are columns of ``rows`` to carry along; ``alone`` as in ``working_rows``.
    """
    plan = delta_plan(view, alias)
    frames = {**frames, alias: Frame(rows)}
    own_keys = {f"{alias}.{k}" for k in view.keys(alias)}
    for r in plan.reductions:
        using_text, into_text = _sides(r)
        using = frames[r.using].rows()
        if r.using == alias and row_keys is not None and using_text.replace("`", "") in own_keys:
            using = row_keys
        wanted = distinct_if_large(using.alias(r.using).selectExpr(f"{using_text} as __w"))
        source = frames[r.into]
        column = into_text.replace("`", "").removeprefix(f"{r.into}.")
        cut = source.near(column, wanted, "__w").meeting(r.into, wanted, F.expr(f"({into_text}) = __w"))
        frames[r.into] = stage_large(cut, source, staging, r.into)
    return working_rows(view, frames, plan.kinds, [(alias, m) for m in marks], alone)


def stage_large(cut: DataFrame, source: Frame, staging: Staging, name: str) -> Frame:
    """Write what is left of a large table: it is used several times, and further
    plans depend on how little it is. A small table is cheaper to read again."""
    if source.bytes >= setting(source.base, SKEW_BYTES):
        return Frame(staging.table(cut, name))
    return Frame(cut)


def _sides(r: Reduction) -> tuple[str, str]:
    """The texts of the equality: (of the alias used, of the alias cut down)."""
    first, second = r.condition.left, r.condition.right
    return (first, second) if r.using in r.condition.left_names else (second, first)

