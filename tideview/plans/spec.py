"""What a maintained view is: keyed tables, a join tree, a filter, a select list.

Expressions are Spark SQL text and name columns as ``alias.column``. They are
resolved by Spark's analyzer; this module only finds out which aliases a join
condition names and refuses views the maintenance rules do not cover.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import all_of, null_text, quoted, typed_null

KINDS = ("inner", "left", "right", "full")
KEEP = "__keep"


class UnsupportedView(ValueError):
    """The view is outside the class that can be maintained from changes."""


@dataclass(frozen=True)
class Table:
    """A base table as one alias of a view."""

    source: str
    keys: tuple[str, ...]

    def __init__(self, source: str, keys: Sequence[str]):
        object.__setattr__(self, "source", source)
        object.__setattr__(self, "keys", (keys,) if isinstance(keys, str) else tuple(keys))
        if not self.keys:
            raise UnsupportedView(f"table {source} needs a key")


@dataclass(frozen=True)
class Join:
    """A join of two subtrees; a subtree is an alias or another ``Join``.

    ``on`` is a condition text or a sequence of conditions that must all hold.
    A condition is a text, or a pair of texts that must be equal, one per side.
    Texts are split as Spark resolves them: every equality between the two sides
    is found, however it is written, and spreads the join over tasks by key.
    """

    kind: str
    left: str | Join
    right: str | Join
    on: str | tuple

    def __post_init__(self):
        if self.kind not in KINDS:
            raise UnsupportedView(f"join kind {self.kind!r}; one of {', '.join(KINDS)} is needed")
        on = [self.on] if isinstance(self.on, str) else list(self.on)
        # A bare pair of texts is one equality only when it is a tuple in the list.
        object.__setattr__(self, "on", tuple(on))


def inner(left, right, on) -> Join:
    return Join("inner", left, right, on)


def left(left, right, on) -> Join:
    return Join("left", left, right, on)


def right(left, right, on) -> Join:
    return Join("right", left, right, on)


def full(left, right, on) -> Join:
    return Join("full", left, right, on)


@dataclass(frozen=True)
class ViewSpec:
    """Aliases with their tables, the join tree, WHERE text and the select list."""

    tables: Mapping[str, Table]
    tree: str | Join
    select: Mapping[str, str]
    where: str = "true"

    def __post_init__(self):
        seen = list(_aliases(self.tree))
        if len(set(seen)) != len(seen):
            raise UnsupportedView("an alias is used twice in the join tree")
        if set(seen) != set(self.tables):
            raise UnsupportedView("the join tree and the tables name different aliases")
        if not self.select:
            raise UnsupportedView("the select list is empty")
        if any(n.startswith("__") for n in self.select):
            raise UnsupportedView("output names starting with __ are reserved")

    def to_json(self) -> str:
        def tree(t):
            if isinstance(t, Join):
                on = [list(c) if isinstance(c, tuple) else c for c in t.on]
                return {"kind": t.kind, "left": tree(t.left), "right": tree(t.right), "on": on}
            return t

        return json.dumps(
            {
                "tables": {a: [t.source, list(t.keys)] for a, t in self.tables.items()},
                "tree": tree(self.tree),
                "select": dict(self.select),
                "where": self.where,
            }
        )

    @staticmethod
    def from_json(text: str) -> ViewSpec:
        def tree(t):
            if isinstance(t, dict):
                on = tuple(tuple(c) if isinstance(c, list) else c for c in t["on"])
                return Join(t["kind"], tree(t["left"]), tree(t["right"]), on)
            return t

        d = json.loads(text)
        tables = {a: Table(source, keys) for a, (source, keys) in d["tables"].items()}
        return ViewSpec(tables, tree(d["tree"]), d["select"], d["where"])

    def sources(self) -> list[str]:
        return list(dict.fromkeys(t.source for t in self.tables.values()))


def _aliases(tree) -> Iterator[str]:
    if isinstance(tree, Join):
        yield from _aliases(tree.left)
        yield from _aliases(tree.right)
    else:
        yield tree


@dataclass(frozen=True)
class Condition:
    """One conjunct of an ON: an equality of two texts, or any text.

    ``names`` are the aliases it reads, ``columns`` the pairs of alias and column.
    """

    names: frozenset[str]
    left: str
    right: str | None = None
    left_names: frozenset[str] = frozenset()
    columns: frozenset[tuple[str, str]] = frozenset()

    @property
    def column(self) -> Column:
        if self.right is None:
            return F.expr(self.left)
        return F.expr(self.left) == F.expr(self.right)


@dataclass(frozen=True, eq=False)
class Node:
    """A resolved piece of the join tree; a leaf has an alias and no children."""

    aliases: tuple[str, ...]
    kind: str = ""
    left: Node | None = None
    right: Node | None = None
    on: tuple[Condition, ...] = ()

    @property
    def leaf(self) -> bool:
        return self.left is None

    @property
    def named(self) -> frozenset[str]:
        return frozenset().union(*[c.names for c in self.on])

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return [(c.left, c.right) for c in self.on if c.right is not None]

    @property
    def rest(self) -> list[str]:
        return [c.left for c in self.on if c.right is None]


@dataclass(frozen=True, eq=False)
class View:
    """A checked ``ViewSpec`` over given table schemas."""

    spec: ViewSpec
    root: Node
    schemas: Mapping[str, DataFrame] = field(repr=False)

    @property
    def aliases(self) -> tuple[str, ...]:
        return self.root.aliases

    def keys(self, alias: str) -> tuple[str, ...]:
        return self.spec.tables[alias].keys

    def source(self, alias: str) -> str:
        return self.spec.tables[alias].source

    def key_names(self, aliases: Sequence[str] | None = None) -> list[str]:
        """Names of the hidden key columns, for some or for all aliases."""
        wanted = self.aliases if aliases is None else [a for a in self.aliases if a in aliases]
        return [hidden(a, k) for a in wanted for k in self.keys(a)]

    def join_columns(self, alias: str) -> set[str]:
        """Columns of the alias that its key or an ON reads."""

        def read(node: Node) -> set[str]:
            if node.leaf:
                return set()
            here = {c for condition in node.on for a, c in condition.columns if a == alias}
            return here | read(node.left) | read(node.right)

        return read(self.root) | set(self.keys(alias))

    @property
    def outputs(self) -> list[str]:
        return list(self.spec.select)

    def result_texts(self, keep: str = KEEP) -> list[str]:
        """The select list and WHERE as select texts."""
        texts = [f"{e} as {quoted(n)}" for n, e in self.spec.select.items()]
        return [*texts, f"coalesce(cast(({self.spec.where}) as boolean), false) as {keep}"]

    @cached_property
    def shown_columns(self) -> dict[str, T.StructType] | None:
        """The columns of each alias that the select list or WHERE reads.

        None if these texts mean something else when each alias is a struct column (a column
        without its alias).
        """
        wide = _side_by_side([self.schemas[t.source].alias(a) for a, t in self.spec.tables.items()])
        plain = wide.selectExpr(*self.result_texts())
        columns = plain._jdf.queryExecution().analyzed().references().toSeq()
        read = [columns.apply(i) for i in range(columns.size())]
        read = {(c.qualifier().last(), c.name()) for c in read}
        out = {}
        for a in self.aliases:
            fields = [T.StructField(f.name, f.dataType) for f in self.schemas[self.source(a)].schema.fields if (a, f.name) in read]
            if fields:
                out[a] = T.StructType(fields)
        nulls = [f"{null_text(kind)} as {quoted(a)}" for a, kind in out.items()]
        try:
            apart = wide.selectExpr(*nulls, "1 as __one").selectExpr(*self.result_texts())
        except AnalysisException:
            return None
        return out if apart.dtypes == plain.dtypes else None

    def determines(self, term: frozenset[str], alias: str) -> bool:
        """Whether a tuple of the term meets one row of ``alias`` at most: ONs equate the whole
        key of ``alias`` with what only columns of the term tell."""
        keys = {f"{alias}.{k}": k for k in self.keys(alias)}

        def equal(node: Node) -> set[str]:
            if node.leaf:
                return set()
            found = equal(node.left) | equal(node.right)
            for c in node.on:
                if c.right is None:
                    continue
                for mine, other, names in ((c.left, c.right, c.names - c.left_names), (c.right, c.left, c.left_names)):
                    key = keys.get(mine.replace("`", "").strip())
                    if key and names <= term and self._compared_as_is(alias, key, other):
                        found.add(key)
            return found

        return set(self.keys(alias)) <= equal(self.root)

    def _compared_as_is(self, alias: str, key: str, other: str) -> bool:
        """Whether the key is compared without a conversion that makes different keys equal."""
        wide = _side_by_side([self.schemas[t.source].alias(a) for a, t in self.spec.tables.items()])
        a, b = self.schemas[self.source(alias)].schema[key].dataType, wide.select(F.expr(other)).schema[0].dataType
        exact = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.BinaryType, T.BooleanType)
        return (isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)) or (a == b and isinstance(a, exact))

    def certain_terms(self, alias: str) -> list[frozenset[str]]:
        """The terms of ``anchors`` whose tuples have no other partner in ``alias`` than the one they lose."""
        if self.shown_columns is None:
            return []
        return [t for t in self.anchors(alias) if self.determines(t, alias)]

    def has_label(self, *labels: frozenset[str]) -> Column:
        """Whether a working row contains exactly the aliases of one of the labels."""

        def text(label):
            return " and ".join(
                f"{quoted(hidden(a, self.keys(a)[0]))} is {'not ' if a in label else ''}null" for a in self.aliases
            )

        return F.expr(" or ".join(f"({text(label)})" for label in labels))

    @cached_property
    def terms(self) -> frozenset[frozenset[str]]:
        """The sets of aliases a row of the join tree can contain."""
        return frozenset(_terms(self.root))

    def terms_below(self, label: frozenset[str], without: str) -> list[frozenset[str]]:
        """The largest terms in ``label`` that lack ``without``.

        A row that loses (or finds) its partner in ``without`` changes exactly
        these: anything smaller stays covered by them.
        """
        under = [t for t in self.terms if without not in t and t < label]
        return sorted(
            (t for t in under if not any(t < u for u in under)), key=lambda t: sorted(t)
        )

    def anchors(self, alias: str) -> dict[frozenset[str], list[frozenset[str]]]:
        """Per largest term without ``alias``: the labels it is reached from."""
        out: dict[frozenset[str], list[frozenset[str]]] = {}
        for label in sorted((t for t in self.terms if alias in t), key=lambda t: sorted(t)):
            for term in self.terms_below(label, alias):
                out.setdefault(term, []).append(label)
        return out


def hidden(alias: str, key: str) -> str:
    """Name of the hidden column that keeps ``alias.key`` in stored rows; its length tells the alias."""
    return f"__{alias}__{key}" if "__" not in alias + key else f"__{len(alias)}_{alias}__{key}"


def _terms(node: Node) -> set[frozenset[str]]:
    if node.leaf:
        return {frozenset(node.aliases)}
    lefts, rights = _terms(node.left), _terms(node.right)
    out = {a | b for a in lefts for b in rights if node.named <= a | b}
    if node.kind in ("left", "full"):
        out |= lefts
    if node.kind in ("right", "full"):
        out |= rights
    return out


def bind(spec: ViewSpec, tables: Mapping[str, DataFrame]) -> View:
    """Resolve a spec against its tables and refuse what cannot be maintained.

    ``tables`` maps source names to DataFrames. Only their plans are looked at;
    nothing is read.
    """
    missing = [s for s in spec.sources() if s not in tables]
    if missing:
        raise UnsupportedView(f"no table given for {', '.join(missing)}")
    for alias, table in spec.tables.items():
        lacking = [k for k in table.keys if k not in tables[table.source].columns]
        if lacking:
            raise UnsupportedView(f"{alias} has no column {', '.join(lacking)}")
    frames = {a: tables[t.source].alias(a) for a, t in spec.tables.items()}
    _check_expression(spec, frames)
    root = _resolve(spec.tree, frames)
    return View(spec, root, {s: tables[s] for s in spec.sources()})


def _side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """All columns of the frames in one plan that is analyzed, never run."""
    return reduce(lambda a, b: a.join(b, F.lit(True)), frames)


def _check_expression(spec: ViewSpec, frames: Mapping[str, DataFrame]) -> None:
    wide = _side_by_side(list(frames.values()))
    try:
        condition = wide.select(F.expr(spec.where).cast("boolean").alias("c"))
        outputs = wide.select(*[F.expr(e).alias(n) for n, e in spec.select.items()])
    except AnalysisException as error:
        raise UnsupportedView(f"cannot resolve the view: {error}") from error
    for frame in (condition, outputs):
        plan = frame._jdf.queryExecution().analyzed()
        _check_plan(plan)
        below = plan.child().nodeName() if plan.nodeName() == "Project" else plan.nodeName()
        if below not in ("Join", "SubqueryAlias"):
            raise UnsupportedView(
                "aggregates, window functions and generators cannot be maintained; "
                "use a full refresh for such a view"
            )


def _check_plan(plan) -> None:
    if not plan.deterministic():
        raise UnsupportedView("expressions must be deterministic")
    if not plan.subqueries().isEmpty():
        raise UnsupportedView("subqueries read tables whose changes would not be seen")


def _resolve(tree, frames: Mapping[str, DataFrame]) -> Node:
    if not isinstance(tree, Join):
        return Node((tree,))
    left_node, right_node = _resolve(tree.left, frames), _resolve(tree.right, frames)
    aliases = left_node.aliases + right_node.aliases
    inside = {a: frames[a] for a in aliases}
    wide = _side_by_side(list(inside.values()))
    on = []
    for texts in [part for condition in tree.on for part in _conjuncts(condition, wide)]:
        read = [_read_columns(text, wide) for text in texts]
        names = [frozenset(alias for alias, _ in r) for r in read]
        both, columns = frozenset().union(*names), frozenset().union(*read)
        lefts, rights = set(left_node.aliases), set(right_node.aliases)
        if len(texts) == 2 and all(names) and names[0] <= rights and names[1] <= lefts:
            texts, names = texts[::-1], names[::-1]
        if len(texts) == 1:
            on.append(Condition(both, texts[0], columns=columns))
        elif all(names) and names[0] <= lefts and names[1] <= rights:
            on.append(Condition(both, *texts, names[0], columns))
        else:
            on.append(Condition(both, f"({texts[0]}) = ({texts[1]})", columns=columns))
    node = Node(aliases, tree.kind, left_node, right_node, tuple(on))
    for side in (left_node, right_node):
        if not node.named & set(side.aliases):
            raise UnsupportedView(f"ON must name an alias of each side: {tree.on}")
    for alias in node.named:
        if not _rejects_nulls(node, alias, inside):
            raise UnsupportedView(f"ON must not accept NULLs of {alias}: {tree.on}")
    return node


def _conjuncts(condition: str | tuple, wide: DataFrame) -> list[list[str]]:
    """The parts of a condition that must all hold: [text], or [left, right] of an equality.

    The condition is taken apart after Spark has resolved it. Each part becomes a text
    again; if one of them were not resolved to the same, the condition stays whole.
    """
    if not isinstance(condition, str):
        return [list(condition)]

    def resolved(text: str):
        plan = wide.select(F.expr(text).alias("c"))._jdf.queryExecution().analyzed()
        return plan.expressions().apply(0).child()

    def conjuncts(e) -> list:
        if e.getClass().getSimpleName() != "And":
            return [e]
        return conjuncts(e.left()) + conjuncts(e.right())

    try:
        parts = conjuncts(resolved(condition))
    except AnalysisException as error:
        raise UnsupportedView(f"cannot resolve ON: {error}") from error
    out = []
    for e in parts:
        equality = e.getClass().getSimpleName() == "EqualTo"
        texts = [x.sql() for x in ((e.left(), e.right()) if equality else (e,))]
        try:
            same = resolved(" = ".join(f"({t})" for t in texts) if equality else texts[0])
        except PySparkException:
            return [[condition]]
        if not e.semanticEquals(same):
            return [[condition]]
        out.append(texts)
    return out


def _read_columns(text: str, wide: DataFrame) -> frozenset[tuple[str, str]]:
    """The (alias, column) pairs the text reads, as Spark's analyzer resolves it."""
    try:
        plan = wide.select(F.expr(text))._jdf.queryExecution().analyzed()
    except AnalysisException as error:
        raise UnsupportedView(f"cannot resolve ON: {error}") from error
    _check_plan(plan)
    columns = plan.references().toSeq()
    read = [columns.apply(i) for i in range(columns.size())]
    return frozenset((c.qualifier().last(), c.name()) for c in read)


def _rejects_nulls(node: Node, alias: str, frames: Mapping[str, DataFrame]) -> bool:
    """Whether Catalyst can prove the ON not true when ``alias`` is all NULL."""
    frame = frames[alias]
    nulls = frame.select(*[typed_null(f.dataType).alias(f.name) for f in frame.schema.fields])
    others = [f for a, f in frames.items() if a != alias]
    wide = _side_by_side([nulls.alias(alias), *others]).where(all_of(c.column for c in node.on))
    plan = wide._jdf.queryExecution().optimizedPlan()
    return plan.nodeName() == "LocalRelation" and plan.maxRows().isDefined() and plan.maxRows().get() == 0
