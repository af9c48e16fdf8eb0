"""A view from SQL text: Spark analyzes the text, and its plan is read as a ``ViewSpec``.

Tables are named in braces and need an alias::

    select o.id as ord_id, p.amount from {orders} o left join {positions} p on p.order_id = o.id

Only a select list over a filter over joins of tables is read; anything else is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tideview.plans.spec import Join, Table, UnsupportedView, ViewSpec

_KINDS = {"INNER": "inner", "LEFT OUTER": "left", "RIGHT OUTER": "right", "FULL OUTER": "full"}


def view_from_sql(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]
) -> ViewSpec:
    """The spec of a view given as SQL text; ``keys`` are those of the tables. Nothing is read."""
    mark = f"tideview_{uuid.uuid4().hex}_"
    names = {name: f"{mark}{i}" for i, name in enumerate(tables)}
    try:
        for name, view in names.items():
            tables[name].createOrReplaceTempView(view)
        query = text
        for name, view in names.items():
            query = query.replace("{" + name + "}", view)
        try:
            plan = spark.sql(query)._jdf.queryExecution().analyzed()
        except AnalysisException as error:
            raise UnsupportedView(f"cannot resolve the view: {error}") from error
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
    return _Reader({view: name for name, view in names.items()}, keys).spec(plan)


class _Reader:
    def __init__(self, sources: Mapping[str, str], keys: Mapping[str, Sequence[str]]):
        self.sources, self.keys = sources, keys
        self.tables: dict[str, Table] = {}

    def spec(self, plan) -> ViewSpec:
        if plan.nodeName() != "Project":
            raise UnsupportedView(f"a maintained view is a select list over joins, not {plan.nodeName()}")
        items, select = plan.projectList(), {}
        for i in range(items.size()):
            item = items.apply(i)
            value = item.child() if item.getClass().getSimpleName() == "Alias" else item
            if item.name() in select:
                raise UnsupportedView(f"two outputs are called {item.name()}")
            select[item.name()] = value.sql()
        below, where = plan.child(), "true"
        if below.nodeName() == "Filter":
            below, where = below.child(), below.condition().sql()
        tree = self.tree(below)
        return ViewSpec(self.tables, tree, select, where)

    def tree(self, plan) -> str | Join:
        if plan.nodeName() == "SubqueryAlias":
            return self.table(plan)
        if plan.nodeName() != "Join":
            raise UnsupportedView(f"joins of tables can be maintained, not {plan.nodeName()}")
        kind = plan.joinType().sql()
        if kind not in _KINDS or not plan.condition().isDefined():
            raise UnsupportedView(f"a {kind.lower()} join with an ON is needed")
        left, right = self.tree(plan.left()), self.tree(plan.right())
        return Join(_KINDS[kind], left, right, plan.condition().get().sql())

    def table(self, plan) -> str:
        alias, inner = plan.alias(), plan.child()
        if inner.nodeName() != "SubqueryAlias" or inner.alias() not in self.sources:
            raise UnsupportedView(f"{alias} is not a table in braces with an alias")
        if alias in self.tables:
            raise UnsupportedView(f"the alias {alias} is used twice")
        source = self.sources[inner.alias()]
        self.tables[alias] = Table(source, self.keys[source])
        return alias
