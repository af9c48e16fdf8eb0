"""Views over the sample tables, used by the checks, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideview.plans.spec import Table, ViewSpec, full, inner, left, right
from tideview.sources.tables import base_table

KEYS = {
    "nation": ("n_nationkey",),
    "supplier": ("s_suppkey",),
    "customer": ("c_custkey",),
    "orders": ("o_orderkey",),
    # The order and line number alone are not unique in the sample data.
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"),
    "part": ("p_partkey",),
}

ON_ORDER = [("o.o_orderkey", "l.l_orderkey")]
ON_PART = [("l.l_partkey", "p.p_partkey")]
ON_CUSTOMER = [("c.c_custkey", "o.o_custkey")]
# An order line below this quantity stays without its order in the full join.
ON_LARGE = [*ON_ORDER, "l.l_quantity > 10"]

ALIASES = {
    "o": "orders", "l": "lineitem", "p": "part", "c": "customer", "n": "nation", "s": "supplier", "q": "part"
}
LINES = {"o_orderkey": "o.o_orderkey", "l_partkey": "l.l_partkey", "l_quantity": "l.l_quantity"}
TOTALS = {"o_orderkey": "o.o_orderkey", "o_totalprice": "o.o_totalprice"}


def _spec(aliases: str, tree, select, where="true") -> ViewSpec:
    return ViewSpec({a: Table(ALIASES[a], KEYS[ALIASES[a]]) for a in aliases}, tree, select, where)


LEFT2 = _spec("ol", left("o", "l", ON_ORDER), LINES, "o.o_orderkey > 0")
LEFT3 = _spec(
    "olp",
    left(left("o", "l", ON_ORDER), "p", ON_PART),
    {
        "p_partkey": "p.p_partkey",
        "o_orderkey": "o.o_orderkey",
        "p_name": "p.p_name",
        "l_quantity": "l.l_quantity",
    },
    "o.o_orderkey > 0",
)
FULL2 = _spec("ol", full("o", "l", ON_LARGE), {**LINES, "l_orderkey": "l.l_orderkey"})
RIGHT2 = _spec("ol", right("l", "o", ON_ORDER), LINES)
INNER2 = _spec("ol", inner("o", "l", ON_ORDER), LINES)
BUSHY3 = _spec(
    "col",
    left("c", inner("o", "l", ON_ORDER), ON_CUSTOMER),
    {"c_custkey": "c.c_custkey", "c_name": "c.c_name", **LINES},
)
CHAIN3 = _spec(
    "nco",
    left(left("n", "c", [("n.n_nationkey", "c.c_nationkey")]), "o", ON_CUSTOMER),
    {"n_name": "n.n_name", "c_custkey": "c.c_custkey", **TOTALS},
)
# No equality at all: each supplier with the nations numbered below its own.
THETA2 = _spec(
    "sn",
    left("s", "n", ["n.n_nationkey < s.s_nationkey"]),
    {"s_suppkey": "s.s_suppkey", "n_name": "n.n_name"},
)
# Each order with the customers whose balance is within one of a fiftieth of its price.
BAND2 = _spec(
    "oc",
    left("o", "c", "c.c_acctbal < o.o_totalprice / 50 + 1 and c.c_acctbal > o.o_totalprice / 50 - 1"),
    {"o_orderkey": "o.o_orderkey", "o_totalprice": "o.o_totalprice", "c_custkey": "c.c_custkey", "c_acctbal": "c.c_acctbal"},
)
# The same table twice: each part with the next one if that is of the same kind.
SELF2 = _spec(
    "pq",
    full("p", "q", [("p.p_partkey + 1", "q.p_partkey"), ("p.p_type", "q.p_type")]),
    {"p_partkey": "p.p_partkey", "next_partkey": "q.p_partkey", "next_name": "q.p_name"},
)
# One text with an equality among other conditions.
MIXED_ON = _spec("ol", left("o", "l", "l.l_quantity > 10 and (l.l_orderkey = `o`.o_orderkey) and l.l_tax < 0.07"), LINES)

SHAPES = {
    "left2": LEFT2,
    "left3": LEFT3,
    "full2": FULL2,
    "right2": RIGHT2,
    "inner2": INNER2,
    "bushy3": BUSHY3,
    "chain3": CHAIN3,
    "theta2": THETA2,
    "self2": SELF2,
    "mixed_on": MIXED_ON,
}


def load(spark: SparkSession, folder: str, spec: ViewSpec) -> dict[str, DataFrame]:
    """The tables a view reads."""
    return {s: base_table(spark, folder, s) for s in spec.sources()}
