"""The small order, position and article views, one change per case."""

import pytest
from conftest import assert_same_bag

from tideview import Change, Table, ViewSpec, bind, build_view, left, maintain, tables_after, visible

ORDER = "id bigint"
POSITION = "article_id bigint, order_id bigint, sortIndex int, amount int"
ARTICLE = "id bigint, name string"

ON_ORDER = "ordpos.order_id = ord.id"
TABLES = {
    "ord": Table("_order", "id"),
    "ordpos": Table("order_position", ["article_id", "order_id"]),
    "art": Table("article", "id"),
}
TWO = ViewSpec(
    {a: TABLES[a] for a in ("ord", "ordpos")},
    left("ord", "ordpos", ON_ORDER),
    {"ord_id": "ord.id", "article_id": "ordpos.article_id", "amount": "ordpos.amount"},
    "ord.id > 0",
)
THREE = ViewSpec(
    TABLES,
    left(left("ord", "ordpos", ON_ORDER), "art", "art.id = ordpos.article_id"),
    {"art_id": "art.id", "ord_id": "ord.id", "name": "art.name", "amount": "ordpos.amount"},
    "ord.id > 0",
)


def P(o, a):
    return (a, o, None, None)


def O(*ids):  # noqa: E743
    return [(i,) for i in ids]


def A(*ids):
    return [(i, f"Article {i}") for i in ids]


# name: orders, articles, positions, then (source, deleted, inserted) in order
CASES = {
    "insert_root": (O(1), A(1), [P(1, 1)], [("_order", None, O(2))]),
    "delete_empty_root": (O(1, 2), A(1), [P(1, 1)], [("_order", O(2), None)]),
    "delete_root": (
        O(1, 2), A(1), [P(1, 1), P(2, 1)], [("order_position", [P(2, 1)], None), ("_order", O(2), None)]
    ),
    "delete_sub_to_empty": (O(1, 2), A(1), [P(1, 1), P(2, 1)], [("order_position", [P(2, 1)], None)]),
    "delete_sub": (
        O(1, 2), A(1, 2), [P(1, 1), P(2, 1), P(2, 2)], [("order_position", [P(1, 1), P(2, 1)], None)]
    ),
    "insert_sub_to_empty": (O(1, 2), A(1), [P(1, 1)], [("order_position", None, [P(2, 1)])]),
    "insert_sub": (O(1, 2), A(1, 2), [P(1, 1), P(2, 1)], [("order_position", None, [P(2, 2)])]),
    # Beyond the usual ones: other tables, other operations, nothing there.
    "delete_article": (O(1), A(1, 2), [P(1, 1), P(1, 2)], [("article", A(2), None)]),
    "insert_article": (O(1), A(1), [P(1, 1), P(1, 2)], [("article", None, A(2))]),
    "move_position": (O(1, 2), A(1), [P(1, 1)], [("order_position", [P(1, 1)], [P(2, 1)])]),
    "rename_article": (O(1), A(1), [P(1, 1)], [("article", A(1), [(1, "new name")])]),
    "first_rows": ([], [], [], [("_order", None, O(1))]),
    "nothing_changes": (O(1), A(1), [P(1, 1)], [("_order", [], [])]),
    "order_outside_view": (O(1), A(1), [P(1, 1)], [("_order", None, O(-1))]),
}


@pytest.mark.parametrize("spec", [TWO, THREE], ids=["two", "three"])
@pytest.mark.parametrize("case", CASES)
def test_case(spark, staging, case, spec):
    orders, articles, positions, changes = CASES[case]
    schemas = {"_order": ORDER, "article": ARTICLE, "order_position": POSITION}
    data = {"_order": orders, "article": articles, "order_position": positions}
    frame = lambda s, rows: spark.createDataFrame(rows, schemas[s]).coalesce(1)
    tables = {s: frame(s, data[s]) for s in spec.sources()}
    view = bind(spec, tables)
    changes = [c for c in changes if c[0] in spec.sources()]
    stored = build_view(view)
    for source, deleted, inserted in changes:
        change = {
            source: Change(*[None if rows is None else frame(source, rows) for rows in (deleted, inserted)])
        }
        stored = maintain(view, stored, tables, change, staging)
        tables = tables_after(view, tables, change)
    assert_same_bag(visible(view, stored), visible(view, build_view(view, tables)))
