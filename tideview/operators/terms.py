"""Which tables the rows of an outer-join result come from.

The label of a row is the set of tables present in it. ``keys_by_table`` maps a
table's name to the columns that identify its rows in the data at hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.functions.expressions import keys_match, null_when, quoted, typed_null
from tideview.plans.spec import KEEP, View, hidden
from tideview.plans.view import Frames, working_rows

Keys = Mapping[str, Sequence[str]]


def view_keys(view: View) -> dict[str, list[str]]:
    """The hidden key columns of a view's stored rows, per alias."""
    return {a: [hidden(a, k) for k in view.keys(a)] for a in view.aliases}


def term_label(keys_by_table: Keys) -> Column:
    """Names of the tables present in a row, joined by ``+``."""
    return F.concat_ws(
        "+", *[F.when(_present(keys), F.lit(name)) for name, keys in keys_by_table.items()]
    )


def _present(keys: Sequence[str]) -> Column:
    return F.col(quoted(keys[0])).isNotNull()


def term_profile(rows: DataFrame, keys_by_table: Keys) -> DataFrame:
    """How many rows there are per label."""
    return rows.groupBy(term_label(keys_by_table).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def predicate_null_profile(view: View, frames: Frames) -> DataFrame:
    """Per label: rows before WHERE and rows it keeps.

    A table is rejected by WHERE when it is NULL if no label lacking it keeps rows.
    """
    rows = working_rows(view, frames)
    return rows.groupBy(term_label(view_keys(view)).alias("term")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(KEEP)).alias("n_kept")
    )


def null_variants(
    rows: DataFrame,
    columns_by_table: Keys,
    null_sets: Iterable[Iterable[str]],
    include_row: bool = False,
) -> DataFrame:
    """Per row and per set of tables a copy with these tables' columns NULL.

    One pass: the copies are an array of rows built in place.
    """
    sets = [frozenset(s) for s in null_sets]
    if include_row:
        sets = [frozenset(), *sets]
    table_of = {c: t for t, columns in columns_by_table.items() for c in columns}
    copies = []
    for nulled in sets:
        copies.append(
            F.struct(
                *[
                    (typed_null(f.dataType) if table_of.get(f.name) in nulled else F.col(quoted(f.name))).alias(
                        f.name
                    )
                    for f in rows.schema.fields
                ]
            )
        )
    return rows.select(F.explode(F.array(*copies)).alias("v")).select("v.*")


def null_by_flag(rows: DataFrame, columns_by_table: Keys, flags: Mapping[str, Column]) -> DataFrame:
    """Set a table's columns to NULL in the rows where its flag holds."""
    table_of = {c: t for t, columns in columns_by_table.items() for c in columns}
    return rows.select(
        *[
            null_when(flags[table_of[c]], F.col(quoted(c))).alias(c)
            if table_of.get(c) in flags
            else F.col(quoted(c))
            for c in rows.columns
        ]
    )


def remove_subsumed(
    rows: DataFrame, keys_by_table: Keys, labels: Iterable[Iterable[str]] | None = None
) -> DataFrame:
    """Drop a row when another one has the same tables' rows and more.

    ``labels`` may name the labels that occur; else they are counted first, one number for each to the driver.

    Together with a union this is the minimum union by which an outer join can be
    put together from inner joins. Only labels that occur and lie within another that occurs can be covered; a row is
    copied (keys only) once for each of these below its own label. The input is scanned twice, and its keys once more for the labels.
    """
    names = list(keys_by_table)
    bit = {t: 1 << i for i, t in enumerate(names)}
    mask = reduce(lambda a, b: a + b, [F.when(_present(keys_by_table[t]), bit[t]).otherwise(0) for t in names])
    if labels is None:
        occur = {r[0] for r in rows.select(mask.cast("long")).distinct().take(1 << min(len(names), 30))}
        covered = sorted(x for x in occur if x and any(x & m == x for m in occur - {x}))
    else:
        covered = sorted({sum(bit[t] for t in set(label)) for label in labels} - {0, (1 << len(names)) - 1})
    if not covered:
        return rows
    keys = [(k, bit[t]) for t in names for k in keys_by_table[t]]

    def copy(label: int) -> Column:
        values = [F.col(quoted(k)) if label & b else typed_null(rows.schema[k].dataType) for k, b in keys]
        more = (F.col("__mask").bitwiseAND(label) == label) & (F.col("__mask") != label)
        return F.when(more, F.struct(*[v.alias(f"__w{i}") for i, v in enumerate(values)]))

    marked = rows.withColumn("__mask", mask.cast("long"))
    copies = F.explode(F.array(*map(copy, covered))).alias("__v")
    tuples = marked.select(copies).where("__v is not null").select("__v.*").distinct()
    return rows.join(tuples, F.expr(keys_match([k for k, _ in keys], "__w", "<=>")), "left_anti")
