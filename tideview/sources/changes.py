"""Change feeds: rows ``op, before, after`` with op ``I``, ``U`` or ``D``.

``before`` and ``after`` are structs with the table's columns; ``before`` is
NULL for an insert and ``after`` for a delete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import (
    all_of,
    cols,
    keys_match,
    null_safe_on,
    quoted,
    renamed,
    row_of,
    rows_differ,
    typed_null,
)
from tideview.operators.digests import where_they_differ


def split_changes(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feed as (deleted rows, inserted rows); an update counts as both.

    An op that is none of I, U and D fails the job.
    """
    deleted = feed.where(_known_op(F.col("op").isin("D", "U"))).select("before.*")
    inserted = feed.where(_known_op(F.col("op").isin("I", "U"))).select("after.*")
    return deleted, inserted


def _known_op(value: Column) -> Column:
    """The value, or an error in a row whose op is unknown."""
    op = F.coalesce(F.col("op"), F.lit("NULL"))
    return F.when(op.isin("I", "U", "D"), value).otherwise(F.raise_error(F.concat(F.lit("unknown op in a change feed: "), op)))


def changes_of(deleted: DataFrame | None, inserted: DataFrame | None) -> DataFrame:
    """A feed of deletes and inserts (no updates) from two row sets."""
    parts = []
    if deleted is not None:
        row = row_of(deleted.columns)
        parts.append(
            deleted.select(F.lit("D").alias("op"), row.alias("before"), typed_row(deleted).alias("after"))
        )
    if inserted is not None:
        row = row_of(inserted.columns)
        parts.append(
            inserted.select(F.lit("I").alias("op"), typed_row(inserted).alias("before"), row.alias("after"))
        )
    if not parts:
        raise ValueError("nothing given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def typed_row(df: DataFrame) -> Column:
    """A NULL struct with the columns of ``df``."""
    return typed_null(df.schema)


def apply_changes(
    base: DataFrame,
    deleted: DataFrame | None,
    inserted: DataFrame | None,
    keys: Sequence[str],
) -> DataFrame:
    """The table after the change.

    Rows go by key, so only the key columns of ``deleted`` are shuffled or
    broadcast. A row that is in both sets is an update and ends up with its new
    values.
    """
    out = base
    if deleted is not None:
        gone = deleted.selectExpr(*renamed(keys, "__gone"))
        out = out.join(gone, F.expr(keys_match(keys, "__gone")), "left_anti")
    if inserted is not None:
        out = out.unionByName(inserted)
    return out


class BadChange(ValueError):
    """A batch of changes that a table cannot take; nothing of it was applied."""


def as_table_rows(rows: DataFrame, schema: T.StructType, source: str) -> DataFrame:
    """``rows`` with the table's columns and types.

    Types are widened where no value can be lost; any other difference is refused.
    """
    if sorted(rows.columns) != sorted(schema.fieldNames()):
        raise BadChange(f"rows for {source} do not have its columns")
    return rows.select(*[_widened(rows, f, source) for f in schema.fields])


def _widened(rows: DataFrame, field: T.StructField, source: str) -> Column:
    given, column = rows.schema[field.name].dataType, F.col(quoted(field.name))
    if given == field.dataType:
        return column
    whole = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    wider = type(given) in whole and type(field.dataType) in whole[whole.index(type(given)) :] if type(given) in whole else False
    wider |= isinstance(given, T.FloatType) and isinstance(field.dataType, T.DoubleType)
    wider |= type(given) in whole[:3] and isinstance(field.dataType, T.DoubleType)
    wider |= isinstance(given, T.NullType)
    if isinstance(given, T.DecimalType) and isinstance(field.dataType, T.DecimalType):
        more = field.dataType.precision - field.dataType.scale >= given.precision - given.scale
        wider |= more and field.dataType.scale >= given.scale
    # Nested types may differ in what can be NULL, not else.
    if given.simpleString() != field.dataType.simpleString() and not wider:
        raise BadChange(f"{source}.{field.name} is {field.dataType.simpleString()}, not {given.simpleString()}")
    return column.cast(field.dataType).alias(field.name)


def deleted_images(table: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table's own rows for the keys that are to go. Keys that it lacks go nowhere;
    what else the given rows hold does not matter."""
    wanted = deleted.selectExpr(*renamed(keys, "__gone"))
    return table.join(wanted, F.expr(keys_match(keys, "__gone")), "left_semi")


def refused_inserts(
    table: DataFrame, deleted: DataFrame | None, inserted: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Keys that the table cannot take: NULL in part, doubled among ``inserted``, or in the
    table already and not among ``deleted``. Columns are the keys and ``problem``."""
    names = list(keys)
    counted = inserted.groupBy(*cols(names)).agg(F.count(F.lit(1)).alias("__n"))
    null = F.lit(False)
    for c in cols(names):
        null |= c.isNull()
    problem = F.when(null, "NULL").when(F.col("__n") > 1, "doubled")
    out = counted.select(*cols(names), problem.alias("problem")).where("problem is not null")
    there = table.select(*cols(names))
    new = counted.select(*[c.alias(f"__new{i}") for i, c in enumerate(cols(names))])
    there = there.join(new, F.expr(keys_match(names, "__new")), "left_semi")
    if deleted is not None:
        gone = deleted.selectExpr(*renamed(names, "__gone"))
        there = there.join(gone, F.expr(keys_match(names, "__gone")), "left_anti")
    return out.unionByName(there.withColumn("problem", F.lit("exists")))


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], digests: bool = False) -> DataFrame:
    """Change feed that turns ``old`` into ``new``; both have unique ``keys``.

    With ``digests`` both are first summed up by bucket of the key, at once, and only
    buckets that differ are joined. That pays for large tables with few changes.
    """
    payload = old.columns
    if digests:
        old, new = where_they_differ(old, new.select(*cols(payload)), keys)
    left = old.select(*cols(keys), row_of(payload).alias("before"))
    right = new.select(*cols(keys), row_of(payload).alias("after"))
    left = left.select(*[c.alias(f"__l{i}") for i, c in enumerate(cols(keys))], "before")
    right = right.select(*[c.alias(f"__r{i}") for i, c in enumerate(cols(keys))], "after")
    on = all_of(F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(keys)))
    before, after = F.col("before"), F.col("after")
    fields_before = [before.getField(c) for c in payload]
    fields_after = [after.getField(c) for c in payload]
    op = (
        F.when(before.isNull(), F.lit("I"))
        .when(after.isNull(), F.lit("D"))
        .when(rows_differ(fields_before, fields_after), F.lit("U"))
    )
    return (
        left.join(right, on, "full")
        .select(op.alias("op"), "before", "after")
        .where(F.col("op").isNotNull())
    )


def net_changes(feed: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One change per key: from its first before-image to its last after-image.

    ``keys`` are field names of the images. An update that changes the key is a
    delete of the old key and an insert of the new one, and is split first so
    that each key's history is whole. ``min_by``/``max_by`` are combined before
    the shuffle, so a key with very many changes costs no single task.
    """
    before, after = F.col("before"), F.col("after")
    key_before = [before.getField(k) for k in keys]
    key_after = [after.getField(k) for k in keys]
    moved = (F.col("op") == "U") & ~all_of(a == b for a, b in zip(key_before, key_after))
    row_type = feed.schema["before"].dataType
    null_row = typed_null(row_type)
    order = F.col(quoted(seq))
    # Each change as one or two (step, before, after) pieces.
    piece = lambda step, b, a: F.struct(
        F.lit(step).alias("step"), b.alias("before"), a.cast(row_type).alias("after")
    )
    pieces = _known_op(
        F.when(moved, F.array(piece(0, before, null_row), piece(1, null_row, after))).otherwise(
            F.array(piece(0, before, after))
        )
    )
    flat = feed.select(order.alias("__seq"), F.explode(pieces).alias("__p")).select(
        F.struct("__seq", F.col("__p.step")).alias("__at"),
        # Wrapped, as min_by/max_by must keep a NULL image as a value.
        F.struct(F.col("__p.before").alias("row")).alias("__before"),
        F.struct(F.col("__p.after").alias("row")).alias("__after"),
        *[
            F.coalesce(F.col("__p.before").getField(k), F.col("__p.after").getField(k)).alias(f"__k{i}")
            for i, k in enumerate(keys)
        ],
    )
    folded = flat.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(
        F.min_by("__before", "__at").getField("row").alias("before"),
        F.max_by("__after", "__at").getField("row").alias("after"),
    )
    fields = [f.name for f in row_type.fields]
    op = (
        F.when(before.isNull() & after.isNull(), F.lit(None))
        .when(before.isNull(), F.lit("I"))
        .when(after.isNull(), F.lit("D"))
        .when(
            ~null_safe_on([before.getField(c) for c in fields], [after.getField(c) for c in fields]),
            F.lit("U"),
        )
    )
    return folded.select(op.alias("op"), "before", "after").where(F.col("op").isNotNull())
