"""Small column expressions the operators are written with.

Everything here is a built-in Spark expression, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction of a list of conditions; TRUE for an empty list."""
    conditions = list(conditions)
    if not conditions:
        return F.lit(True)
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    """Disjunction of a list of conditions; FALSE for an empty list."""
    conditions = list(conditions)
    if not conditions:
        return F.lit(False)
    return reduce(lambda a, b: a | b, conditions)


def null_safe_on(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """``left IS NOT DISTINCT FROM right``, column by column.

    A conjunction of ``<=>`` is planned as an equi-join (hash or sort-merge);
    its negation is not, so anti joins are written with this condition too.
    """
    if len(left) != len(right):
        raise ValueError("both sides need the same number of columns")
    return all_of(a.eqNullSafe(b) for a, b in zip(left, right))


def rows_differ(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """``left IS DISTINCT FROM right`` as a row filter."""
    return ~null_safe_on(left, right)


def typed_null(data_type: T.DataType) -> Column:
    """``CAST(NULL AS t)``."""
    return F.lit(None).cast(data_type)


def null_when(flag: Column, column: Column) -> Column:
    """The column, or NULL where the flag holds."""
    return F.when(~flag, column)


def row_of(columns: Iterable[str]) -> Column:
    """A row value made of the named columns."""
    return F.struct(*[F.col(quoted(c)) for c in columns])


def quoted(name: str) -> str:
    """Column name quoted, so that dots and spaces in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string literal in SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def renamed(names: Iterable[str], prefix: str) -> list[str]:
    """Select texts that number the columns: ``prefix0``, ``prefix1`` and so on."""
    return [f"{quoted(n)} as {prefix}{i}" for i, n in enumerate(names)]


def keys_match(names: Sequence[str], prefix: str, operator: str = "=") -> str:
    """Condition text: each column equals its renamed counterpart; ``<=>`` for null-safe."""
    return " and ".join(f"{quoted(n)} {operator} {prefix}{i}" for i, n in enumerate(names)) or "true"


def null_text(data_type: T.DataType) -> str:
    return f"cast(null as {type_text(data_type)})"


def type_text(data_type: T.DataType) -> str:
    """The type as SQL text, whatever its fields are called."""
    if isinstance(data_type, T.StructType):
        return f"struct<{', '.join(f'{quoted(f.name)}: {type_text(f.dataType)}' for f in data_type.fields)}>"
    if isinstance(data_type, T.ArrayType):
        return f"array<{type_text(data_type.elementType)}>"
    if isinstance(data_type, T.MapType):
        return f"map<{type_text(data_type.keyType)}, {type_text(data_type.valueType)}>"
    return data_type.simpleString()


def cols(names: Iterable[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]
