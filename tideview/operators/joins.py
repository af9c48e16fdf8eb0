"""Joins that hold up when one key carries a large share of the rows.

Spark's adaptive execution splits a hot key of an inner join, and of the
preserved side of an outer join (in a chain of joins on one key only with
``spark.sql.adaptive.forceOptimizeSkewedJoin``, which a workspace sets). It cannot split the side an outer join fills
with NULLs. ``skew_safe_join`` covers that case, and conditions without any
equality, by spreading rows over salts, or over ranges of values where inequalities allow it
(``ranges``); the result is that of the plain join.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import all_of, any_of, keys_match, null_safe_on, renamed, typed_null
from tideview.operators.ranges import find_band, range_join
from tideview.sources.storage import broadcast_limit, plan_bytes, row_width

# Settings, read from the session (all may be set with spark.conf.set).
SKEW_BYTES = "spark.tideview.skewBytes"  # inputs below this are not inspected
HOT_SHARE = "spark.tideview.hotShare"  # share of its side's rows that makes a key hot
TASK_BYTES = "spark.tideview.taskBytes"  # bytes of one key, as rows times their width, that make it hot
SALTS = "spark.tideview.salts"  # pieces a hot key is cut into, at least
RANGE_BYTES = "spark.tideview.rangeBytes"  # sides above this meet by ranges of values; Spark's broadcast bound if not set
DEFAULTS = {SKEW_BYTES: str(16 << 20), HOT_SHARE: "0.005", TASK_BYTES: str(256 << 20), SALTS: "64"}

# A sketch of this many counters finds keys of about 1 in 30,000 rows; more hot keys than the second are not spread.
_TRACKED, _MOST_HOT = 1 << 17, 20_000
_MOST_SALTS = 4096


def setting(df: DataFrame, name: str) -> float:
    return float(df.sparkSession.conf.get(name, DEFAULTS[name]))


def hot_keys(df: DataFrame, keys: Sequence[Column], share: float) -> list[int]:
    """Hashes of the keys that hold at least about ``share`` of the rows.

    One pass over the key columns with a bounded sketch per task. At most
    ``2 / share`` hashes reach the driver, whatever the size of the table. An
    overestimate only means that one more key is spread.
    """
    most = int(2 / share) + 1
    tracked = 1 << max(10, (8 * most).bit_length())
    row = (
        df.select(F.xxhash64(*keys).alias("h"))
        .agg(F.expr(f"approx_top_k(h, {most}, {tracked})").alias("top"), F.count("*").alias("n"))
        .first()
    )
    return [t["item"] for t in (row["top"] or []) if t["count"] >= share * row["n"] and t["count"] > 1]


def heavy_keys(df: DataFrame, keys: Sequence[Column], share: float, task_bytes: float) -> tuple[list[int], float]:
    """Hashes of the keys too large for one task, and the bytes of the largest of them.

    A key is too large with ``share`` of the rows, or with ``task_bytes`` as rows times
    their width: what a key costs does not shrink because its files compress well or
    the table is huge. The sketch is of one size whatever the table.
    """
    width = row_width(df)
    row = (
        df.select(F.xxhash64(*keys).alias("h"))
        .agg(F.expr(f"approx_top_k(h, {_MOST_HOT}, {_TRACKED})").alias("top"), F.count("*").alias("n"))
        .first()
    )
    least = max(2.0, min(share * row["n"], task_bytes / width))
    found = [t for t in (row["top"] or []) if t["count"] >= least]
    return [t["item"] for t in found], max((t["count"] * width for t in found), default=0.0)


def skew_safe_join(
    left: DataFrame,
    right: DataFrame,
    pairs: Sequence[tuple[str, str]],
    rest: Sequence[str],
    how: str,
    left_id: Sequence[str],
    right_id: Sequence[str],
    left_bytes: int | None = None,
    right_bytes: int | None = None,
    left_unique: bool = False,
    right_unique: bool = False,
) -> DataFrame:
    """``left JOIN right ON`` equal ``pairs`` and ``rest``.

    ``left_id`` and ``right_id`` are expressions that identify a row of each side.
    ``*_bytes`` bound what the side is read from, ``*_unique`` says that no two
    rows of the side agree on the equal columns.
    """
    on = all_of([F.expr(a) == F.expr(b) for a, b in pairs] + [F.expr(t) for t in rest])
    left_bytes = plan_bytes(left) if left_bytes is None else left_bytes
    right_bytes = plan_bytes(right) if right_bytes is None else right_bytes
    if not pairs:
        # Without an equality Spark broadcasts one side, whatever its size.
        inner_side = min(left_bytes, right_bytes)
        sent = {"left": right_bytes, "right": left_bytes}.get(how, inner_side)
        limit = left.sparkSession.conf.get(RANGE_BYTES, None)
        if sent <= (broadcast_limit(left) if limit is None else int(limit)):
            return left.join(right, on, how)
        band = find_band(left, right, rest)
        if band is not None:
            joined = range_join(left, right, band, on, how, copy_left=left_bytes < right_bytes)
            alone = {"left": lambda: joined.alone(left, "left", left_id), "right": lambda: joined.alone(right, "right", right_id)}
            return _with_alone(left, right, how, joined.matched(), alone)
        return _spread(left, right, pairs, rest, how, left_id, right_id, None, None)
    least, share = setting(left, SKEW_BYTES), setting(left, HOT_SHARE)
    look_right = how in ("left", "full") and not right_unique and right_bytes >= least
    look_left = how in ("right", "full") and not left_unique and left_bytes >= least
    if not (look_left or look_right):
        return left.join(right, on, how)
    hashed = _hashable(left, right, pairs)
    if hashed is None:
        return left.join(right, on, how)
    task = setting(left, TASK_BYTES)
    hot_left, most_left = heavy_keys(left, hashed[0], share, task) if look_left else ([], 0.0)
    hot_right, most_right = heavy_keys(right, hashed[1], share, task) if look_right else ([], 0.0)
    if not hot_left and not hot_right:
        return left.join(right, on, how)
    salts = min(_MOST_SALTS, max(int(setting(left, SALTS)), ceil(max(most_left, most_right) / task)))
    return _spread(left, right, pairs, rest, how, left_id, right_id, hot_left, hot_right, salts)


def _hashable(left: DataFrame, right: DataFrame, pairs) -> tuple[list[Column], list[Column]] | None:
    """Both sides' keys in a form in which equal keys have equal hashes.

    Integers of different width are widened. For other types that are compared after
    a conversion, or in which different bits are equal (floating point, strings
    with a collation), there is none: such joins are left to Spark as they are.
    """
    left_types = left.select(*[F.expr(a).alias(f"k{i}") for i, (a, _) in enumerate(pairs)]).schema
    right_types = right.select(*[F.expr(b).alias(f"k{i}") for i, (_, b) in enumerate(pairs)]).schema
    out: tuple[list[Column], list[Column]] = ([], [])
    for (a, b), l_field, r_field in zip(pairs, left_types, right_types):
        l_type, r_type = l_field.dataType, r_field.dataType
        if isinstance(l_type, T.IntegralType) and isinstance(r_type, T.IntegralType):
            keys = F.expr(a).cast("bigint"), F.expr(b).cast("bigint")
        elif l_type == r_type and (l_type == T.StringType() or isinstance(l_type, _EXACT)):
            keys = F.expr(a), F.expr(b)
        else:
            return None
        out[0].append(keys[0])
        out[1].append(keys[1])
    return out


_EXACT = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.DecimalType, T.BinaryType)


def _spread(left, right, pairs, rest, how, left_id, right_id, hot_left, hot_right, salts=None) -> DataFrame:
    """The join as a salted inner join plus the rows without a partner.

    A row with a key that is hot on its own side gets one salt; its possible
    partners are copied once per salt. Each pair of rows meets exactly once.
    ``None`` instead of a list of hot keys means that every row is spread.
    """
    salts = salts or int(setting(left, SALTS))
    left_keys, right_keys = [F.expr(a) for a, _ in pairs], [F.expr(b) for _, b in pairs]
    left_hashed, right_hashed = _hashable(left, right, pairs) if pairs else ([], [])

    def hot(keys, hashes):
        if hashes is None:
            return F.lit(True)
        return F.xxhash64(*keys).isin(hashes) if hashes else F.lit(False)

    def own(ids, is_hot):
        salt = F.pmod(F.xxhash64(*[F.expr(i) for i in ids]), F.lit(salts)).cast("int")
        return F.when(is_hot, salt).otherwise(F.lit(0))

    def copies(is_hot):
        every = F.array(*[F.lit(i) for i in range(salts)])
        return F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0))))

    salted_left = left.withColumn("__la", own(left_id, hot(left_hashed, hot_left))).withColumn(
        "__lb", copies(hot(left_hashed, hot_right))
    )
    salted_right = right.withColumn("__rb", own(right_id, hot(right_hashed, hot_right))).withColumn(
        "__ra", copies(hot(right_hashed, hot_left))
    )
    on = all_of(
        [a == b for a, b in zip(left_keys, right_keys)]
        + [F.col("__la") == F.col("__ra"), F.col("__lb") == F.col("__rb")]
        + [F.expr(t) for t in rest]
    )
    matched = salted_left.join(salted_right, on, "inner").drop("__la", "__lb", "__ra", "__rb")
    return _with_lonely(left, right, left_keys, right_keys, rest, how, left_id, right_id, matched)


def _with_lonely(left, right, left_keys, right_keys, rest, how, left_id, right_id, matched) -> DataFrame:
    """The matched pairs and the rows that ``how`` preserves without a partner."""
    alone = {
        "left": lambda: _without_partner(left, right, left_keys, right_keys, rest, left_id, matched),
        "right": lambda: _without_partner(right, left, right_keys, left_keys, rest, right_id, matched),
    }
    return _with_alone(left, right, how, matched, alone)


def _with_alone(left, right, how, matched, alone) -> DataFrame:
    """The matched pairs and, as the kind of join asks for, the rows of either side without a partner."""
    out = matched
    if how in ("left", "full"):
        out = out.union(alone["left"]().select("*", *[typed_null(f.dataType) for f in right.schema.fields]))
    if how in ("right", "full"):
        out = out.union(alone["right"]().select(*[typed_null(f.dataType) for f in left.schema.fields], "*"))
    return out


def _without_partner(rows, other, keys, other_keys, rest, row_id, matched) -> DataFrame:
    """Rows that match nothing. The other side is reduced to distinct keys first,
    so what remains to be split is the preserved side, which Spark can do. Rows
    with a NULL key cannot match and are not sent through the join at all."""
    if not rest:
        null_key = any_of(k.isNull() for k in keys)
        found = other.select(*[k.alias(f"__f{i}") for i, k in enumerate(other_keys)]).distinct()
        on = all_of(k == F.col(f"__f{i}") for i, k in enumerate(keys))
        return rows.where(~null_key).join(found, on, "left_anti").union(rows.where(null_key))
    ids = [F.expr(i) for i in row_id]
    found = matched.select(*[i.alias(f"__f{n}") for n, i in enumerate(ids)]).distinct()
    on = null_safe_on(ids, [F.col(f"__f{n}") for n in range(len(ids))])
    return rows.join(found, on, "left_anti")


def distinct_if_large(keys: DataFrame) -> DataFrame:
    """Keys to semi-join with, reduced to distinct ones if Spark will shuffle them.

    Otherwise a key that many of them share would meet in one task. When they are
    small enough to be broadcast, copies do no harm and the extra shuffle would.
    """
    return keys if plan_bytes(keys) <= broadcast_limit(keys) else keys.distinct()


def restrict_to_keys(base: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` whose key occurs in ``keys_df``.

    Spark broadcasts the wanted keys when their size is below its threshold, so the
    base table is then filtered where it is read.
    """
    wanted = distinct_if_large(keys_df.selectExpr(*renamed(keys, "__w")))
    return base.join(wanted, F.expr(keys_match(keys, "__w")), "left_semi")


def matching_rows(rows: DataFrame, other: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that equal a row of ``other``, NULLs being equal (semi join)."""
    return _null_safe(rows, other, columns, "left_semi")


def rows_without_match(
    rows: DataFrame, other: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows that equal no row of ``other``, NULLs being equal (anti join)."""
    return _null_safe(rows, other, columns, "left_anti")


def _null_safe(rows, other, columns, how) -> DataFrame:
    columns = rows.columns if columns is None else list(columns)
    wanted = distinct_if_large(other.selectExpr(*renamed(columns, "__w")))
    return rows.join(wanted, F.expr(keys_match(columns, "__w", "<=>")), how)
