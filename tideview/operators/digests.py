"""Find out where two row sets can differ, from digests of buckets.

Each side is summed up once: per bucket of a hash the number of its rows and sums of two
64-bit hashes of them. The sums don't depend on order and are combined before the shuffle,
so a task sends a few numbers a bucket and no row. Rows of buckets with equal digests
need not meet at all. Two different buckets have equal digests by an accident of 128 bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import cols, quoted

BUCKETS = 4096
_SUMS = ["__n", "__a", "__b", "__c", "__d"]


def can_digest(df: DataFrame) -> bool:
    """Whether all columns have a hash in which equal values and no others agree.

    Hashes of nested values pass over the NULLs in them, so rows with such columns are compared
    whole. Spark gives both zeros of a fraction one hash, as it does all NaN.
    """
    exact = (T.IntegralType, T.FloatType, T.DoubleType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.BinaryType, T.BooleanType)
    return all(isinstance(f.dataType, exact) for f in df.schema.fields)


def bucket_of(names: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*cols(names)), F.lit(BUCKETS)).cast("int")


def digest(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``__bucket`` by the hash of the columns ``by``, rows, and sums over the hashes of the rows."""
    names = sorted(df.columns)
    # A hash passes over NULLs, so it is told where they are.
    nulls = [F.col(quoted(n)).isNull() for n in names]
    hashed = df.select(
        bucket_of(by).alias("__bucket"), F.xxhash64(*cols(names), *nulls).alias("__h"), F.xxhash64(F.lit("2"), *nulls, *cols(names)).alias("__g")
    )
    # Halves of 32 bits, whose sums don't overflow below two billion rows a bucket.
    low, high = (lambda c: F.expr(f"{c} & 4294967295L")), (lambda c: F.expr(f"shiftrightunsigned({c}, 32)"))
    halves = [low("__h"), high("__h"), low("__g"), high("__g")]
    sums = [F.count(F.lit(1)), *[F.sum(h) for h in halves]]
    return hashed.groupBy("__bucket").agg(*[s.alias(n) for s, n in zip(sums, _SUMS)])


def buckets_that_differ(one: DataFrame, other: DataFrame, by: Sequence[str]) -> list[int]:
    """The buckets whose rows differ: at most ``BUCKETS`` numbers, for the driver."""
    signed = digest(one, by).unionByName(
        digest(other, by).select("__bucket", *[(-F.col(n)).alias(n) for n in _SUMS])
    )
    total = signed.groupBy("__bucket").agg(*[F.sum(n).alias(n) for n in _SUMS])
    differs = F.greatest(*[F.abs(F.col(n)) for n in _SUMS]) > 0
    return sorted(r[0] for r in total.where(differs).select("__bucket").take(BUCKETS))


def where_they_differ(one: DataFrame, other: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without the rows of equal buckets; runs the digests now.

    Both sides are given back whole where a column has no exact hash.
    """
    if not (can_digest(one) and one.dtypes == other.select(*cols(one.columns)).dtypes):
        return one, other
    hit = buckets_that_differ(one, other, by)
    if len(hit) == BUCKETS:
        return one, other
    if not hit:
        return one.limit(0), other.limit(0)
    # As text: thousands of numbers one by one would take the driver seconds.
    there = f"__bucket in ({', '.join(map(str, hit))})"
    return tuple(df.withColumn("__bucket", bucket_of(by)).where(there).drop("__bucket") for df in (one, other))
