"""Joins on inequalities, ``l.x < r.hi and l.x > r.lo`` or ``l.x < r.y``, of sides too large to broadcast.

Each row is a range of values on one axis (a point, if both conditions read the same expression), and only rows whose
ranges touch can match. Quantiles of both sides cut the axis into parts with about equally many rows, and within a part values lie
linearly; so the axis can be cut into cells, coarse or fine. A row takes the finest of a few grids in which its range covers few cells,
and stands once in each of them. Two rows meet in the coarser of their grids, in the first cell they share, so each pair
that can match meets once; the conditions themselves then decide. Cells are join keys like any other, so Spark shuffles by them and
splits those that are large.

Where the rows of one side are points, the rows of the other stand once, in the first cell of their range, and the points are copied to
the cells before theirs in which such a range can begin. The rows without a partner are found among the cells too, row by row and not from the pairs.

Spark takes rows that are copied into cells for no larger than their files. So how large both sides are in their cells is counted here,
and a side too large to broadcast is not.

With one condition only, half of all pairs match anyway: there the smaller side is copied into all of up to 64 cells on its
side of the axis, and the other half of the pairs never meets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import null_safe_on
from tideview.sources.storage import broadcast_limit, plan_bytes, row_width

#: Cuts of the axis, half of them quantiles of each side.
CUTS = 1024
#: Grids from fine to coarse: a part between two cuts has two to this power cells.
GRIDS = (20, 14, 8, 2, -4, -10)
#: The grid if there is one condition only.
_HALF_GRID = -4
#: A row is in the finest grid in which it covers at most so many cells.
_COVERED = 16
#: The grids if one side are points, and how many cells a range of the other side covers there at most.
_ONCE_GRIDS = tuple(range(20, -11, -2))
_SPAN = 2


@dataclass(frozen=True)
class Band:
    """``left_top <= right_top`` and ``right_bottom <= left_bottom``; the pair of a condition that is missing is None."""

    left_top: str | None
    right_top: str | None
    left_bottom: str | None
    right_bottom: str | None

    def ends(self, side: str) -> list[str]:
        """The expressions of a side, one of them if they are the same."""
        texts = (self.left_top, self.left_bottom) if side == "left" else (self.right_top, self.right_bottom)
        return list(dict.fromkeys(t for t in texts if t is not None))

    @property
    def whole(self) -> bool:
        return self.left_top is not None and self.left_bottom is not None


def find_band(left: DataFrame, right: DataFrame, rest: Sequence[str]) -> Band | None:
    """The two conditions of ``rest`` (or the one) that bound a left value by right values, as Spark resolves them."""
    tops, bottoms = [], []
    for text in rest:
        for below, above in _comparisons(left, right, text):
            a, b = below[1], above[1]
            if (below[0], above[0]) == ("left", "right") and _axis(left, a) is not None and _axis(right, b) is not None:
                tops.append((a, b))
            elif (below[0], above[0]) == ("right", "left") and _axis(right, a) is not None and _axis(left, b) is not None:
                bottoms.append((b, a))
    if not tops and not bottoms:
        return None
    # Best if one side is a point.
    pairs = [(t, b) for t in tops or [(None, None)] for b in bottoms or [(None, None)]]
    (lt, rt), (lb, rb) = max(pairs, key=lambda p: (p[0][0] == p[1][0]) + (p[0][1] == p[1][1]))
    return Band(lt, rt, lb, rb)


def _comparisons(left: DataFrame, right: DataFrame, text: str) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """The inequalities that must hold for ``text`` to hold: (side, expression) of the smaller and of the larger value.

    The side of what reads columns of both or of none is "".
    """
    plan = left.join(right, F.lit(True)).select(F.expr(text).alias("c"))._jdf.queryExecution().analyzed()
    outputs = {"left": plan.child().left().outputSet(), "right": plan.child().right().outputSet()}

    def sided(e) -> tuple[str, str]:
        read = e.references()
        side = "" if read.isEmpty() else next((s for s, out in outputs.items() if read.subsetOf(out)), "")
        return side, e.sql()

    def parts(e) -> list:
        name = e.getClass().getSimpleName()
        if name == "Between":
            value, low, high = (sided(e.parameters().apply(i)) for i in range(3))
            return [(low, value), (value, high)]
        if name == "And":
            return parts(e.left()) + parts(e.right())
        if name in ("LessThan", "LessThanOrEqual"):
            return [(sided(e.left()), sided(e.right()))]
        if name in ("GreaterThan", "GreaterThanOrEqual"):
            return [(sided(e.right()), sided(e.left()))]
        return []

    return parts(plan.expressions().apply(0).child())


def _axis(df: DataFrame, text: str) -> Column | None:
    """The expression as a double that grows with it, or None if its type has none."""
    kind = df.select(F.expr(text).alias("x")).schema["x"].dataType
    if isinstance(kind, T.NumericType):
        return F.expr(text).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.expr(text)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.expr(text)).cast("double")
    return None


def _cuts(left: DataFrame, right: DataFrame, band: Band) -> tuple[list[float], dict[str, int]]:
    """Quantiles of both sides' values, least and largest included, at most ``CUTS`` numbers; and about how many rows each side places."""
    n = CUTS // 2
    shares = _constant([i / (n - 1) for i in range(n)])
    finite = F.when(F.expr("x > double('-infinity') and x < double('infinity')"), F.col("x"))
    parts = []
    for df, side in ((left, "left"), (right, "right")):
        values = F.explode(F.array(*[_axis(df, t) for t in band.ends(side)])).alias("x")
        found = F.percentile_approx(finite, shares, 10_000).alias("q"), F.count("x").alias("n")
        parts.append(df.select(values).agg(F.lit(side).alias("side"), *found))
    rows = parts[0].unionByName(parts[1]).take(2)
    return sorted({x for row in rows for x in row["q"] or []}), {r["side"]: -(-r["n"] // len(band.ends(r["side"]))) for r in rows}


def _bytes(df: DataFrame, rows: int) -> int:
    """How large so many rows of these columns are."""
    return max(plan_bytes(df), rows * row_width(df))


def _constant(values: list[float]) -> Column:
    """One text, which Spark folds into one constant: many literals would make planning slow."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _place(x: Column, cuts: list[float]) -> Column:
    """Where a value lies on the axis: the number of cuts up to it, and how far it is to the next. Never falls as x grows."""
    if not cuts:
        return F.lit(0.0)
    every, steps = _constant(cuts), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    found = F.array(*[F.lit(n) for n in steps])
    upto = F.aggregate(found, F.lit(0), lambda n, more: n + F.when(F.get(every, n + more - 1) <= x, more).otherwise(0))

    def place(n):
        low, high = F.get(every, n - 1), F.get(every, n)
        part = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1 - 2.0**-30))
        return F.when(n == 0, F.lit(0.0)).when(n == len(cuts), F.lit(float(len(cuts)))).otherwise(n + part)

    return F.transform(F.array(upto), place).getItem(0)  # so that the search is done once


def _placed(df: DataFrame, texts: list[str], cuts: list[float], low: bool, high: bool) -> DataFrame:
    """With the range ``__lo`` to ``__hi`` of each row; open where there is no bound. Rows with a NULL can't match and are left out."""
    given = df.where(F.expr(" and ".join(f"({t}) is not null" for t in texts)))
    places = [_place(_axis(df, t), cuts) for t in texts]
    given = given.withColumns({f"__p{i}": p for i, p in enumerate(places)})
    names = [F.col(f"__p{i}") for i in range(len(texts))]
    least, most = (F.least(*names), F.greatest(*names)) if len(names) > 1 else (names[0], names[0])
    out = given.withColumns({"__lo": least if low else F.lit(0.0), "__hi": most if high else F.lit(float(len(cuts) + 1))})
    return out.drop(*[f"__p{i}" for i in range(len(texts))])


def _cell(place: Column, grid: int) -> Column:
    return F.floor(place * 2.0**grid)


def _with_grid(df: DataFrame, grids: Sequence[int] = GRIDS, covered: int = _COVERED) -> DataFrame:
    """``__grid``: the number in ``grids`` of the finest grid in which the row covers few cells."""
    out = F.lit(len(grids) - 1)
    for i in range(len(grids) - 2, -1, -1):
        out = F.when(_cell(F.col("__hi"), grids[i]) - _cell(F.col("__lo"), grids[i]) < covered, i).otherwise(out)
    return df.withColumn("__grid", out)


def _stands(grid: int, low: Column, high: Column) -> Column:
    return F.transform(F.sequence(low, high), lambda c: F.struct(F.lit(grid).alias("grid"), c.alias("cell"), low.alias("low")))


def _in_cells(df: DataFrame, others: list[int], side: str) -> DataFrame:
    """Each row once for each grid in which it can meet rows of the other side's grids, and each cell there."""
    own, every = F.col("__grid"), []
    for i in range(len(GRIDS)):
        meets = F.lit(False)
        if any(o <= i for o in others):
            meets |= own == i  # the other's is finer
        if i in others:
            meets |= own < i
        low, high = _cell(F.col("__lo"), GRIDS[i]), _cell(F.col("__hi"), GRIDS[i])
        every.append(F.when(meets, _stands(i, low, high)).otherwise(F.array().cast("array<struct<grid:int,cell:bigint,low:bigint>>")))
    out = df.withColumn("__at", F.explode(F.flatten(F.array(*every))))
    places = {f"__{side}{n}": F.col("__at").getField(n) for n in ("grid", "cell", "low")}
    return out.withColumns({**places, f"__{side}own": own}).drop("__at", "__lo", "__hi", "__grid")


def cells(left: DataFrame, right: DataFrame, band: Band, copy_left: bool = False) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with the cells they stand in, and when two of these rows meet.

    ``copy_left`` says which side is copied if the band has one condition only.
    """
    return _cells(left, right, band, copy_left)[:3]


def _cells(left: DataFrame, right: DataFrame, band: Band, copy_left: bool) -> tuple[DataFrame, DataFrame, Column, tuple[int, int]]:
    """``cells`` and about how many rows each side has in them."""
    cuts, given = _cuts(left, right, band)
    if not band.whole:
        down = band.left_top is not None  # left below right
        placed_left = _placed(left, band.ends("left"), cuts, True, not (copy_left and down))
        placed_right = _placed(right, band.ends("right"), cuts, copy_left or not down, True)
        if copy_left and not down:
            placed_left = placed_left.withColumn("__lo", F.lit(0.0))
        if not copy_left and not down:
            placed_right = placed_right.withColumn("__hi", F.lit(float(len(cuts) + 1)))
        grid = GRIDS.index(_HALF_GRID)
        placed_left, placed_right = (x.withColumn("__grid", F.lit(grid)) for x in (placed_left, placed_right))
        used_left = used_right = [grid]
        copies = 1 + int(len(cuts) * 2.0**_HALF_GRID / 2)  # about half of the cells
        many = (given["left"] * (copies if copy_left else 1), given["right"] * (1 if copy_left else copies))
    else:
        placed_left = _with_grid(_placed(left, band.ends("left"), cuts, True, True))
        placed_right = _with_grid(_placed(right, band.ends("right"), cuts, True, True))
        covered = F.lit(0)
        for i, grid in enumerate(GRIDS):
            covered = F.when(F.col("__grid") == i, _cell(F.col("__hi"), grid) - _cell(F.col("__lo"), grid) + 1).otherwise(covered)
        both = [x.select(F.lit(n).alias("side"), "__grid", covered.alias("n")) for n, x in enumerate((placed_left, placed_right))]
        counted = both[0].unionByName(both[1]).groupBy("side", "__grid").agg(F.sum("n").alias("n"))
        used = counted.take(2 * len(GRIDS))  # a side has at most so many grids as there are
        used_left, used_right = ([g for side, g, _ in used if side == n] for n in (0, 1))
        many = [0, 0]
        for side, own, n in used:  # coarser grids have no more cells for a row
            others = (used_right, used_left)[side]
            many[side] += n * (any(o <= own for o in others) + sum(o > own for o in others))
    meet = (F.col("__lgrid") == F.col("__rgrid")) & (F.col("__lcell") == F.col("__rcell"))
    # Once: in the coarser of the two rows' own grids, in the first cell they share.
    meet &= (F.col("__lgrid") == F.greatest("__lown", "__rown")) & (F.col("__lcell") == F.greatest("__llow", "__rlow"))
    return _in_cells(placed_left, used_right, "l"), _in_cells(placed_right, used_left, "r"), meet, (many[0], many[1])


def _once(rows: DataFrame, points: DataFrame, band: Band, side: str) -> tuple[DataFrame, DataFrame, Column, tuple[int, int]]:
    """Cells in which each of ``rows`` (on ``side``) stands once and the points of the other side are copied; and about how many rows each side has there."""
    left, right = (rows, points) if side == "left" else (points, rows)
    cuts, given = _cuts(left, right, band)
    other = "right" if side == "left" else "left"
    r, p = side[0], other[0]
    placed = _with_grid(_placed(rows, band.ends(side), cuts, True, True), _ONCE_GRIDS, _SPAN)
    used = sorted(g[0] for g in placed.select("__grid").distinct().take(len(_ONCE_GRIDS)))
    first = F.lit(None).cast("bigint")
    for i in used:
        first = F.when(F.col("__grid") == i, _cell(F.col("__lo"), _ONCE_GRIDS[i])).otherwise(first)
    # Out of an array, as filters are not moved below that: they would compute the place over and over.
    standing = placed.withColumn("__at", F.explode(F.array(F.struct(F.col("__grid").alias("grid"), first.alias("cell")))))
    standing = standing.withColumns({f"__{r}{n}": F.col("__at").getField(n) for n in ("grid", "cell")}).drop("__at", "__lo", "__hi", "__grid")
    # All have a cell. An inner join asks for it anyway; if said here, Spark sees that the join for the rows without partner reads the same rows, and shuffles them once.
    standing = standing.where(F.col(f"__{r}cell").isNotNull())
    at = [
        F.struct(F.lit(i).alias("grid"), (_cell(F.col("__lo"), _ONCE_GRIDS[i]) - n).alias("cell"))
        for i in used
        for n in range(_SPAN)
    ]
    none = F.array().cast("array<struct<grid:int,cell:bigint>>")
    copied = _placed(points, band.ends(other), cuts, True, True).withColumn("__at", F.explode(F.array(*at) if at else none))
    copied = copied.withColumns({f"__{p}{n}": F.col("__at").getField(n) for n in ("grid", "cell")}).drop("__at", "__lo", "__hi")
    meet = (F.col("__lgrid") == F.col("__rgrid")) & (F.col("__lcell") == F.col("__rcell"))
    once, copies = given[side], given[other] * len(at)
    return (standing, copied, meet, (once, copies)) if side == "left" else (copied, standing, meet, (copies, once))


@dataclass(frozen=True)
class RangeJoin:
    """Both sides in their cells, and when two of these rows are a pair of the join. ``once`` is the side
    whose rows stand in one cell each, if there is one, ``fits`` says of each side whether it may be broadcast."""

    left: DataFrame
    right: DataFrame
    pair: Column
    band: Band
    once: str | None
    fits: tuple[bool, bool]

    def matched(self) -> DataFrame:
        """The inner join."""
        left, right = self.left, self.right
        if self.fits == (True, False):
            left = left.hint("broadcast")
        elif self.fits == (False, True):
            right = right.hint("broadcast")
        elif self.fits == (False, False):
            right = right.hint("merge")
        return left.join(right, self.pair, "inner").drop(*_PLACES)

    def alone(self, rows: DataFrame, side: str, row_id: Sequence[str]) -> DataFrame:
        """``rows``, which are the whole ``side``, without those that have a partner. No pair is shuffled for that."""
        mine, other = (self.left, self.right) if side == "left" else (self.right, self.left)
        if not self.fits[side == "left"]:
            other = other.hint("merge")
        if side == self.once:
            null = " or ".join(f"({t}) is null" for t in self.band.ends(side))  # these stand in no cell
            return mine.join(other, self.pair, "left_anti").drop(*_PLACES).union(rows.where(null))
        found = mine.join(other, self.pair, "left_semi")
        found = found.select(*[F.expr(t).alias(f"__f{n}") for n, t in enumerate(row_id)]).distinct()
        return rows.join(found, null_safe_on([F.expr(t) for t in row_id], [F.col(f"__f{n}") for n in range(len(row_id))]), "left_anti")


_PLACES = [f"__{s}{n}" for s in "lr" for n in ("grid", "cell", "low", "own")]


def range_join(left: DataFrame, right: DataFrame, band: Band, on: Column, how: str, copy_left: bool = False) -> RangeJoin:
    """The join of both sides on a condition that holds only within the band. Of two sides
    of points the one that ``how`` preserves stands once, or else the one not to be copied."""
    point = {side: band.whole and len(band.ends(side)) == 1 for side in ("left", "right")}
    first = "left" if how in ("left", "full") or how == "inner" and not copy_left else "right"
    for once, points in sorted([("left", "right"), ("right", "left")], key=lambda p: p[0] != first):
        if point[points]:
            rows, others = (left, right) if once == "left" else (right, left)
            in_left, in_right, meet, many = _once(rows, others, band, once)
            return RangeJoin(in_left, in_right, meet & on, band, once, _fits(in_left, in_right, many))
    in_left, in_right, meet, many = _cells(left, right, band, copy_left)
    return RangeJoin(in_left, in_right, meet & on, band, None, _fits(in_left, in_right, many))


def _fits(left: DataFrame, right: DataFrame, many: tuple[int, int]) -> tuple[bool, bool]:
    """Whether Spark would broadcast a side if it knew how many rows there are."""
    limit = broadcast_limit(left)
    return _bytes(left, many[0]) <= limit, _bytes(right, many[1]) <= limit
