"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, by an auction for shortest paths.

The rows of a conversation and the states of that pattern span a lattice: node (i, s) means that i rows are done and
the repaired roles so far end in state s. Its arcs are the edits, with integer costs: Keep 0, Rerole
3, Delete 4, Insert 3; rows that are cut off and not deleted add 3, blank and repeated rows can only be deleted. ``auction`` finds
node prices: a path is extended along arcs whose cost equals the difference of their prices, and contracted, with the
price of its last node raised, where there is none. Every arc of every cheapest path is then tight; ``trace`` follows
tight arcs that lead to the end, the ASCII-least edit first.

A conversation of any length is cut into blocks of consecutive rows. Prices at the borders of blocks come from products of the
blocks' cost matrices (min, +), taken in a tree (``_scan``), so no task holds the rows of a conversation. Only the digest of
the repaired text has to see a conversation's rows one after the other; it is fed row by row from a sorted partition, and holds none.

Defined results: rows of a conversation go by turn (nulls first), then role, then SHA-256 of the text, so the result does
not depend on the order of ties; equal rows repeat each other. Null conv_id is a conversation of its own, together with one named by
one space; null turn, role and text count as one space where they are read as text. A role that is not u..., a... or s... is never kept.
A conversation that lost all rows has zeros, an empty audit and the hash of the empty string. Very long texts are
never split or cut. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import PIECE, Scratch, parallelism

#: Costs of edits, and of leaving a cut-off row in.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What it takes from each state to the end of the pattern, after the last row.
AT_END = (0, 2 * INSERT, INSERT, 0)
_NEVER = 1 << 40
#: A row is one sign: its role's initial (u, a, s, other) times its fault (none, blank, duplicate, truncated).
INITIALS, FAULTS = "uasx", ("", "blank", "duplicate", "truncated")
_FIRST_SIGN = 65
#: Rows of a block, and blocks that are put together at a time: two to this power.
_BITS = 12
#: Layers between the origins from which prices are found, last ones first.
_STRIDE = 8
_SPACES = " \t\n\x0b\x0c\r"


def _arcs_of(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    """For each state the arcs (cost, step in node numbers, edit) that leave its node, by edit."""
    out = []
    for s in range(4):
        arcs = [(DELETE, 4, "D"), (INSERT, _NEXT[s] - s, "I")]
        if fault not in ("blank", "duplicate"):
            more = CUT_OFF if fault == "truncated" else 0
            to = {"u": USER, "a": ASSISTANT, "s": SYSTEM}.get(initial)
            if to == _NEXT[s] or (s == START and to == SYSTEM):
                arcs.append((KEEP + more, 4 + to - s, "K"))
            arcs.append((REROLE + more, 4 + _NEXT[s] - s, "R"))
        out.append(arcs)
    return out


ARCS = {chr(_FIRST_SIGN + 4 * i + f): _arcs_of(a, b) for i, a in enumerate(INITIALS) for f, b in enumerate(FAULTS)}


def auction(rows: str, exit_prices, entries=(START,)) -> list[int]:
    """Prices of the nodes 4 * i + s of the lattice of ``rows``, where those after the last row are given.

    They are a feasible dual (no price is above an arc's cost and the price behind it), and those
    of ``entries`` (states before the first row) are the least costs. The origins are taken from the
    end; a path is done when it meets a node whose price is known to be the least cost.
    """
    n = len(rows)
    price, known = [0] * (4 * n) + list(exit_prices), bytearray(4 * n) + b"\1" * 4
    arcs = [ARCS[r] for r in rows]
    starts = [4 * i + s for i in range((n - 1) // _STRIDE * _STRIDE, 0, -_STRIDE) for s in range(4)]
    for origin in [*starts, *(e for e in entries if n)]:
        path = [origin]
        while not known[node := path[-1]]:
            best, to = min((cost + price[node + step], node + step) for cost, step, _ in arcs[node >> 2][node & 3])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()  # contraction
            else:
                path.append(to)  # extension
        for node in path:
            known[node] = 1
    return price


def trace(rows: str, price: list[int], entries=(START,)) -> list[tuple[str, int]]:
    """For each entry the ASCII-least edits along tight arcs to the end of ``rows``, and the state they end in."""
    n = len(rows)
    arcs = [ARCS[r] for r in rows]
    ends = bytearray(4 * n) + b"\1" * 4  # nodes from which tight arcs lead to the end
    for i in range(n - 1, -1, -1):
        for _ in range(3):  # insertions stay in the layer: at most two in a row can be tight
            for node in range(4 * i, 4 * i + 4):
                if not ends[node]:
                    ends[node] = any(ends[node + step] and price[node] == cost + price[node + step] for cost, step, _ in arcs[i][node & 3])
    out = []
    for entry in entries:
        node, edits = entry, []
        while node < 4 * n:
            for cost, step, edit in arcs[node >> 2][node & 3]:
                if ends[node + step] and price[node] == cost + price[node + step]:
                    edits.append(edit)
                    node += step
                    break
            else:
                raise ValueError("no tight path")
        out.append(("".join(edits), node & 3))
    return out


@lru_cache(maxsize=1 << 14)
def solve(rows: str, entry: int, exit_prices: tuple[int, ...], last: bool) -> tuple[str, int]:
    """(edits, cost) of a block, with the insertions behind the last row if it is the last."""
    price = auction(rows, exit_prices, (entry,))
    ((edits, state),) = trace(rows, price, (entry,))
    if last:
        return edits + "I" * (exit_prices[state] // INSERT), price[entry]
    return edits, price[entry] - exit_prices[state]


def repair(rows: str) -> tuple[str, int]:
    """(edits, cost) of a whole conversation of signs."""
    return solve(rows, START, AT_END, True)


def cost_matrix(rows: str) -> list[int]:
    """Least costs from each entry to each exit state, row by row.

    The exits before the first user turn leave no choice: all rows go, or all but one system turn. (An
    auction towards an exit that an entry cannot reach would raise prices for ever.)
    """
    n = len(rows)
    columns = [[_NEVER] * 4, [_NEVER] * 4]
    columns[START][START] = columns[SYSTEM][SYSTEM] = DELETE * n
    kept = [cost for r in rows for cost, step, edit in ARCS[r][START] if edit == "K" and step == 4 + SYSTEM]
    if kept:
        columns[SYSTEM][START] = DELETE * (n - 1) + min(kept)
    columns += [auction(rows, [0 if s == t else _NEVER for s in range(4)], range(4))[:4] for t in (USER, ASSISTANT)]
    return [min(columns[t][s], _NEVER) for s in range(4) for t in range(4)]


def exit_matrix(rows: str, exit_prices) -> list[int]:
    """Where the trace from each entry leaves the block: 0 there, no way elsewhere."""
    price = auction(rows, exit_prices, range(4))
    out = [_NEVER] * 16
    for s in range(4):
        if price[s] < _NEVER:
            out[4 * s + trace(rows, price, (s,))[0][1]] = 0
    return out


_ONE = [0 if i % 5 == 0 else _NEVER for i in range(16)]


def product(a, b) -> list[int]:
    """The (min, +) product of two 4 x 4 matrices."""
    return [min(_NEVER, *(a[4 * i + k] + b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, live: the rows after damage; those that are dropped stay as not live.

    crc32 of ``conv_id:turn`` modulo 20 says what happens: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out,
    3 repeats it, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    said = F.when(case == 1, "").when(case == 2, F.translate(text("text"), ".!?", "")).when(case != 0, text("text"))
    rows = conversations.select(
        text("conv_id").alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(case == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), (case != 0).alias("live"),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy").withColumn("hash", F.sha2("text", 256))


_ORDER = ("conv", "turn", "role", "hash")


def _blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, block, rows (signs), and the place (turn, role, hash) of the first row, for each block of consecutive rows."""
    n = parallelism(rows.sparkSession)
    said = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)).cast("int")
    marks = rows.where("live").select(
        *_ORDER, F.monotonically_increasing_id().alias("row"), F.when((F.col("role") != "") & (initial > 0), initial - 1).otherwise(3).alias("initial"),
        (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    # The row number only parts equal rows, so that a range of them can be split.
    dealt = marks.repartitionByRange(n, *_ORDER, "row").sortWithinPartitions(*_ORDER, "row")
    marks = scratch.saved(dealt.withColumn("place", F.monotonically_increasing_id()).drop("row"), "marks")
    # Places hold the partition above bit 33; brought close together, few levels of blocks are enough.
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    bits = int(marks.agg(F.max(inside)).first()[0] or 0).bit_length()
    marks = marks.withColumn("place", F.shiftrightunsigned("place", 33) * (1 << bits) + inside)
    first = marks.groupBy("conv", "role", "hash").agg(F.min("place").alias("place"))
    marks = marks.join(first.select("conv", "place", F.lit(True).alias("first")), ["conv", "place"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    each = F.struct("place", "turn", "role", "hash", (F.col("initial") * 4 + fault).alias("sign"))
    block = F.shiftrightunsigned("place", _BITS).alias("block")
    blocks = marks.select("conv", block, each.alias("r")).groupBy("conv", "block").agg(F.array_sort(F.collect_list("r")).alias("r"))
    signs = F.array_join(F.transform("r", lambda x: F.char(x.sign + _FIRST_SIGN)), "")
    return scratch.saved(blocks.select("conv", "block", signs.alias("rows"), *[F.col("r")[0][c].alias(c) for c in _ORDER[1:]]), "blocks")


def _by_row(df: DataFrame, function, schema: str) -> DataFrame:
    """Some output rows (tuples) for each row (a dict)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                out = [o for r in batch.slice(start, PIECE).to_pylist() for o in function(r)]
                columns = list(zip(*out)) if out else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return df.mapInArrow(run, schema)


def _scan(blocks: DataFrame, scratch: Scratch, backward: bool) -> DataFrame:
    """conv, block, other: the product of the matrices ``m`` of all blocks of the conversation behind it, or before it.

    4,096 consecutive blocks are put together at a time, until each conversation is one; then
    products go down again.
    """
    levels, places = [blocks.select("conv", "block", "m")], (F.shiftrightunsigned("block", _BITS)).alias("up")
    while not levels[-1].groupBy("conv").count().where("count > 1").isEmpty():
        groups = levels[-1].select("conv", places, F.struct("block", "m").alias("x")).groupBy("conv", "up").agg(F.array_sort(F.collect_list("x")).alias("x"))

        def whole(r):
            m = _ONE
            for x in r["x"]:
                m = product(m, x["m"])
            yield r["conv"], r["up"], m

        levels.append(scratch.saved(_by_row(groups, whole, "conv string, block long, m array<long>"), "up"))
    out = levels.pop().select("conv", "block", F.array(*map(F.lit, _ONE)).alias("other"))
    while levels:
        groups = levels.pop().select("conv", places, F.struct("block", "m").alias("x")).groupBy("conv", "up").agg(F.array_sort(F.collect_list("x")).alias("x"))
        groups = groups.join(out.select("conv", F.col("block").alias("up"), "other"), ["conv", "up"])

        def parts(r):
            m = r["other"]
            for x in reversed(r["x"]) if backward else r["x"]:
                yield r["conv"], x["block"], m
                m = product(x["m"], m) if backward else product(m, x["m"])

        out = scratch.saved(_by_row(groups, parts, "conv string, block long, other array<long>"), "down")
    return out


def _after(matrix) -> tuple[int, ...]:
    """Prices at the end of a block, from the product of what follows."""
    return tuple(min(_NEVER, *(matrix[4 * s + t] + AT_END[t] for t in range(4))) for s in range(4))


def _solved(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """``blocks`` with their edits and cost."""
    several = blocks.groupBy("conv").count().where("count > 1").select("conv")
    long = scratch.saved(blocks.join(several, "conv", "left_semi").select("conv", "block", "rows"), "long")
    behind = entry = None
    if not long.isEmpty():
        costs = scratch.saved(_by_row(long, lambda r: [(r["conv"], r["block"], cost_matrix(r["rows"]))], "conv string, block long, m array<long>"), "costs")
        behind = _scan(costs, scratch, backward=True).withColumnRenamed("other", "behind")
        ways = long.join(behind, ["conv", "block"])
        ways = _by_row(ways, lambda r: [(r["conv"], r["block"], exit_matrix(r["rows"], _after(r["behind"])))], "conv string, block long, m array<long>")
        entry = _scan(scratch.saved(ways, "ways"), scratch, backward=False).withColumnRenamed("other", "before")
        blocks = blocks.join(behind, ["conv", "block"], "left").join(entry, ["conv", "block"], "left")
    else:
        none = F.lit(None).cast("array<long>")
        blocks = blocks.withColumn("behind", none).withColumn("before", none)

    def edits(r):
        start = START if r["before"] is None else r["before"][:4].index(0)
        behind = r["behind"] or _ONE
        audit, cost = solve(r["rows"], start, _after(behind), behind == _ONE)
        yield r["conv"], r["turn"], r["role"], r["hash"], r["block"], r["rows"], audit, cost

    return _by_row(blocks, edits, "conv string, turn long, role string, hash string, block long, rows string, audit string, cost long")


class _Conversation:
    """One conversation, read row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.digest, self.said = conv_id, hashlib.sha256(), 0
        self.turns, self.low, self.high = 0, None, None
        self.faults, self.illegal, self.last = [0] * 4, 0, None
        self.signs, self.edits, self.audit, self.cost, self.state = deque(), deque(), [], 0, START

    def block(self, rows: str, audit: str, cost: int) -> None:
        self.signs.extend(rows)
        self.edits.extend(audit)
        self.audit.append(audit)
        self.cost += cost

    def _say(self, role: bytes, text: bytes) -> None:
        self.digest.update((b"\n" if self.said else b"") + role + b":")
        self.digest.update(text)
        self.said += 1

    def _insert(self) -> None:
        while self.edits and self.edits[0] == "I":
            self.edits.popleft()
            self.state = _NEXT[self.state]
            self._say(b"user" if self.state == USER else b"assistant", b"")

    def row(self, turn, role: bytes, text: bytes) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        sign = ord(self.signs.popleft()) - _FIRST_SIGN
        initial = INITIALS[sign >> 2]
        self.faults[sign & 3] += 1
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self._insert()
        edit = self.edits.popleft()
        if edit == "K":
            self.state = {"u": USER, "a": ASSISTANT, "s": SYSTEM}[initial]
            self._say(role, text)
        elif edit == "R":
            self.state = _NEXT[self.state]
            self._say(b"user" if self.state == USER else b"assistant", text)

    def result(self) -> tuple:
        self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage."""
    scratch = Scratch(conversations.sparkSession, "convrepair")
    kind = conversations.schema["conv_id"].dataType
    rows = damaged(conversations)
    solved = _solved(_blocks(rows, scratch), scratch)
    # The edits of a block stand before its first row.
    none = lambda t: F.lit(None).cast(t)
    ahead = solved.select(*_ORDER, none(kind).alias("conv_id"), F.col("block"), "rows", "audit", "cost", none("binary").alias("text"), F.lit(True).alias("live"))
    own = rows.select(*_ORDER, "conv_id", F.lit(None).cast("long").alias("block"), none("string").alias("rows"), none("string").alias("audit"), none("long").alias("cost"), F.col("text").cast("binary").alias("text"), "live")
    both = own.unionByName(ahead).withColumn("role", F.col("role").cast("binary")).repartition(parallelism(conversations.sparkSession), "conv")
    both = both.sortWithinPartitions("conv", "turn", "role", "hash", F.col("block").asc_nulls_last()).drop("hash")

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", *_COLUMNS, "audit", "repaired_sha256"]

    def read(batches):
        now, conv = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                done = []
                for r in batch.slice(start, PIECE).to_pylist():
                    if now is None or r["conv"] != conv:
                        done += [now.result()] if now else []
                        now, conv = _Conversation(None), r["conv"]
                    if r["audit"] is not None:
                        now.block(r["rows"], r["audit"], r["cost"])
                        continue
                    now.conv_id = r["conv_id"] if now.conv_id is None else now.conv_id
                    if r["live"]:
                        now.row(r["turn"], r["role"], r["text"])
                yield _batch(done)
        if now:
            yield _batch([now.result()])

    def _batch(done):
        columns = list(zip(*done)) if done else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    out = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", audit string, repaired_sha256 string"
    return both.mapInArrow(read, out)
