"""op11: against a plain search over suffixes, in one block and in many."""

import hashlib
import random
import zlib

import pytest

from tideview.llm import convrepair, queries
from tideview.llm.convrepair import AT_END, auction, repair, repair_conversations

WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) of rows (initial, fault): least suffixes, from the end."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for initial, fault in reversed(rows):
        new = {}
        for s in range(4):
            ways = [(4 + best[s][0], "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                to = {"u": 2, "a": 3, "s": 1}.get(initial)
                if to is not None and (to == nxt[s] or (to == 1 and s == 0)):
                    ways.append((more + best[to][0], "K" + best[to][1]))
                ways.append((3 + more + best[nxt[s]][0], "R" + best[nxt[s]][1]))
            new[s] = min(ways)
        for _ in range(4):
            for s in range(4):
                c, x = new[nxt[s]]
                new[s] = min(new[s], (c + 3, "I" + x))
        best = new
    return best[0]


def brute(rows):
    """The contract, row by row: {conv_id: result}."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if role is None else role), (" " if text is None else text)
        case = zlib.crc32(key.encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else "".join(c for c in text if c not in ".!?") if case == 2 else text
        role = "user" if case == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, signs = set(), []
        for _, role, text in mine:
            said = text.rstrip(WS)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            signs.append((role[:1] if role[:1] in ("u", "a", "s") else "x", fault))
        cost, audit = cheapest(signs)
        state, said, at = 0, [], 0
        for edit in audit:
            nxt = 3 if state == 2 else 2
            name = "user" if nxt == 2 else "assistant"
            if edit == "I":
                said.append(name + ":")
                state = nxt
                continue
            _, role, text = mine[at]
            at += 1
            if edit == "K":
                said.append(f"{role}:{text}")
                state = {"u": 2, "a": 3, "s": 1}[role[0]]
            elif edit == "R":
                said.append(f"{name}:{text}")
                state = nxt
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = [sum(f == k for _, f in signs) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(signs, signs[1:]))
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_the_auction_finds_the_cheapest_and_least_edits():
    rng = random.Random(5)
    for _ in range(3000):
        rows = [(rng.choice("uuaasx"), rng.choice(convrepair.FAULTS + ("", "", ""))) for _ in range(rng.randrange(0, 14))]
        signs = "".join(chr(65 + 4 * "uasx".index(i) + convrepair.FAULTS.index(f)) for i, f in rows)
        assert repair(signs)[::-1] == cheapest(rows)


def test_prices_are_a_feasible_dual():
    rng = random.Random(6)
    for _ in range(200):
        rows = "".join(chr(65 + rng.randrange(16)) for _ in range(40))
        price = auction(rows, AT_END)
        for node in range(4 * len(rows)):
            for cost, step, _ in convrepair.ARCS[rows[node >> 2]][node & 3]:
                assert price[node] <= cost + price[node + step]


def make(rng, conv, n):
    said = ["", " ", "Hello.", "Hello", "How are you? ", "Fine!\n", "x" * 50 + ".", "\t\n", "ſ.", "  ok"]
    return [
        (conv, None if rng.random() < 0.03 else rng.randrange(2 * n), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), None if rng.random() < 0.03 else rng.choice(said) + (str(rng.randrange(n)) + "." if rng.random() < 0.7 else ""))
        for _ in range(n)
    ]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [4, 12])
def test_conversations_against_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(convrepair, "_BITS", bits)
    rng = random.Random(bits)
    rows = [r for c in range(60) for r in make(rng, c, rng.choice([1, 2, 3, 8, 30]))] + make(rng, None, 6) + make(rng, 99, 700)
    rows += [(100, 1, "user", "Same.")] * 300
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair_conversations(df)) == brute(rows)


def test_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi.", 3, "x")], "conv_id string, turn int, role string, text string, hash int, rows string")
    (row,) = repair_conversations(df).collect()
    assert row.conv_id == "a" and brute([("a", 1, "user", "Hi.")])["a"] == tuple(row)[1:]
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    (row,) = repair_conversations(spark.createDataFrame([(7, turn, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_repair(spark, sf)) == brute(rows)
