"""Chat formatting: link tool calls with their results and serialise them.

Calls and results are hash-joined by conversation and identifier. A call's arguments are
validated against the schema of its tool. Calls are ordered topologically: ``place`` is the
length of the longest chain of calls that a call depends on. Rounds settle the calls whose dependencies are
settled; once no unsettled call waits for more than one other, pointers are doubled, so a long chain
takes a number of rounds that grows with its logarithm. Every exchange becomes one line of
canonical JSON: keys sorted, no white space, characters as they are.

A conversation is never gathered; every row is keyed by conversation and identifier.

Defined results, by ``status``: ``linked`` and ``no_result`` for calls, ``orphan_result`` for a result
without a call or after the first of its call. An identifier that is used by several calls of
a conversation belongs to the first (smallest turn, then tool, then arguments); the others are ``duplicate``
and take no result. Of several results the first counts (smallest turn, then content). Equal calls or results are one row. A null identifier
or conversation matches nothing: such calls have no result, such results are orphans. Calls in or behind a cycle have no place and
are marked as errors, as are dependencies that no call has. Null or empty arguments are an empty
object; text with a number beyond the range of a double or a lone surrogate is not JSON, wherever in it that stands; a null content is a JSON null. Further columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import Scratch, by_batch

_KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}
KEY = ["conv_id", "call_id"]


def problems(value, schema: dict, at: str = "") -> list[str]:
    """What a value breaks of a schema: type, enum, bounds, required and unknown properties, items."""
    kind = schema.get("type")
    if kind:
        fits = isinstance(value, _KINDS[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))
        if not fits:
            return [f"{at or '.'} is not of type {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at or '.'} is none of the allowed values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at or '.'} is too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            out.append(f"{at or '.'} is too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at or '.'} is out of bounds")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{name} is missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                out += problems(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{name} is unknown")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += problems(item, schema["items"], f"{at}[{i}]")
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(name)


def arguments_of(text: str | None):
    """(value, problem): parsed arguments, or the text itself if it is no JSON."""
    if text is None or not text.strip():
        return {}, None
    try:
        value = json.loads(text, parse_constant=_no_constant)
        canonical(value).encode()  # numbers beyond a double and lone surrogates can't be written again
    except (ValueError, RecursionError):
        return text, "arguments are not JSON"
    return value, None


def places(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, place for the calls (keys unique, not null) that are in no cycle and behind none."""
    nodes = calls.select(*KEY)
    waits = calls.select("conv_id", F.col("call_id"), F.explode("depends_on").alias("on")).distinct()
    there = nodes.select("conv_id", F.col("call_id").alias("on"))
    waits = scratch.saved(waits.join(there, ["conv_id", "on"], "left_semi"), "waits")
    settled = scratch.saved(nodes.join(waits, KEY, "left_anti").withColumn("place", F.lit(0)), "settled")
    frontier, found, step = settled, [settled], 0
    while True:
        gone = frontier.select("conv_id", F.col("call_id").alias("on"))
        left = scratch.saved(waits.join(gone, ["conv_id", "on"], "left_anti"), "waits")
        step += 1
        frontier = waits.join(left, KEY, "left_anti").select(*KEY).distinct().withColumn("place", F.lit(step))
        frontier = scratch.saved(frontier, "settled")
        if frontier.isEmpty():
            break
        found.append(frontier)
        waits = left
        most = waits.groupBy(*KEY).count().agg(F.max("count")).first()[0]
        if most is None:
            break
        if most == 1:
            found.append(_chains(waits, step, scratch))
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _chains(waits: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """Places of calls that each wait for one other: distances to the settled ones, by doubling."""
    jump = waits.withColumn("far", F.lit(1))
    total, reach = waits.count(), 1
    while True:
        up = jump.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("next"), F.col("far").alias("more"))
        joined = jump.join(up, ["conv_id", "on"], "left")
        far = F.col("far") + F.coalesce("more", F.lit(0))
        jump = scratch.saved(joined.select(*KEY, F.col("next").alias("on"), far.alias("far")), "jump")
        reach *= 2
        if reach > total or jump.where("on is not null").isEmpty():
            return jump.where("on is null").select(*KEY, (F.col("far") + step).cast("int").alias("place"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Rows of conv_id, call_id, turn, name, status, place, valid, errors, exchange.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text), depends_on (identifiers);
    ``results`` has conv_id, turn, call_id, content. ``turn`` of a row is that of its call, or of an orphan's result.
    """
    scratch = Scratch(calls.sparkSession, "toolcalls")
    text = lambda c: F.col(c).cast("string").alias(c)
    calls = calls.select(
        text("conv_id"), F.col("turn").cast("long").alias("turn"), text("call_id"), text("name"), text("arguments"),
        F.coalesce(F.array_sort(F.array_distinct(F.array_compact("depends_on"))), F.array().cast("array<string>")).alias("depends_on"),
    ).distinct()
    results = results.select(text("conv_id"), F.col("turn").cast("long").alias("turn"), text("call_id"), text("content")).distinct()
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    order = F.struct(F.coalesce("turn", F.lit(2**62)), F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), "depends_on")
    first = calls.where(keyed).groupBy(*KEY).agg(F.min(F.struct(order.alias("o"), "turn", "name", "arguments", "depends_on")).alias("c"))
    first = scratch.saved(first.select(*KEY, "c.turn", "c.name", "c.arguments", "c.depends_on"), "calls")
    early = F.struct(F.coalesce("turn", F.lit(2**62)), F.coalesce("content", F.lit("")))
    answer = results.where(keyed).groupBy(*KEY).agg(F.min(F.struct(early.alias("o"), "turn", "content")).alias("r"))
    answer = answer.select(*KEY, F.col("r.turn").alias("result_turn"), "r.content", F.lit(True).alias("answered"))

    known = first.select("conv_id", F.col("call_id").alias("on"))
    asked = first.select(*KEY, F.explode("depends_on").alias("on")).join(known, ["conv_id", "on"], "left_anti")
    missing = asked.groupBy(*KEY).agg(F.array_sort(F.collect_set("on")).alias("missing"))
    linked = first.join(answer, KEY, "left").join(places(first, scratch), KEY, "left").join(missing, KEY, "left")
    linked = linked.withColumn("status", F.when(F.col("answered"), "linked").otherwise("no_result"))

    none = lambda kind: F.lit(None).cast(kind)
    columns = [*KEY, "turn", "name", "arguments", "depends_on", "result_turn", "content", "place", "missing", "status"]
    same = _same(["turn", "name", "arguments", "depends_on"])
    second = calls.where(keyed).alias("c").join(first.alias("f"), same, "left_anti").select("c.*").withColumn("status", F.lit("duplicate"))
    loose = calls.where(~keyed).withColumn("status", F.lit("no_result")).withColumn("place", F.when(F.size("depends_on") == 0, 0))
    others = second.withColumn("place", none("int")).unionByName(loose)
    others = others.select("*", none("long").alias("result_turn"), none("string").alias("content"), none("array<string>").alias("missing"))
    used = first.join(answer, KEY).select(*KEY, F.col("result_turn").alias("turn"), "content")
    same = _same(["turn", "content"])
    orphans = results.alias("c").join(used.alias("f"), same, "left_anti").select("c.*")
    orphans = orphans.select(
        *KEY, "turn", none("string").alias("name"), none("string").alias("arguments"), none("array<string>").alias("depends_on"),
        F.col("turn").alias("result_turn"), "content", none("int").alias("place"), none("array<string>").alias("missing"),
        F.lit("orphan_result").alias("status"),
    )
    rows = linked.select(columns).unionByName(others.select(columns)).unionByName(orphans.select(columns))
    return rows.mapInArrow(by_batch(_serialiser(schemas)), _SCHEMA)


_SCHEMA = (
    "conv_id string, call_id string, turn long, name string, status string, place int, valid boolean, "
    "errors array<string>, exchange string"
)


def _same(columns: list[str]) -> Column:
    """Equal keys (not null) and equal columns (null-safe) of c and f."""
    out = (F.col("c.conv_id") == F.col("f.conv_id")) & (F.col("c.call_id") == F.col("f.call_id"))
    for c in columns:
        out &= F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}"))
    return out


def _serialiser(schemas: dict[str, dict]):
    def exchange(r: dict) -> tuple[list[str], str]:
        errors, out = [], {"id": r["call_id"], "status": r["status"]}
        if r["status"] != "orphan_result":
            value, problem = arguments_of(r["arguments"])
            errors += [problem] if problem else []
            if r["name"] not in schemas:
                errors.append("the tool is unknown")
            elif not problem:
                errors += problems(value, schemas[r["name"]])
            errors += [f"no call {x}" for x in r["missing"] or []]
            if r["status"] in ("linked", "no_result") and r["place"] is None:
                errors.append("it depends on itself or waits for a call that does")
            out |= {"name": r["name"], "arguments": value, "depends_on": r["depends_on"]}
        if r["status"] in ("linked", "orphan_result"):
            out["result"] = r["content"]
        return errors, canonical(out)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        done = [exchange(r) for r in rows]
        valid = [not e and r["status"] in ("linked", "no_result") for r, (e, _) in zip(rows, done)]
        columns = {n: [r[n] for r in rows] for n in ("conv_id", "call_id", "turn", "name", "status", "place")}
        columns |= {"valid": valid, "errors": [e for e, _ in done], "exchange": [x for _, x in done]}
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds)], list(columns))

    return work


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations (conv_id, turn, role, text).

    A user's turn is a call of ``reply`` and a system turn one of ``instruct``; an assistant's turn is
    the result of the call in the turn before. A call depends on the ones of the turn before (a system turn) and
    of two turns before (the last question), where there are such.
    """
    turn = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    asking = messages.where(F.coalesce(F.col("role"), F.lit("")) != "assistant")
    prompt = F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn"), F.col("role").alias("role")))
    calls = asking.select(
        "conv_id", turn.alias("turn"), name(turn).alias("call_id"),
        F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"), prompt.alias("arguments"),
    )
    ids = calls.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("t")).distinct()
    near = ids.select("conv_id", F.explode(F.array(F.col("t") + 1, F.col("t") + 2)).alias("turn"), name(F.col("t")).alias("on"))
    on = near.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_set("on")).alias("depends_on"))  # at most two
    calls = calls.join(on, ["conv_id", "turn"], "left")
    results = messages.where("role = 'assistant'").select("conv_id", turn.alias("turn"), name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
