import json

from edges import LONG
from pyspark.sql import functions as F

from tideview.llm import toolcalls
from tideview.llm.queries import TURN_SCHEMA

CALLS = "conv_id string, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id string, turn long, call_id string, content string"
SCHEMAS = {"f": {"type": "object", "properties": {"x": {"type": "integer", "maximum": 9}}, "required": ["x"], "additionalProperties": False}}


def run(spark, calls, results):
    a, b = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    for name in ("status", "place", "on", "o", "r", "c", "f", "errors"):
        a, b = a.withColumn(name, F.lit("x")), b.withColumn(name, F.lit("x"))
    rows = toolcalls.link(a, b, SCHEMAS).collect()
    for r in rows:
        value = json.loads(r.exchange)
        assert toolcalls.canonical(value) == r.exchange and value["status"] == r.status
    return rows


def test_links_orphans_duplicates_and_nulls(spark):
    calls = [
        ("c", 1, "a", "f", '{"x": 1}', None), ("c", 1, "a", "f", '{"x": 1}', None), ("c", 4, "a", "f", '{"x": 2}', []),
        ("c", 2, "b", "f", "nonsense", ["a"]), ("c", 3, "d", "g", None, ["zz"]), ("e", 1, "a", "f", '{"x":10,"y":0}', []),
        ("c", 5, None, "f", '{"x":1}', []), (None, 5, "a", "f", '{"x":1}', ["a"]),
    ]
    results = [
        ("c", 2, "a", "é"), ("c", 9, "a", "late"), ("c", 2, "a", "é"), ("e", 2, "a", None), ("c", 3, "q", "who?"), ("c", 1, None, "x"), (None, 1, "a", "x"),
    ]
    got = {}
    for r in run(spark, calls, results):
        got.setdefault((r.conv_id, r.call_id, r.status), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {
        ("c", "a", "linked"): 1, ("c", "a", "duplicate"): 1, ("c", "a", "orphan_result"): 1, ("c", "b", "no_result"): 1,
        ("c", "d", "no_result"): 1, ("e", "a", "linked"): 1, ("c", None, "no_result"): 1, (None, "a", "no_result"): 1,
        ("c", "q", "orphan_result"): 1, ("c", None, "orphan_result"): 1, (None, "a", "orphan_result"): 1,
    }
    first = got["c", "a", "linked"][0]
    assert first.exchange == '{"arguments":{"x":1},"depends_on":[],"id":"a","name":"f","result":"é","status":"linked"}'
    assert first.valid and first.place == 0 and got["c", "b", "no_result"][0].place == 1
    assert got["c", "b", "no_result"][0].errors == ["arguments are not JSON"]
    assert got["c", "d", "no_result"][0].errors == ["the tool is unknown", "no call zz"]
    assert got["e", "a", "linked"][0].errors == [".x is out of bounds", ".y is unknown"]
    assert got[None, "a", "no_result"][0].place is None


def test_places_of_a_dag_a_chain_and_cycles(spark):
    dag = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "a"], "x": ["y"], "y": ["x"], "z": ["y"], "s": ["s"]}
    chain = {f"n{i}": [f"n{i - 1}"] if i else [] for i in range(70)}
    calls = [("1", 0, k, "f", '{"x":1}', v) for k, v in dag.items()] + [("2", 0, k, "f", '{"x":1}', v) for k, v in chain.items()]
    got = {(r.conv_id, r.call_id): r.place for r in run(spark, calls, [])}
    assert {k: got["1", k] for k in dag} == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None, "s": None}
    assert all(got["2", f"n{i}"] == i for i in range(70))


def test_problems():
    schema = {"type": "array", "items": {"type": "string", "minLength": 1, "maxLength": 2, "enum": ["a", "abc", ""]}}
    assert toolcalls.problems(["a"], schema) == []
    assert toolcalls.problems(["b", "abc", "", 1], schema) == [
        "[0] is none of the allowed values", "[1] is too long", "[2] is too short", "[3] is not of type string",
    ]
    assert toolcalls.problems(True, {"type": "integer"}) == [". is not of type integer"]
    assert toolcalls.arguments_of("NaN")[1] and toolcalls.arguments_of(" ") == ({}, None)


def test_turns(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", LONG), (1, 4, "assistant", None),
        (2, 0, "user", ""), (2, 0, "user", ""), (None, 0, "user", "x"), (2, None, "user", "x"), (2, 1, None, None), (3, 5, "assistant", "alone"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.turns_as_calls(messages)
    rows = toolcalls.link(calls, results, {"reply": TURN_SCHEMA, "instruct": TURN_SCHEMA}).collect()
    got = {(r.conv_id, r.call_id): (r.status, r.place, r.valid) for r in rows}
    assert got["1", "call_0"] == ("no_result", 0, True)
    assert got["1", "call_1"] == ("linked", 1, True) and got["1", "call_3"] == ("linked", 2, True)
    assert got["2", "call_0"] == ("no_result", 0, False)  # an empty prompt
    assert got["3", "call_4"] == ("orphan_result", None, False)


def test_empty(spark):
    assert run(spark, [], []) == []


def test_hostile_arguments_are_not_json(spark):
    texts = ['{"x":1e999}', '{"x":[[-1e999]]}', '{"x":"\\ud800"}', '{"\\udfff":1}', "[" * 5000, '{"x":NaN}', '{"x":1' + "0" * 5000 + "}", '{"x":"\\ud83d\\ude00"}']
    calls = [("c", i, f"k{i}", "f", text, None) for i, text in enumerate(texts)]
    rows = {r.call_id: r for r in run(spark, calls, [("c", 1, "k0", "x")])}
    assert len(rows) == len(texts)
    for i in range(6):
        assert rows[f"k{i}"].errors == ["arguments are not JSON"] and not rows[f"k{i}"].valid
    assert rows["k7"].errors == [".x is not of type integer"] and "\U0001f600" in rows["k7"].exchange
