"""JSON schemas, chains, cycles and repeated identifiers of tool calls."""

import json
import random
from collections import Counter

import pytest

from salesmart.llm import toolcalls
from salesmart.llm.queries import QUERIES

SCHEMA = {"type": "object", "required": ["to"], "properties": {
    "to": {"type": "array", "items": {"type": "object", "required": ["mail"], "properties": {
        "mail": {"type": "string", "pattern": "@"}, "age": {"type": "integer", "minimum": 0, "exclusiveMaximum": 150}}},
        "minItems": 1, "maxItems": 3},
    "kind": {"enum": ["a", 1, None]}, "free": {"type": "object"}, "extra": {"additionalProperties": {"type": "number"}},
    "size": {"anyOf": [{"type": "string", "maxLength": 2}, {"type": "integer", "multipleOf": 7}]},
    "odd": {"type": "date-time", "pattern": "("}, "no": False, "any": True, "two": {"type": ["string", "null"]},
    "const": {"const": True}, "one": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "nay": {"not": "string"}}}


@pytest.mark.parametrize("arguments,wanted", [
    ({"to": [{"mail": "x@y", "age": 3}]}, []),
    ({"to": [], "kind": "b"}, ["kind is not one of the values", "to is out of bounds"]),
    ({"to": [{"mail": "xy"}, {"age": True}, 5, {"mail": "@", "age": 150, "z": 1}, {}]},
     ["missing to[1].mail", "missing to[4].mail", "to is out of bounds", "to[0].mail does not match",
      "to[1].age is no integer", "to[2] is no object", "to[3].age is out of bounds", "unknown to[3].z"]),
    ({"kind": 1, "free": {"a": {"b": []}}}, ["missing to"]),
    ({"to": None, "extra": {"a": 1, "b": "c"}}, ["extra.b is no number", "missing to"]),
    ({"to": [{"mail": "@"}], "size": "long", "odd": 4, "no": 1, "any": [1], "two": 3},
     ["no is not allowed", "size fails anyOf", "two is no string or null"]),
    ({"to": [{"mail": "@"}], "size": 8, "const": 1, "one": 1, "nay": "s", "else": 0},
     ["const is not one of the values", "nay fails not", "one fails oneOf", "unknown else"]),
])
def test_schema_walk(arguments, wanted):
    assert toolcalls.problems_of("t", json.dumps(arguments), {"t": SCHEMA})[0] == wanted
    assert toolcalls.problems_of("t", json.dumps(arguments), {"t": {}})[0] == sorted(f"unknown {k}" for k in arguments)


def test_schemas_that_mean_nothing_do_not_fail():
    for schema in ({"properties": 3}, {"properties": {"a": 5}}, {"required": None, "additionalProperties": True},
                   {"properties": {"a": {"type": 4, "items": None, "enum": 7, "minimum": "x", "anyOf": 1}}}):
        found, _ = toolcalls.problems_of("t", '{"a": 1}', {"t": schema})
        assert found in ([], ["unknown a"])
    deep = '{"a": ' * 400 + "1" + "}" * 400
    recursive = {"type": "object", "properties": {}}
    recursive["properties"]["a"] = recursive
    assert toolcalls.problems_of("t", deep, {"t": recursive})[0]


def brute_levels(refers):
    """Level of every call, None on or behind a cycle."""
    level = {}
    while True:
        new = {c: 1 + max((level[t] for t in ts if t in refers), default=-1) for c, ts in refers.items()
               if c not in level and all(t in level for t in ts if t in refers)}
        if not new:
            return {c: level.get(c) for c in refers}
        level |= new


CALLS = "conv_id long, call_id string, refers array<string>"


def levels_of(spark, refers):
    rows = spark.createDataFrame([(1, c, ts) for c, ts in refers.items()], CALLS).repartition(4)
    return {r.call_id: r.level for r in toolcalls.levels(rows).collect()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    cut = toolcalls.cut
    monkeypatch.setattr(toolcalls, "cut", lambda df: written.append(1) or cut(df))
    refers = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(2000)}
    assert levels_of(spark, refers) == {f"c{i}": i for i in range(2000)}
    assert len(written) < 25


@pytest.mark.parametrize("seed", range(3))
def test_levels_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    refers = {}
    for i in range(120):
        n = draw.choice([0, 1, 1, 1, 1, 2, 3])
        refers[f"c{i}"] = [f"c{draw.randrange(max(0, i - 6), i)}" for _ in range(n)] if i else []
        if draw.random() < .05:
            refers[f"c{i}"].append("nobody")
    refers["c7"] = ["c20"] if seed else refers["c7"]     # a cycle, with calls behind it
    refers["self"] = ["self"]
    assert levels_of(spark, refers) == brute_levels(refers)


def test_repeated_identifiers_and_plain_turns_are_rows(spark):
    calls = spark.createDataFrame([
        (1, "a", 5, "t", '{"x": 1}', []), (1, "a", 9, "t", '{"x": 2}', []), (1, "a", 9, "t", '{"x": 2}', []),
        (1, "a", 5, "t", '{"x": 1}', []), (None, None, 2, "t", "{}", None), (None, None, 3, "t", "[", None)],
        "conv_id long, call_id string, position long, name string, arguments string, refers array<string>")
    results = spark.createDataFrame([(1, "a", 6, "one"), (1, "a", 7, "two"), (2, "lost", 1, None), (2, "lost", 2, "x")],
                                    "conv_id long, call_id string, position long, content string")
    rows = toolcalls.further_messages(calls, results, {"t": {"properties": {"x": "integer"}}}).collect()
    got = Counter((r.conv_id, r.call_id, r.status, r.position, r.result_position, r.n_calls, r.n_results,
                   json.loads(r.message)["arguments"] and json.loads(r.message)["arguments"]["x"],
                   json.loads(r.message)["content"]) for r in rows)
    assert got == Counter([
        (1, "a", "further call", 5, None, 1, 0, 1, None), (1, "a", "further call", 9, None, 2, 0, 2, None),
        (None, None, "further call", 3, None, 1, 0, None, None), (1, "a", "further result", None, 7, 0, 1, None, "two"),
        (2, "lost", "further result", None, 2, 0, 1, None, "x")])
    first = toolcalls.link_tool_calls(calls, results, {}).collect()
    assert sum(r.n_calls for r in first) == 6 and sum(r.n_results for r in first) == 4
    plain = toolcalls.plain_messages(spark.createDataFrame(
        [(1, 0, "system", "é"), (1, 3, None, None)], "conv_id long, position long, role string, content string")).collect()
    assert sorted(r.message for r in plain) == ['{"content":"é","role":"system"}', '{"content":null,"role":null}']


def test_the_query_reads_every_turn(spark, sf_dir):
    roles = Counter(r.role for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    rows = QUERIES["op3_tool_calls"](spark, sf_dir).collect()
    assert sum(r.n_calls for r in rows) == roles["user"] and sum(r.n_results for r in rows) == roles["assistant"]
    assert sum(r.status == "plain" for r in rows) == sum(roles.values()) - roles["user"] - roles["assistant"] > 0
