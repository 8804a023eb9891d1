"""Tool-call linking for chat formatting.

Calls and results are hash-joined by conversation and identifier, calls are put
in topological order of what they refer to, arguments are validated against the
tool's schema, and each call with its result becomes one canonical JSON line
(sorted keys, no spaces, UTF-8 as it is).

The order is given as (level, position): a call's level is one more than the
highest level it refers to, so sorting by level, then position is topological.
Levels come from rounds of joins, not from gathering a conversation in one task.

Defined cases: of several calls (or results) with one identifier in one
conversation the first by position counts, and their number is returned; the
others are rows of ``further_messages``.  A result without a call has status
``orphan``, a call without a result ``unanswered``.  References to unknown identifiers are reported and do not
order; calls on a cycle, or behind one, have a null level.  Null identifiers or
conversations are values like others.  Null or malformed arguments are invalid
(NaN, infinite numbers and nesting too deep to read among them); null contents
become JSON null, half surrogates stay escaped.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import ship
from salesmart.session import cut

# JSON type names of a schema and what Python reads them as
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict,
         "null": type(None)}


def problems_of(name: str | None, arguments: str | None, schemas: dict) -> tuple[list[str], object]:
    """What is wrong with a call's arguments, and the arguments as read (None if unreadable)."""
    if name not in schemas:
        return ["unknown tool"], _read(arguments)
    value = _read(arguments)
    if not isinstance(value, dict):
        return ["arguments are not an object"], value
    try:
        found = faults(value, {"type": "object", "properties": {}, **schemas[name]})
    except RecursionError:
        found = ["arguments are nested too deep"]
    return sorted(set(map(_escaped, found))), value


def faults(value, schema, path: str = "") -> list[str]:
    """Where ``value`` departs from a JSON schema, which may also be a bare type name, true or false.

    Known are type, enum, const, the bounds of numbers, texts and arrays, pattern,
    items, properties, required, additionalProperties, anyOf, oneOf, allOf and not;
    other keywords, and types and patterns that mean nothing, are no constraint.  An
    object with ``properties`` takes no others unless additionalProperties says so.
    A null counts as absent: it satisfies no ``required`` and breaks no other rule.
    """
    here = path or "value"
    if isinstance(schema, str):
        schema = {"type": schema}
    if schema is False:
        return [f"{here} is not allowed"]
    if not isinstance(schema, dict) or value is None:
        return []
    kinds = schema.get("type")
    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str) and k in TYPES]
    if kinds and not any(isinstance(value, TYPES[k]) and (k == "boolean") == isinstance(value, bool) for k in kinds):
        return [f"{here} is no {' or '.join(kinds)}"]
    found = []
    if isinstance(schema.get("enum"), list) and not any(_equal(value, e) for e in schema["enum"]) \
            or "const" in schema and not _equal(value, schema["const"]):
        found.append(f"{here} is not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += _bounds(here, value, schema, "minimum", "maximum")
        for key, beyond in (("exclusiveMinimum", lambda x: value <= x), ("exclusiveMaximum", lambda x: value >= x)):
            if _is_number(schema.get(key)) and beyond(schema[key]):
                found.append(f"{here} is out of bounds")
    elif isinstance(value, str):
        found += _bounds(here, len(value), schema, "minLength", "maxLength")
        if isinstance(schema.get("pattern"), str):
            try:
                if not re.search(schema["pattern"], value):
                    found.append(f"{here} does not match")
            except re.error:
                pass
    elif isinstance(value, list):
        found += _bounds(here, len(value), schema, "minItems", "maxItems")
        for i, item in enumerate(value if "items" in schema else []):
            found += faults(item, schema["items"], f"{path}[{i}]")
    elif isinstance(value, dict):
        found += _object_faults(value, schema, path)
    for key, holds in (("anyOf", lambda n, of: n > 0), ("oneOf", lambda n, of: n == 1), ("allOf", lambda n, of: n == of)):
        choices = schema.get(key)
        if isinstance(choices, list) and not holds(sum(not faults(value, c, path) for c in choices), len(choices)):
            found.append(f"{here} fails {key}")
    if "not" in schema and not faults(value, schema["not"], path):
        found.append(f"{here} fails not")
    return found


def _object_faults(value: dict, schema: dict, path: str) -> list[str]:
    known = schema.get("properties")
    known = known if isinstance(known, dict) else {}
    rest = schema.get("additionalProperties", "properties" not in schema)
    dot = f"{path}." if path else ""
    found = [f"missing {dot}{f}" for f in schema.get("required") or [] if value.get(f) is None]
    for field, held in value.items():
        if field in known:
            found += faults(held, known[field], f"{dot}{field}")
        elif rest is False:
            found.append(f"unknown {dot}{field}")
        else:
            found += faults(held, rest, f"{dot}{field}")
    return found


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _bounds(here: str, size, schema: dict, least: str, most: str) -> list[str]:
    low, high = schema.get(least), schema.get(most)
    outside = _is_number(low) and size < low or _is_number(high) and size > high
    return [f"{here} is out of bounds"] if outside else []


def _equal(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def _finite(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise ValueError(number)
    return value


def _read(text: str | None):
    try:
        return None if text is None else json.loads(text, parse_float=_finite, parse_constant=_finite)
    except (ValueError, RecursionError):
        return None


def _escaped(text: str) -> str:
    """Half surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _key(call_id: str) -> Column:
    """One text for conversation and identifier, which may be null."""
    return F.to_json(F.struct(F.col("conv_id").cast("string").alias("c"), F.col(call_id).cast("string").alias("t")))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level and n_unknown of calls (conv_id, call_id, refers array), one row per identifier.

    Calls with one reference form chains, which are followed by doubling: each
    round every call points twice as far, so a chain of n calls takes log n rounds.
    What is left are calls with several references; each round places those whose
    references all have levels, and looks only at calls still open.  A round writes
    one table.
    """
    edges = calls.select(_key("call_id").alias("key"), "conv_id", F.explode(F.array_distinct("refers")).alias("target"))
    known = calls.select(_key("call_id").alias("target"), F.lit(True).alias("found"))
    edges = cut(edges.select("key", _key("target").alias("target")).join(known, "target", "left"))
    degree = cut(edges.groupBy("key").agg(F.count_if("found").alias("needs"),
                                          F.count_if(F.col("found").isNull()).alias("n_unknown")))
    edges = edges.where("found").select("key", "target")
    chained = _chains(edges, degree)

    # calls with several references, on what the chains below these lead to
    joints = edges.join(degree.where("needs > 1").select("key"), "key")
    ends = chained.select(F.col("key").alias("target"), "anchor", "distance")
    joints = cut(joints.join(ends, "target", "left").select(
        "key", F.coalesce("anchor", "target").alias("anchor"), (F.coalesce("distance", F.lit(0)) + 1).alias("step")))
    keys = calls.select(_key("call_id").alias("key"))
    placed = cut(keys.join(degree.where("needs > 0"), "key", "left_anti").select("key", F.lit(0).alias("level")))
    fresh = placed
    while not joints.isEmpty():
        below = fresh.select(F.col("key").alias("anchor"), F.col("level").alias("below"))
        met = joints.join(below, "anchor", "left")
        # what a reference gives, once it is known
        given = F.coalesce(F.col("below") + F.col("step"), F.col("given")) if "given" in joints.columns \
            else F.col("below") + F.col("step")
        joints = cut(met.withColumn("given", given).select("key", "anchor", "step", "given"))
        fresh = cut(joints.groupBy("key").agg(F.max("given").alias("level"), F.count_if(F.col("given").isNull()).alias("open"))
                    .where("open = 0").select("key", "level"))
        if fresh.isEmpty():
            break
        placed = placed.unionByName(fresh)
        joints = joints.join(fresh.select("key"), "key", "left_anti")
    levelled = placed.unionByName(
        chained.join(placed.withColumnsRenamed({"key": "anchor"}), "anchor").select(
            "key", (F.col("level") + F.col("distance")).alias("level")))
    return calls.select("conv_id", "call_id", _key("call_id").alias("key")).join(levelled, "key", "left").join(
        degree.select("key", "n_unknown"), "key", "left").select(
        "conv_id", "call_id", F.col("level").cast("int").alias("level"),
        F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


def _chains(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """key, anchor and distance of calls with one reference: the first call down the chain with none or several.

    Calls on a cycle, and behind one, are left out.
    """
    single = degree.where("needs = 1").select("key")
    ends = single.select(F.col("key").alias("anchor"), F.lit(True).alias("goes_on"))
    state = cut(edges.join(single, "key").select("key", F.col("target").alias("anchor")).join(ends, "anchor", "left")
                .select("key", "anchor", F.lit(1).cast("long").alias("distance"),
                        F.coalesce("goes_on", F.lit(False)).alias("open")))
    left = None
    while True:
        waiting = state.where("open").count()
        if waiting in (0, left):        # a round that closes none has only cycles before it
            return state.where("NOT open").select("key", "anchor", "distance")
        left = waiting
        onward = state.select(F.col("key").alias("anchor"), F.col("anchor").alias("further"),
                              F.col("distance").alias("more"), F.col("open").alias("still"))
        doubled = state.where("open").join(onward, "anchor").select(
            "key", F.col("further").alias("anchor"), (F.col("distance") + F.col("more")).alias("distance"),
            F.col("still").alias("open"))
        state = cut(state.where("NOT open").unionByName(doubled))


def _same(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join by conversation and identifier, nulls being equal."""
    r = right.withColumnsRenamed({"conv_id": "__c", "call_id": "__t"})
    on = F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("call_id").eqNullSafe(F.col("__t"))
    return left.join(r, on, how).drop("__c", "__t")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per conversation and identifier.

    ``calls`` has conv_id, call_id, position, name, arguments (JSON) and refers
    (array of identifiers), ``results`` conv_id, call_id, position and content.
    """
    keys = ["conv_id", "call_id"]
    called = calls.groupBy(*keys).agg(
        F.min(F.struct("position", "name", "arguments", "refers")).alias("call"), F.count("*").alias("n_calls"))
    answered = results.groupBy(*keys).agg(
        F.min(F.struct("position", "content")).alias("result"), F.count("*").alias("n_results"))
    called = called.select(*keys, "call.*", "n_calls")
    order = levels(called.select(*keys, "refers"))
    called = _same(called.drop("refers"), order)
    r = answered.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rt"),
                        F.col("result.position").alias("result_position"), F.col("result.content").alias("content"),
                        "n_results")
    both = called.join(r, F.col("conv_id").eqNullSafe(F.col("rc")) & F.col("call_id").eqNullSafe(F.col("rt")), "full")
    rows = both.select(
        F.when(F.col("n_calls").isNull(), F.col("rc")).otherwise(F.col("conv_id")).alias("conv_id"),
        F.when(F.col("n_calls").isNull(), F.col("rt")).otherwise(F.col("call_id")).alias("call_id"),
        "position", "level", F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), "result_position",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered")
        .otherwise("linked").alias("status"), "name", "arguments", "content")
    return _serialised(rows, schemas)


def further_messages(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """The calls and results that ``link_tool_calls`` does not serialise: all but the first of an identifier.

    Rows of the same columns with status ``further call`` or ``further result``,
    rows equal in everything once, with their number in n_calls or n_results.
    """
    keys = ["conv_id", "call_id"]
    parts = []
    for df, columns, what, count in ((calls, ["position", "name", "arguments", "refers"], "call", "n_calls"),
                                     (results, ["position", "content"], "result", "n_results")):
        whole = F.struct(*columns)
        first = _renamed(df.groupBy(*keys).agg(F.min(whole).alias("_first"), F.count(F.lit(1)).alias("_all")).where("_all > 1"))
        copies = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_copies"))
        on = F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("call_id").eqNullSafe(F.col("__t"))
        further = copies.join(first, on).withColumn(
            "_copies", F.col("_copies") - whole.eqNullSafe(F.col("_first")).cast("long")).where("_copies > 0")
        own = {"n_calls": F.lit(0), "n_results": F.lit(0), count: F.col("_copies"),
               "position": F.col("position") if what == "call" else F.lit(None),
               "result_position": F.col("position") if what == "result" else F.lit(None),
               **{c: F.col(c) if c in columns else F.lit(None) for c in ("name", "arguments", "content")}}
        parts.append(further.select(
            *keys, own["position"].cast("long").alias("position"), F.lit(None).cast("int").alias("level"),
            F.lit(0).cast("long").alias("n_unknown"), own["result_position"].cast("long").alias("result_position"),
            own["n_calls"].cast("long").alias("n_calls"), own["n_results"].cast("long").alias("n_results"),
            F.lit(f"further {what}").alias("status"),
            *[own[c].cast("string").alias(c) for c in ("name", "arguments", "content")]))
    return _serialised(parts[0].unionByName(parts[1]), schemas)


def plain_messages(turns: DataFrame) -> DataFrame:
    """Turns that are neither call nor result (conv_id, position, role, content), as rows of the same columns."""
    empty = F.lit(None)
    rows = turns.select(
        "conv_id", empty.cast("string").alias("call_id"), F.col("position").cast("long").alias("position"),
        empty.cast("int").alias("level"), *[F.lit(0).cast("long").alias("n_unknown")],
        empty.cast("long").alias("result_position"), F.lit(0).cast("long").alias("n_calls"),
        F.lit(0).cast("long").alias("n_results"), F.lit("plain").alias("status"), F.col("role").alias("name"),
        empty.cast("string").alias("arguments"), F.col("content").cast("string").alias("content"))
    return _serialised(rows, {})


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"conv_id": "__c", "call_id": "__t"})


def _message(row: dict, schemas: dict) -> tuple[str, str]:
    """Problems and canonical JSON of one row."""
    if row["status"] == "plain":
        return "", canonical({"content": row["content"], "role": row["name"]})
    without_call = row["status"] in ("orphan", "further result")
    found, value = ([], None) if without_call else problems_of(row["name"], row["arguments"], schemas)
    return "; ".join(found), canonical({"arguments": value, "content": row["content"], "id": row["call_id"],
                                        "name": row["name"], "valid": not found})


def _serialised(rows: DataFrame, schemas: dict) -> DataFrame:
    ship(rows.sparkSession)
    kept = ["conv_id", "call_id", "position", "level", "n_unknown", "result_position", "n_calls", "n_results", "status"]

    def serialise(batches):
        for batch in batches:
            made = [_message(r, schemas) for r in batch.select(
                ["call_id", "status", "name", "arguments", "content"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.string())], names=[*kept, "problems", "message"])

    schema = rows.select(*kept).schema.add("problems", "string").add("message", "string")
    return rows.mapInArrow(serialise, schema)
