"""Tool calls of chats: linked to their results, put in order, validated and written as canonical JSON.

A call is an entry of ``{"tool_calls": [{"id", "name", "arguments"}]}`` in an assistant's text,
a result a tool's text ``{"tool_call_id", "content"}``.  Both sides are hash-joined by
conversation and id; the n-th call of an id takes its n-th result.

Order is topological: a call comes after the calls that its arguments refer to
(``{"$result": "<id>"}`` at any depth), whether they stand before or behind it.  A call without a reference has level 0, another
one the level after the highest that it needs.  References are peeled, level by level, with two joins per level over
those that are left; calls on a cycle or behind one get no level.  Records carry their sort key (level, turn, number), so no
conversation, however long, is ever gathered.

Defined results: null, empty and non-JSON texts hold neither calls nor results.  Status is
``linked``, ``unanswered`` (no result) or ``orphan`` (no call).  Null ids and null
conversations are never linked.  Unknown tools, broken or missing arguments and arguments that break
the schema are invalid with the reasons listed.  Repeated calls and results pair up in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.arrowtools import text_slices
from tickloom.session import materialise

_CALLS = "tool_calls array<struct<id string, name string, arguments string>>"
_RESULT = "tool_call_id string, content string"


def tool_calls(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, call_id, turn, number, name, arguments)`` of all calls."""
    parsed = messages.where((F.col(role) == "assistant") & F.col(text).contains('"tool_calls"')).select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.from_json(text, _CALLS).alias("m"))
    return parsed.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("number", "c")).select(
        "conv_id", F.col("c.id").alias("call_id"), "turn", "number", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


def tool_results(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, call_id, result_turn, content)`` of all results."""
    parsed = messages.where((F.col(role) == "tool") & F.col(text).contains('"tool_call_id"')).select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("result_turn"), F.from_json(text, _RESULT).alias("m"))
    return parsed.where(F.col("m.tool_call_id").isNotNull()).select("conv_id", F.col("m.tool_call_id").alias("call_id"), "result_turn", F.col("m.content").alias("content"))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Full outer join of calls and results by conversation, id and repetition."""
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def numbered(rows: DataFrame, mark: str, *order: str) -> DataFrame:
        # rows without an id are set aside: they are no group, and meet nothing
        nth = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy(*order))
        known = rows.where(named).withColumn("nth", nth)
        return known.unionByName(rows.where(~named).withColumn("nth", F.lit(None).cast("int"))).withColumn(mark, F.lit(True))

    a = numbered(calls, "called", "turn", "number", "name", "arguments")
    b = numbered(results, "answered", "result_turn", "content")
    both = a.join(b, ["conv_id", "call_id", "nth"], "full")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    return both.withColumn("status", status).drop("called", "answered")


_REFERENCE = r'"\$result"\s*:\s*"((?:[^"\\]|\\.)*)"'


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of every call that refers to another one of its conversation; null on and behind cycles."""
    known = calls.where("conv_id is not null and call_id is not null")
    uses = known.select("conv_id", "call_id", F.explode(F.regexp_extract_all("arguments", F.lit(_REFERENCE), 1)).alias("needs")).distinct()
    edges = materialise(uses.join(known.select("conv_id", F.col("call_id").alias("needs")).distinct(), ["conv_id", "needs"]))
    left = materialise(edges.select("conv_id", "call_id").distinct())
    done, level = [], 1
    while not left.isEmpty():
        # what waits for nobody any more holds no one up
        edges = materialise(edges.join(left.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi"))
        held = edges.select("conv_id", "call_id").distinct()
        free = materialise(left.join(held, ["conv_id", "call_id"], "left_anti"))
        if free.isEmpty():
            break
        done.append(free.withColumn("level", F.lit(level)))
        left = materialise(held)
        level += 1
    return reduce(DataFrame.unionByName, done, left.withColumn("level", F.lit(None).cast("int")))


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and unescaped Unicode."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def schema_errors(value: object, schema: dict, path: str = "$") -> list[str]:
    """What breaks the schema: type, enum, required, properties, additionalProperties, items, lengths and bounds."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _KINDS.get(k, ())) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return [f"{path}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not allowed")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{path}: out of bounds")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += schema_errors(item, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += schema_errors(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: unknown")
    return out


@lru_cache(1024)
def _schema(text: str) -> dict:
    return json.loads(text)


def _record(status: str, call_id: str | None, name: str | None, arguments: str | None, content: str | None,
            schema: str | None) -> tuple[list[str] | None, str]:
    errors, value = None, None
    if status != "orphan":
        errors = []
        try:
            value = json.loads(arguments) if arguments is not None else None
        except ValueError:
            errors, value = ["$: not JSON"], arguments
        else:
            errors = ["unknown tool"] if schema is None else schema_errors(value, _schema(schema))
    return errors, canonical({"arguments": value, "id": call_id, "name": name, "result": content, "status": status})


def linked_tools(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One record per call or orphan result: status, level, validity, reasons and canonical JSON.

    ``schemas`` has ``name`` (unique) and ``schema`` (JSON schema as text).
    """
    tools = schemas.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("schema").alias("schema"))
    joined = link(calls, results).join(tools, "name", "left").select(
        "conv_id", "call_id", "turn", "number", "result_turn", "name", "status", "arguments", "content", "schema")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "arguments"):
            names = ("status", "call_id", "name", "arguments", "content", "schema")
            made = [_record(*row) for row in zip(*[part.column(c).to_pylist() for c in names])]
            kept = ("conv_id", "call_id", "turn", "number", "result_turn", "name", "status")
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.array([None if e is None else not e for e, _ in made], pa.bool_()),
                 pa.array([None if e is None else "; ".join(e) for e, _ in made], pa.string()), pa.array([j for _, j in made], pa.string())],
                names=[*kept, "valid", "errors", "json"])

    shape = "conv_id {0}, call_id string, turn long, number int, result_turn long, name string, status string, valid boolean, errors string, json string"
    records = joined.mapInArrow(write, shape.format(calls.schema["conv_id"].dataType.simpleString()))
    order = levels(calls).withColumn("peeled", F.lit(True))
    return records.join(order, ["conv_id", "call_id"], "left").withColumn(
        "level", F.when(F.col("peeled"), F.col("level")).when(F.col("status") != "orphan", F.lit(0))).drop("peeled")
