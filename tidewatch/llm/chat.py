"""Chat formatting with tool calls linked to their results.

Events of conversations are messages, tool calls and tool results.  Calls and results are joined by conversation
and identifier.  A call may name an earlier call whose result it needs (``after``); the chains this makes are
followed by pointer doubling (as many joins as the longest chain has binary digits), which gives every call the
latest turn and the number of the calls it rests on.  Sorting by these puts every result behind its call and
every call behind the result it needs, and leaves all else in the order of turns.  Positions are counted across
range partitions, so a conversation of any length is never in one task and never one row.

Arguments are checked against the tool's JSON schema (type, properties, required, additionalProperties, enum,
minimum, maximum, minLength, maxLength, items), and every event is written as one canonical JSON line: sorted
keys, no blanks, UTF-8 as it is.  That is done per row by a small helper.

Defined cases: of calls that repeat an identifier the earliest counts, the others stay unlinked; every result of
an identifier is linked, and the first counts as the answer; a result without a call, a call without a result and
an ``after`` without a call stay where their turn puts them (``linked`` is false for the first two); calls that
wait for each other in a circle keep their turn and are ``circular``; null or broken arguments are invalid and
written as the string they are (null: null), unknown tools are invalid; null contents are written as null; null
identifiers link with nothing; equal places are ordered by kind, identifier and content, so repeated rows are
next to each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import query, table
from tidewatch.operators.ordering import running
from tidewatch.session import stage

EVENTS = ("conv_id", "turn", "kind", "role", "content", "call_id", "after", "name", "arguments")
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


KEYWORDS = {"type", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "pattern", "items", "minItems",
            "maxItems", "properties", "required", "additionalProperties", "anyOf", "description", "title", "default"}


def check_schema(schema: dict) -> None:
    """Raise an error for a keyword that would not be looked at."""
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"schema keywords {sorted(unknown)} are not supported")
    inner = [*schema.get("properties", {}).values(), *schema.get("anyOf", ()), schema.get("items", {}),
             schema.get("additionalProperties", {})]
    for part in inner:
        if isinstance(part, dict) and part:
            check_schema(part)


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return number if kind == "number" else isinstance(value, TYPES[kind])


def fits(value, schema: dict) -> bool:
    """Whether a JSON value satisfies a schema of the ``KEYWORDS``."""
    kind = schema.get("type")
    if kind is not None and not any(_is(value, k) for k in ([kind] if isinstance(kind, str) else kind)):
        return False
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return False
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if "anyOf" in schema and not any(fits(value, s) for s in schema["anyOf"]):
        return False
    if _is(value, "number") and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return False
    if isinstance(value, str) and not (schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf)
                                       and re.search(schema.get("pattern", ""), value)):
        return False
    if isinstance(value, list):
        return (schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf)
                and all(fits(x, schema.get("items", {})) for x in value))
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        return (all(k in value for k in schema.get("required", ()))
                and (others is not False or all(k in known for k in value))
                and all(fits(v, known[k] if k in known else others if isinstance(others, dict) else {})
                        for k, v in value.items()))
    return True


def _plain(value):
    """Whole floats as integers, so that equal numbers are written alike."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def canonical(value) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _no_number(text: str):
    raise ValueError(f"{text} is not JSON")


def parsed(text: str | None, schema: dict | None) -> tuple[object, bool]:
    """(arguments, whether they are JSON that satisfies the schema); what is not JSON, what holds half a surrogate
    pair, and what is nested too deep to be written, stays the text that it is."""
    try:
        value = json.loads(text, parse_constant=_no_number)
        canonical(value).encode()
        return value, schema is not None and fits(value, schema)
    except (TypeError, ValueError, RecursionError, OverflowError):
        return text, False


def _lines(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``events`` with ``valid`` (of calls) and ``line``."""
    for schema in schemas.values():
        check_schema(schema)
    kinds = [f.dataType.simpleString() for f in events.schema]
    out = ", ".join(f"{c} {k}" for c, k in zip(events.columns, kinds)) + ", valid boolean, line string"
    columns, shared = events.columns, events.sparkSession.sparkContext.broadcast(schemas)

    def line(row: dict) -> tuple[bool | None, str]:
        if row["kind"] == "result":
            return None, canonical({"role": "tool", "tool_call_id": row["call_id"], "content": row["content"]})
        if row["kind"] != "call":
            return None, canonical({"role": row["role"], "content": row["content"]})
        arguments, valid = parsed(row["arguments"], shared.value.get(row["name"]))
        return valid, canonical({"role": "assistant", "tool_calls": [
            {"id": row["call_id"], "type": "function", "function": {"name": row["name"], "arguments": arguments}}]})

    def run(batches):
        for batch in batches:
            made = [line(r) for r in batch.select(list(EVENTS)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([v for v, _ in made], pa.bool_()), pa.array([t for _, t in made], pa.string())],
                names=[*columns, "valid", "line"])

    return events.mapInArrow(run, out)


def _chains(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, key, depth, circular) of (conv_id, call_id, turn, answered, after): the latest turn of a
    call, the calls it rests on and their answers, and their number."""
    up = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    start = calls.join(up, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", "turn", F.greatest("turn", F.coalesce("answered", "turn")).alias("upto"),
        F.when(F.col("known"), F.col("after")).alias("up"))
    # reach: what a call brings to those that rest on it; key: what it is placed by
    now = stage(start.select("conv_id", "call_id", "turn", "up", F.col("turn").alias("key"), F.col("upto").alias("reach"),
                             F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")), "chains")
    rounds, longest = 0, now.count()
    while rounds <= math.ceil(math.log2(longest + 1)) and now.filter("up IS NOT NULL").limit(1).count():
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"),
                           F.col("reach").alias("reach2"), F.col("depth").alias("depth2"))
        moved = now.filter("up IS NOT NULL").join(above, ["conv_id", "up"])
        now = stage(moved.select(
            "conv_id", "call_id", "turn", F.col("up2").alias("up"), F.greatest("key", "reach2").alias("key"),
            F.greatest("reach", "reach2").alias("reach"), (F.col("depth") + F.col("depth2")).alias("depth")).unionByName(
            now.filter("up IS NULL")), "chains")
        rounds += 1
    circular = F.col("up").isNotNull()
    return now.select("conv_id", "call_id", F.when(circular, F.col("turn")).otherwise(F.col("key")).alias("key"),
                      F.when(circular, 0).otherwise(F.col("depth")).alias("depth"), circular.alias("circular"))


def link_tools(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, position, kind, call_id, linked, circular, valid, line) of rows with the columns ``EVENTS``."""
    rows = stage(events.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *[F.col(c).cast("string") for c in EVENTS[2:]]).withColumn(
        "kind", F.when(F.col("kind").isin("call", "result"), F.col("kind")).otherwise("message")), "events")
    named = rows.filter("call_id IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    first = named.filter("kind = 'call'").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "after")).alias("f")).select("conv_id", "call_id", "f.turn", "f.after")
    answers = named.filter("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min("turn").alias("answered"))
    calls = stage(first.join(answers, ["conv_id", "call_id"], "left"), "calls")
    chains = _chains(calls).join(calls.select("conv_id", "call_id", F.col("turn").alias("_first"), "answered"),
                                 ["conv_id", "call_id"])
    tied = rows.join(chains, ["conv_id", "call_id"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    own = (call & (F.col("turn") == F.col("_first"))) | result
    sure = own & F.col("key").isNotNull()
    placed = tied.select(
        *rows.columns,
        F.when(call, F.coalesce(own & F.col("answered").isNotNull(), F.lit(False))).when(
            result, F.col("_first").isNotNull()).alias("linked"),
        F.coalesce(F.col("circular"), F.lit(False)).alias("circular"),
        F.when(sure, F.greatest("key", F.when(result, F.col("turn")))).otherwise(F.col("turn")).alias("_key"),
        F.when(sure, F.col("depth") * 2 + F.when(result, 1).otherwise(0)).otherwise(F.lit(0)).alias("_step"))
    lined = _lines(placed, schemas)
    ordered = running(lined, ["conv_id"], ["_key", "_step", "turn", "kind", "call_id", "line"], {"position": F.lit(1)},
                      name="ordered")
    return ordered.select("conv_id", "turn", "position", "kind", "call_id", "linked", "circular", "valid", "line")


REPLY = {"reply": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 300},
                                                    "turn": {"type": "integer", "minimum": 0}},
                   "required": ["text", "turn"], "additionalProperties": False}}


def as_events(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as events: what a user says is a call of ``reply`` that needs the answer to the turn
    two before, what the assistant says is the result for the turn before, all else is a message."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"

    def named(turn):
        return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))

    return conversations.select(
        "conv_id", "turn", F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"), "role",
        F.col("text").alias("content"), F.when(user, named(F.col("turn"))).when(
            assistant, named(F.col("turn") - 1)).alias("call_id"),
        F.when(user & (F.col("turn") >= 2), named(F.col("turn") - 2)).alias("after"), F.lit("reply").alias("name"),
        F.when(user, F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})).alias("arguments"))


SQL = """
WITH t AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind
    FROM conversations)
SELECT t.conv_id, t.turn, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) - 1 AS position, t.kind,
    CASE t.kind WHEN 'call' THEN t.conv_id || ':' || t.turn WHEN 'result' THEN t.conv_id || ':' || (t.turn - 1) END AS call_id,
    CASE t.kind WHEN 'call' THEN o.conv_id IS NOT NULL WHEN 'result' THEN o.conv_id IS NOT NULL END AS linked,
    FALSE AS circular, CASE t.kind WHEN 'call' THEN length(t.text) BETWEEN 1 AND 300 END AS valid,
    CASE t.kind
        WHEN 'call' THEN '{"role":"assistant","tool_calls":[{"function":{"arguments":{"text":' || to_json(t.text) ||
            ',"turn":' || t.turn || '},"name":"reply"},"id":"' || t.conv_id || ':' || t.turn || '","type":"function"}]}'
        WHEN 'result' THEN '{"content":' || to_json(t.text) || ',"role":"tool","tool_call_id":"' || t.conv_id || ':' ||
            (t.turn - 1) || '"}'
        ELSE '{"content":' || to_json(t.text) || ',"role":"' || t.role || '"}' END AS line
FROM t LEFT JOIN t o ON o.conv_id = t.conv_id AND (t.kind = 'call' AND o.kind = 'result' AND o.turn = t.turn + 1
    OR t.kind = 'result' AND o.kind = 'call' AND o.turn = t.turn - 1)
"""


@query("op8_chat", SQL)
def op8_chat(spark, folder):
    """Every turn of `conversations` as a call, a result or a message, linked, ordered, checked and written out."""
    return link_tools(as_events(table(spark, folder, "conversations", "conv_id", "turn", "role", "text")), REPLY)
