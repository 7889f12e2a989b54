"""Chat formatting: tool-call linking.

Messages are parsed to events: plain messages, tool calls (an assistant's JSON object with ``tool_calls``) and results (a
``tool`` message, a JSON object with ``tool_call_id``). Calls and results are joined by conversation and identifier.
Levels give a topological order: a call comes after the results of the calls it depends on, a result after its call, and
within a level events stand in order of their turns. Arguments are checked against the tool's schema. Every event is
serialised as canonical JSON: sorted keys, no white space, shortest numbers, one form of each string.

A conversation is never gathered: events stay rows, ordered by ``conv_id, level, turn, place``.

Defined results: of repeated call identifiers in a conversation the first by turn and place is the call, the others are
``duplicate``; so it is with results of one call; a result without a call, or before it, is an ``orphan``; a call whose
dependencies are unknown or lead in a circle is ``unordered``; null texts are empty messages; null roles are "unknown";
null conversation ids, turns or identifiers link with nothing; exact repeats of rows stay, as duplicates of the first.
In JSON a lone surrogate is U+FFFD, in names and identifiers too; a number beyond what a double holds, and not-a-number, is
null; a text whose JSON nests deeper than ``NESTING`` levels is a plain message with that text.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import Workspace
from fieldloom.llm.text_kernel import relieved

EVENT_SCHEMA = "conv_id long, turn long, place int, role string, kind string, call_id string, name string, needs array<string>, errors array<string>, json string"
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Levels of brackets to which a text is read as JSON.
NESTING = 200
_LONE = re.compile("[\ud800-\udfff]")
#: The tool that a plain conversation is seen to call in ``as_tool_turns``.
REPLY = "reply"
SCHEMAS: dict[str, dict] = {
    REPLY: {
        "type": "object",
        "required": ["prompt", "turn"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def canonical(value: object) -> str:
    """The one JSON text of a value: sorted keys, no spaces, integral floats as integers; not-a-number is refused."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53:
            return int(x)
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value: object, schema: Mapping, at: str = "$") -> list[str]:
    """What ``value`` breaks of a schema: types, required and additional properties, items, enumerations, and ranges."""
    out: list[str] = []
    if kind := schema.get("type"):
        kinds = kind if isinstance(kind, list) else [kind]
        fits = any(isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds)
        if not fits and not ("integer" in kinds and isinstance(value, float) and value.is_integer()):
            return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not among the allowed values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                out += violations(value[k], known[k], f"{at}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{at}: out of range")
    return out


def _double(text: str) -> float | None:
    found = float(text)
    return found if math.isfinite(found) else None


def _nests(text: str) -> bool:
    """Whether brackets outside strings nest deeper than ``NESTING`` levels."""
    depth = 0
    for m in _BRACKETS.finditer(text):
        depth += m[0] in "{["
        depth -= m[0] in "}]"
        if depth > NESTING:
            return True
    return False


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[\[\]{}]', re.S)


def _valid(value: object) -> object:
    """The value without lone surrogates."""
    if isinstance(value, str):
        return _LONE.sub("\ufffd", value)
    if isinstance(value, dict):
        return {_valid(k): _valid(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_valid(v) for v in value]
    return value


def _object(text: str) -> dict | None:
    if text[:1] != "{" or _nests(text):
        return None
    try:
        found = json.loads(text, parse_constant=lambda _: None, parse_float=_double)
    except (ValueError, RecursionError):
        return None
    return _valid(found) if isinstance(found, dict) else None


def parse(turn: int | None, role: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> list[tuple]:
    """Events of a message: place, kind, call id, name, needs, errors, JSON."""
    role, text = role or "unknown", text or ""
    held = _object(text.strip())
    calls = held.get("tool_calls") if held and role == "assistant" else None
    if isinstance(calls, list) and calls:
        out = []
        for place, call in enumerate(x if isinstance(x, dict) else {} for x in calls):
            name, arguments, errors = call.get("name"), call.get("arguments", {}), []
            if isinstance(arguments, str):
                arguments = _object(arguments)
            if not isinstance(call.get("id"), str) or not call["id"]:
                errors.append("$.id: missing")
            if not isinstance(arguments, dict):
                errors.append("$.arguments: not an object")
            elif name not in schemas:
                errors.append("$.name: unknown tool")
            else:
                errors += violations(arguments, schemas[name])
            needs = sorted({x for x in call.get("depends_on") or [] if isinstance(x, str)}) if isinstance(call.get("depends_on"), list) else []
            body = {"arguments": arguments, "depends_on": needs, "id": call.get("id"), "name": name, "role": role, "type": "call"}
            out.append((place, "call", call["id"] if isinstance(call.get("id"), str) and call["id"] else None, name if isinstance(name, str) else None, needs, errors, canonical(body)))
        return out
    if held is not None and role == "tool":
        call_id = held.get("tool_call_id")
        call_id = call_id if isinstance(call_id, str) and call_id else None
        body = {"content": held.get("content"), "id": call_id, "role": role, "type": "result"}
        return [(0, "result", call_id, None, [], [] if call_id else ["$.tool_call_id: missing"], canonical(body))]
    return [(0, "message", None, None, [], [], canonical({"content": text, "role": role, "type": "message"}))]


def events(messages: DataFrame, schemas: Mapping[str, Mapping] = SCHEMAS) -> DataFrame:
    """The events of each row of ``messages(conv_id, turn, role, text)``."""
    names = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(conv, turn, place, role or "unknown", *rest) for place, *rest in parse(turn, role, text, schemas)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(relieved(run), EVENT_SCHEMA)


def as_tool_turns(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool use: a user's turn calls the tool ``reply`` with its text, the assistant's next turn is
    the result, and each call depends on the one two turns before. Messages that already are tool use, and system
    messages, stay as they are."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")

    def name(t):
        return F.concat(F.lit("t"), t.cast("string"))

    own = F.substring(F.ltrim(text), 1, 1) == "{"
    call = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    name(turn).alias("id"),
                    F.lit(REPLY).alias("name"),
                    F.struct(text.alias("prompt"), turn.cast("long").alias("turn")).alias("arguments"),
                    F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
                )
            ).alias("tool_calls")
        )
    )
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), text.alias("content")))
    user, assistant = (F.col("role") == "user") & turn.isNotNull() & ~own, (F.col("role") == "assistant") & turn.isNotNull() & ~own
    return conversations.select(
        "conv_id", "turn", F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"), F.when(user, call).when(assistant, result).otherwise(text).alias("text")
    )


def link(messages: DataFrame, schemas: Mapping[str, Mapping] = SCHEMAS) -> DataFrame:
    """``conv_id, turn, place, role, kind, call_id, name, level, status, linked_turn, errors, json`` of every event."""
    work = Workspace(messages.sparkSession, "chat")
    every = work.keep(events(messages, schemas).withColumn("row", F.monotonically_increasing_id()), "events")
    # the first of each identifier, by an aggregation: no task gathers the events of one that repeats very often
    named = every.where("kind <> 'message' and conv_id is not null and call_id is not null and turn is not null").select("row", "conv_id", "kind", "call_id", "turn", "place", "needs", "json")
    first = named.groupBy("conv_id", "kind", "call_id").agg(F.min(F.struct("turn", "place", "json", "row")).alias("first"))
    named = named.join(first.select(F.col("first.row").alias("row"), F.lit(1).alias("nth")), "row", "left").select("row", "conv_id", "kind", "call_id", "turn", "needs", F.coalesce("nth", F.lit(2)).alias("nth"))
    calls = named.where("kind = 'call' and nth = 1").select("conv_id", "call_id", F.col("turn").alias("call_turn"), F.col("row").alias("call_row"), "needs")
    results = named.where("kind = 'result' and nth = 1").select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.col("row").alias("result_row"))
    linked = results.join(calls, ["conv_id", "call_id"]).where("result_turn > call_turn").select("call_row", "result_row", "call_turn", "result_turn")
    linked = work.keep(linked, "linked")

    levels = work.keep(_levels(calls, work), "levels")
    of_call = levels.join(linked.select("call_row", "result_turn"), "call_row", "left").select(F.col("call_row").alias("row"), "level", F.col("result_turn").alias("linked_turn"))
    of_result = linked.join(levels, "call_row", "left").select(F.col("result_row").alias("row"), (F.col("level") + 1).alias("level"), F.col("call_turn").alias("linked_turn"))
    placed = of_call.withColumn("is_call", F.lit(True)).union(of_result.withColumn("is_call", F.lit(False)))
    again = named.where("nth > 1").select("row", F.lit(True).alias("again"))
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("again"), "duplicate")
        .when((F.col("kind") == "result") & F.col("is_call").isNull(), "orphan")
        .when(F.col("kind") == "result", "linked")
        .when(F.col("call_id").isNull() | F.col("is_call").isNull(), "invalid")
        .when(F.col("level").isNull(), "unordered")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("linked_turn").isNotNull(), "linked")
        .otherwise("open")
    )
    return (
        every.join(placed, "row", "left")
        .join(again, "row", "left")
        .select("conv_id", "turn", "place", "role", "kind", "call_id", "name", F.when(F.col("kind") == "message", F.lit(0)).otherwise(F.col("level")).cast("int").alias("level"), status.alias("status"), "linked_turn", "errors", "json")
    )


def _levels(calls: DataFrame, work: Workspace) -> DataFrame:
    """``call_row, level`` of every call: 0 without dependencies, else two more than the highest of them; null in circles.

    Calls with one dependency form chains, which may be as long as a conversation: pointers along them double their reach
    each round, to the chain's anchor (a call with none or several). The anchors' own levels take a round for each
    call with several dependencies on the longest way, and end when a round places none.
    """
    needs = calls.select("conv_id", "call_row", F.size("needs").alias("n"), F.explode_outer("needs").alias("call_id"))
    edges = needs.join(calls.select("conv_id", "call_id", F.col("call_row").alias("need_row")), ["conv_id", "call_id"], "left")
    edges = work.keep(edges.select("call_row", "n", "need_row"), "needs")
    singles = edges.where("n = 1 and need_row is not null").select("call_row", F.col("need_row").alias("to_row"), F.lit(1).cast("long").alias("steps"))
    jump = work.keep(singles, "jump-0")
    for k in range(max(1, jump.count()).bit_length() + 1):
        on = jump.select(F.col("call_row").alias("to_row"), F.col("to_row").alias("__to"), F.col("steps").alias("__steps"))
        moved = jump.join(on, "to_row", "left")
        jump = work.keep(
            moved.select("call_row", F.coalesce("__to", "to_row").alias("to_row"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__to").isNotNull().alias("moved")), f"jump-{k + 1}"
        )
        if not jump.where("moved").limit(1).count():
            break
    # pointers that still move are in circles or lead to one
    anchored = jump.where("not moved").select("call_row", "to_row", "steps")
    known = work.keep(edges.where("n <> 1").groupBy("call_row").agg(F.when(F.max("n") == 0, 0).cast("long").alias("level")), "levels-0")
    several = edges.where("n > 1").select("call_row", "need_row").join(anchored.withColumnsRenamed({"call_row": "need_row"}), "need_row", "left")
    several = work.keep(several.select("call_row", F.coalesce("to_row", "need_row").alias("need_row"), F.coalesce("steps", F.lit(0)).alias("steps")), "several")
    waiting = several.select("call_row").distinct().count()
    k = 0
    while waiting:
        level = known.select(F.col("call_row").alias("need_row"), F.col("level").alias("need_level"))
        ready = several.join(level, "need_row", "left").groupBy("call_row").agg(F.max(F.col("need_level") + 2 * F.col("steps")).alias("high"), F.count_if(F.col("need_level").isNull()).alias("open"))
        ready = ready.where("open = 0").select("call_row", (F.col("high") + 2).alias("found"))
        known = work.keep(known.join(ready, "call_row", "left").select("call_row", F.coalesce("level", "found").alias("level")), f"levels-{k + 1}")
        work.drop(f"levels-{k}")
        before, waiting, k = waiting, known.where("level is null").count(), k + 1
        if waiting == before:
            break
    chained = anchored.join(known.select(F.col("call_row").alias("to_row"), "level"), "to_row", "left").select("call_row", (F.col("level") + 2 * F.col("steps")).alias("level"))
    return calls.select("call_row").join(known.unionByName(chained), "call_row", "left")


def link_conversations(conversations: DataFrame) -> DataFrame:
    return link(as_tool_turns(conversations))
