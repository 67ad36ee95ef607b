"""Tool calls of conversations: linked with their results, ordered, validated and serialised.

Calls and results meet in a hash join on conversation and identifier. A call may wait for another one
(``after``); its level is the number of calls in front of it, found by doubling pointers, so that a chain
of n calls takes log(n) joins and no conversation has to fit in one task. Arguments are checked against the
tool's schema, and each call becomes one line of canonical JSON together with its result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertline.llm.text import n_words
from alertline.session import stored

KINDS = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,)}

OUTPUT = (
    "conv_id long, call_id string, turn long, result_turn long, status string, level long, valid boolean, "
    "problems array<string>, message string"
)
FIELDS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("call_id", pa.string()),
        ("turn", pa.int64()),
        ("result_turn", pa.int64()),
        ("status", pa.string()),
        ("level", pa.int64()),
        ("valid", pa.bool_()),
        ("problems", pa.list_(pa.string())),
        ("message", pa.string()),
    ]
)

# Schemas of the tools that calls_of_turns makes calls to.
SCHEMAS = {
    "search": {
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 40},
        },
        "required": ["query", "limit"],
    },
    "measure": {
        "properties": {
            "text": {"type": "string"},
            "words": {"type": "integer", "minimum": 0},
            "share": {"type": "number", "maximum": 1},
        },
        "required": ["words"],
    },
}


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, text as it is, and whole floats as integers; no NaN or infinity."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and math.isfinite(value) and value == int(value):
        return int(value)
    return value


def problems(arguments: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """The parsed arguments and what is wrong with them, in a fixed order.

    Text that is no JSON, or that holds what UTF-8 cannot (a lone surrogate), is "not JSON". ``properties``,
    ``required``, ``items``, ``enum`` and the bounds are checked at every depth; a schema without ``type``, or
    with a list of types, allows any, or any of these.
    """
    if schema is None:
        return None, ["unknown tool"]
    try:
        value = _plain(json.loads(arguments or ""))
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None, ["not JSON"]
    if not isinstance(value, dict):
        return value, ["not an object"]
    return value, list(_faults(value, schema, ""))


def _is(value: object, kind: str) -> bool:
    if kind == "null":
        return value is None
    return isinstance(value, KINDS[kind]) and (kind == "boolean" or not isinstance(value, bool))


def _faults(value: object, rule: dict, path: str) -> Iterator[str]:
    """What is wrong with a value; ``path`` names it (empty for the arguments themselves)."""
    kinds = rule.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if path and kinds and not any(_is(value, kind) for kind in kinds):
        yield f"{path} is not {' or '.join(kinds)}"
        return
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if "enum" in rule and not any(value == x and type(value) is type(x) for x in _plain(rule["enum"])):
        yield f"{path} is not allowed"
    elif number and ("minimum" in rule and value < rule["minimum"] or "maximum" in rule and value > rule["maximum"]):
        yield f"{path} is out of range"
    elif isinstance(value, str) and "minLength" in rule and len(value) < rule["minLength"]:
        yield f"{path} is too short"
    dot = f"{path}." if path else ""
    if isinstance(value, dict) and (not path or "properties" in rule or "required" in rule):
        yield from (f"missing {dot}{key}" for key in rule.get("required", ()) if key not in value)
        known = rule.get("properties", {})
        for key in sorted(value):
            if key in known:
                yield from _faults(value[key], known[key], f"{dot}{key}")
            elif known or not path:
                yield f"unknown {dot}{key}"
    if isinstance(value, list) and "items" in rule:
        for k, x in enumerate(value):
            yield from _faults(x, rule["items"], f"{path}[{k}]")


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand for the turns of conversations (conv_id, turn, role, text).

    Each user turn calls a tool with its whole text and its number of words: "search", or "measure" in every
    third turn; it waits for the call of the user turn two turns earlier. Each assistant turn is the result for
    the call of the turn before it. Null ids, turns and texts go through as nulls; arguments leave a null text
    and the share of no words out. Turns with other roles are for ``other_turns``.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")

    def name(t: Column) -> Column:
        return F.concat(F.lit("call_"), conv.cast("string"), F.lit("_"), t.cast("string"))

    text = F.col("text").cast("string")
    n = n_words(text)
    search = F.to_json(F.struct(text.alias("query"), n.cast("int").alias("limit")))
    share = F.when(n > 0, 1 / n.cast("double")).alias("share")
    measure = F.to_json(F.struct(text.alias("text"), n.alias("words"), share))
    third = F.pmod(turn, F.lit(3)) == 0
    calls = turns.filter("role = 'user'").select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        name(turn).alias("call_id"),
        F.when(third, "measure").otherwise("search").alias("tool"),
        F.when(third, measure).otherwise(search).alias("arguments"),
        F.when(turn >= 2, name(turn - 2)).alias("after"),
    )
    results = turns.filter("role = 'assistant'").select(
        conv.alias("conv_id"), turn.alias("turn"), name(turn - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def other_turns(turns: DataFrame) -> DataFrame:
    """A row for each turn that is neither the user's nor the assistant's, with the columns of ``link_calls``.

    A null role is such a role too. The status is "message"; ``message`` holds role, turn and the whole text,
    and nothing is linked, ordered or validated: call_id, result_turn and level are null, valid is false.
    """
    user_or_assistant = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    rows = turns.filter(~user_or_assistant).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(_serialise_others, OUTPUT)


def _serialise_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            out = []
            for r in batch.slice(k, 2000).to_pylist():
                message = {"role": r["role"], "status": "message", "text": r["text"], "turn": r["turn"]}
                none = {"call_id": None, "result_turn": None, "level": None, "valid": False, "problems": []}
                kept = {"conv_id": r["conv_id"], "turn": r["turn"], "status": "message"}
                out.append(kept | none | {"message": canonical(message)})
            yield pa.RecordBatch.from_pylist(out, FIELDS)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Link calls with results: one row for each call, and one for each result without a call.

    ``calls`` has conv_id, turn, call_id, tool, arguments (JSON) and after (a call_id or null); ``results``
    conv_id, turn, call_id and content. Returned: conv_id, call_id, turn, ``result_turn``, ``status``,
    ``level``, ``valid``, ``problems`` and ``message`` (canonical JSON).

    Of calls with the same identifier in a conversation the one with the smallest turn counts (of several in
    that turn, the one with the smallest tool and arguments); the others have the status "duplicate". So it is with
    results, by content; further results are "duplicate result" rows. Other statuses are "linked",
    "unanswered" (no result), "early result" (its turn is before the call's) and "orphan result" (no
    call). Rows without a conversation or identifier link with nothing.

    ``level`` is the number of calls that must come before; ascending (level, turn, call_id) is a
    topological order of a conversation. A call that waits for an unknown one has level 0 and a problem; one in
    or behind a circle has none and a problem. Levels are null for duplicates and results. Empty tables give
    empty results. Columns other than these are ignored.
    """
    schemas = SCHEMAS if schemas is None else schemas
    calls = _numbered(
        calls.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.col("call_id").cast("string").alias("call_id"),
            F.col("tool").cast("string").alias("tool"),
            F.col("arguments").cast("string").alias("arguments"),
            F.col("after").cast("string").alias("after"),
        ),
        ["turn", "tool", "arguments"],
        "calls",
    )
    results = _numbered(
        results.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.col("call_id").cast("string").alias("call_id"),
            F.col("content").cast("string").alias("content"),
        ),
        ["turn", "content"],
        "results",
    )
    levels = _levels(calls.filter("_first").select("conv_id", "call_id", "after"))
    first = calls.filter("_first").join(levels, ["conv_id", "call_id"], "left")
    answers = results.filter("_first").select(
        "conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("_answered")
    )
    linked = first.join(answers, ["conv_id", "call_id"], "full_outer")
    status = (
        F.when(F.col("_first").isNull(), "orphan result")
        .when(F.col("_answered").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early result")
        .otherwise("linked")
    )
    columns = ("conv_id", "call_id", "turn", "result_turn", "tool", "arguments", "after", "content")
    linked = linked.select(*columns, "level", "_order_problem", status.alias("status"))
    none = F.lit(None)
    rest = calls.filter("NOT _first").select(
        "conv_id", "call_id", "turn", none.cast("long").alias("result_turn"), "tool", "arguments", "after",
        none.cast("string").alias("content"), none.cast("long").alias("level"),
        none.cast("string").alias("_order_problem"),
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unanswered").otherwise("duplicate").alias("status"),
    )
    more = results.filter("NOT _first").select(
        "conv_id", "call_id", none.cast("long").alias("turn"), F.col("turn").alias("result_turn"),
        *(none.cast("string").alias(c) for c in ("tool", "arguments", "after")), "content",
        none.cast("long").alias("level"), none.cast("string").alias("_order_problem"),
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "orphan result")
        .otherwise("duplicate result").alias("status"),
    )
    every = linked.unionByName(rest).unionByName(more)
    return every.mapInArrow(_serialiser(schemas), OUTPUT)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Mark the first row of each identifier (``_first``), by an order and a number given once.

    Rows without an identifier are never first. The smallest is combined before the shuffle, so an
    identifier may have any number of rows.
    """
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), name)
    ranked = F.struct(*(F.xxhash64(c) if c in ("arguments", "content") else F.col(c) for c in order), F.col("_row"))
    named = rows.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    least = named.groupBy("conv_id", "call_id").agg(F.min(ranked).getField("_row").alias("_row"))
    least = least.withColumn("_first", F.lit(True))
    out = rows.join(least, ["conv_id", "call_id", "_row"], "left")
    return out.withColumn("_first", F.coalesce("_first", F.lit(False))).drop("_row")


def _levels(calls: DataFrame) -> DataFrame:
    """How many calls are in front of each, by pointer doubling: conv_id, call_id, level, _order_problem."""
    calls = stored(calls, "order")
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("_known"))
    nodes = calls.join(known, ["conv_id", "after"], "left")
    nodes = nodes.select(
        "conv_id",
        "call_id",
        F.when(F.col("_known"), F.col("after")).alias("next"),
        F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("level"),
        (F.col("after").isNotNull() & F.col("_known").isNull()).alias("_lost"),
    )
    nodes = stored(nodes, "order")
    waiting = nodes.filter("next IS NOT NULL").count()
    rounds = math.ceil(math.log2(waiting + 1)) + 1 if waiting else 0
    for _ in range(rounds):
        ahead = nodes.select(
            "conv_id", F.col("call_id").alias("next"), F.col("next").alias("_next"), F.col("level").alias("_level")
        )
        jumped = nodes.join(ahead, ["conv_id", "next"], "left")
        nodes = stored(
            jumped.select(
                "conv_id",
                "call_id",
                F.col("_next").alias("next"),
                (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"),
                "_lost",
            ),
            "order",
        )
        if not nodes.filter("next IS NOT NULL").limit(1).count():
            break
    circle = F.col("next").isNotNull()
    return nodes.select(
        "conv_id",
        "call_id",
        F.when(~circle, F.col("level")).alias("level"),
        F.when(circle, "waits in a circle").when(F.col("_lost"), "waits for an unknown call").alias("_order_problem"),
    )


def _serialiser(schemas: dict[str, dict]):
    def row(r: dict) -> dict:
        is_call = r["status"] not in ("orphan result", "duplicate result")
        arguments, found = problems(r["arguments"], schemas.get(r["tool"])) if is_call else (None, [])
        if r["_order_problem"]:
            found.append(r["_order_problem"])
        message: dict = {"id": r["call_id"], "status": r["status"]}
        if is_call:
            shown = arguments if arguments is not None else r["arguments"]
            message["call"] = {"name": r["tool"], "arguments": shown}
            if r["after"] is not None:
                message["call"]["after"] = r["after"]
        if r["result_turn"] is not None or r["content"] is not None:
            message["result"] = {"content": r["content"], "turn": r["result_turn"]}
        out = {k: r[k] for k in ("conv_id", "call_id", "turn", "result_turn", "status", "level")}
        return out | {"valid": is_call and not found, "problems": found, "message": canonical(message)}

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                yield pa.RecordBatch.from_pylist([row(r) for r in batch.slice(k, 2000).to_pylist()], FIELDS)

    return serialise
