"""Repair the role structure of conversations by their cheapest edits: a square-root checkpointed DP.

A well-formed conversation is empty, or an optional system turn and then pairs of a user's and an assistant's
turn. While a conversation is read it is in one of four states: nothing yet (0), after the system turn (1),
after a user's (2), after an assistant's (3). The vector of a place holds, for each state, the least cost of
the rest from there. Vectors are worked out from the back and kept at every sqrt(n)-th row only; a block
between two of them is worked out again when the walk from the front enters it. The walk takes, of the edits
that lose no cost, the one whose initial comes first in ASCII: D (delete), I (insert), K (keep), R (rerole).
As the next role of a state is one only, these initials name the repaired conversation.

Conversations of any length are cut: rows lie in ranges of (conv_id, turn), and a record holds at most
``BLOCK_ROWS`` rows of one conversation. Nearly all conversations are one record, which is repaired where it
lies. Of the others each record gives a 4 x 4 matrix of costs from state to state, these give the vectors at
the ends of records from the back, and those the states at their beginnings from the front; then each record
is walked by itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertline.session import stored

BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20

#: Fixed values of the rules: costs, sentence ends, pairs of neighbouring roles, white space.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"

NEVER = 1 << 60
DONE = (0, 2 * INSERT, INSERT, 0)  # what is left to pay after the last row: open pairs are closed by inserts
NEXT = (2, 2, 3, 2)  # the state that an inserted or reroled turn leads to
ROLE_OF = {2: "user", 3: "assistant"}
CLASSES = {"s": 1, "u": 2, "a": 3}
DEAD, TRUNCATED = 4, 8  # flags of a row's code, beside the class of its role

Vector = tuple[int, int, int, int]

_LINES = "lines array<struct<role: string, text: string>>"
_KEY = "conv_id long, part long, block long"
BLOCKS = f"{_KEY}, open boolean, turns array<long>, roles string, faults array<long>, codes binary, keys array<binary>, {_LINES}"
WALKED = f"{_KEY}, turns array<long>, roles string, faults array<long>, cost long, audit string, {_LINES}"
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def keeps(kind: int, state: int) -> int:
    """The state after a kept row of a class of role, or 0 where it cannot stand."""
    if kind == 1:
        return 1 if state == 0 else 0
    if kind == 2:
        return 2 if state != 2 else 0
    return 3 if kind == 3 and state == 2 else 0


def step_back(after: Vector, code: int) -> Vector:
    """The vector in front of a row, from the one behind it."""
    if code & DEAD:
        b0, b1, b2, b3 = (DELETE + v for v in after)
    else:
        extra = CUT_OFF if code & TRUNCATED else 0
        best = []
        for state in range(4):
            cost = min(DELETE + after[state], REROLE + extra + after[NEXT[state]])
            kept = keeps(code & 3, state)
            best.append(min(cost, extra + after[kept]) if kept else cost)
        b0, b1, b2, b3 = best
    two, three = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + two), min(b1, INSERT + two), two, three


def vector_before(codes: bytes, after: Vector) -> Vector:
    for code in reversed(codes):
        after = step_back(after, code)
    return after


def matrix(codes: bytes) -> list[list[int]]:
    """Least costs from each state in front of some rows to each state behind them."""
    columns = [vector_before(codes, tuple(0 if s == t else NEVER for s in range(4))) for t in range(4)]
    return [[columns[t][s] for t in range(4)] for s in range(4)]


def walk(codes: bytes, after: Vector, state: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """The edits of some rows as (initial, row, state after it), given the vector behind them.

    ``last`` says that no rows follow, so that open pairs are closed at the end.
    """
    n = len(codes)
    step = max(1, math.isqrt(n))
    checkpoints = {n: after}
    vector = after
    for i in range(n - 1, -1, -1):
        vector = step_back(vector, codes[i])
        if i % step == 0:
            checkpoints[i] = vector
    for first in range(0, n, step):
        end = min(first + step, n)
        vectors = [checkpoints[end]]
        for i in range(end - 1, first - 1, -1):
            vectors.append(step_back(vectors[-1], codes[i]))
        vectors.reverse()
        for i in range(first, end):
            here, behind, code = vectors[i - first], vectors[i - first + 1], codes[i]
            extra = CUT_OFF if code & TRUNCATED else 0
            while True:
                cost = here[state]
                kept = 0 if code & DEAD else keeps(code & 3, state)
                if DELETE + behind[state] == cost:
                    yield "D", i, state
                    break
                if INSERT + here[NEXT[state]] == cost:
                    state = NEXT[state]
                    yield "I", i, state
                    continue
                if kept and extra + behind[kept] == cost:
                    state = kept
                    yield "K", i, state
                    break
                state = NEXT[state]
                yield "R", i, state
                break
    while last and DONE[state]:
        state = NEXT[state]
        yield "I", n, state


def _key_of(role: str, text: str) -> bytes:
    digest = hashlib.blake2b(str(len(role)).encode() + b":" + role.encode() + text.encode(), digest_size=16)
    return digest.digest()


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int, block_bytes: int) -> Iterator[dict]:
    """Records of sorted rows: the first and last conversation of a task, and cut ones, are open."""
    part, block = TaskContext.get().partitionId(), 0
    held: dict | None = None  # the record before, not yet known to be closed
    first_id, seen, size = None, set(), 0

    def new(conv_id: int | None) -> dict:
        return {"conv_id": conv_id, "part": part, "block": block, "open": False, "turns": [], "roles": "",
                "faults": [0, 0, 0, 0], "codes": bytearray(), "keys": [], "lines": []}

    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in range(4))
        for conv_id, turn, role, text in zip(*columns, strict=True):
            if held is None or held["conv_id"] != conv_id:
                if held is None:
                    first_id = (conv_id,)
                else:
                    held["open"] = held["open"] or (held["conv_id"],) == first_id
                    yield held
                    block += 1
                held, seen, size = new(conv_id), set(), 0
            elif len(held["codes"]) >= block_rows or size + len(text) > block_bytes:
                held["open"] = True
                yield held
                block += 1
                held, seen, size = new(conv_id), set(), 0
                held["open"] = True
            size += len(text)
            ending = text.rstrip(SPACE)
            code = CLASSES.get(role[:1], 0)
            faults = held["faults"]
            if not ending:
                code |= DEAD
                faults[0] += 1
            elif (role, text) in seen:
                code |= DEAD
                faults[1] += 1
            else:
                seen.add((role, text))
                if ending[-1] not in ENDS:
                    code |= TRUNCATED
                    faults[2] += 1
            initial = role[:1]
            if held["codes"]:
                faults[3] += held["last"] + initial not in LEGAL
            else:
                held["first"] = initial
            held["last"] = initial
            held["codes"].append(code)
            held["keys"].append(None if not ending else _key_of(role, text))
            held["turns"].append(turn)
            held["lines"].append({"role": role, "text": text})
    if held is not None:
        held["open"] = True
        yield held


def _turn_facts(turns: list[int | None]) -> list[int]:
    """Smallest, greatest and number of distinct turns that are not null; nothing where all are."""
    known = [t for t in turns if t is not None]
    return [known[0], known[-1], 1 + sum(a != b for a, b in zip(known, known[1:]))] if known else []


def _pack(block_rows: int, block_bytes: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for record in _blocks(batches, block_rows, block_bytes):
            record["roles"] = f"{record.pop('first'):1.1}{record.pop('last'):1.1}"
            record["turns"] = _turn_facts(record["turns"])
            record["codes"] = bytes(record["codes"])
            if not record["open"]:
                record["keys"] = None
            rows.append(record)
            size += len(record["codes"])
            if size >= block_rows:
                yield _batch(rows, BLOCKS)
                rows, size = [], 0
        if rows:
            yield _batch(rows, BLOCKS)

    return pack


def _batch(rows: list[dict], kinds: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_arrow(kinds))


def _arrow(kinds: str) -> pa.Schema:
    """Arrow types of the column lists in this module."""
    simple = {
        "long": pa.int64(),
        "string": pa.string(),
        "binary": pa.binary(),
        "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()),
        "array<binary>": pa.list_(pa.binary()),
    }
    lines = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    fields = []
    for part in kinds.replace(_LINES, "lines -").split(", "):
        name, kind = part.split(" ")
        fields.append(pa.field(name, lines if kind == "-" else simple[kind]))
    return pa.schema(fields)


def _edited(record: dict, after: Vector, state: int, last: bool) -> dict:
    """A record with its edits made."""
    audit, lines, cost = [], [], 0
    for edit, i, then in walk(record["codes"], after, state, last):
        audit.append(edit)
        if edit == "D":
            cost += DELETE
            continue
        line = record["lines"][i] if edit in "KR" else {"role": None, "text": ""}
        cost += {"K": 0, "R": REROLE, "I": INSERT}[edit]
        if edit != "I" and record["codes"][i] & TRUNCATED:
            cost += CUT_OFF
        lines.append(line if edit == "K" else {"role": ROLE_OF[then], "text": line["text"]})
    kept = {k: record[k] for k in ("conv_id", "part", "block", "turns", "roles", "faults")}
    return kept | {"cost": cost, "audit": "".join(audit), "lines": lines}


def _walk_closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_edited(record, DONE, 0, True) for record in batch.to_pylist()], WALKED)


def _walk_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_edited(r, tuple(r["after"]), r["state"], r["last"]) for r in batch.to_pylist()]
        yield _batch(rows, WALKED)


def _with_late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark rows that an earlier record of the conversation has as well, and add the cost matrix."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            late, codes, faults = set(r.pop("late") or ()), bytearray(r["codes"]), list(r["faults"])
            for i, key in enumerate(r.pop("keys")):
                if key in late and not codes[i] & DEAD:
                    faults[1] += 1
                    faults[2] -= bool(codes[i] & TRUNCATED)
                    codes[i] = codes[i] & 3 | DEAD
            flat = [cost for row in matrix(bytes(codes)) for cost in row]
            rows.append(r | {"codes": bytes(codes), "faults": faults, "matrix": flat})
        yield _batch(rows, OPEN)


OPEN = f"{_KEY}, turns array<long>, roles string, faults array<long>, codes binary, {_LINES}, matrix array<long>"
_ENDS = f"{_KEY}, after array<long>, last boolean"
_STATES = f"{_KEY}, state long"


def _vectors(table: pa.Table) -> pa.Table:
    """From the back: the vector behind each record of one conversation."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]), reverse=True)
    after, out = DONE, []
    for k, r in enumerate(rows):
        out.append({"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "after": list(after), "last": k == 0})
        m = r["matrix"]
        after = tuple(min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4))
    return pa.Table.from_pylist(out, schema=_arrow(_ENDS))


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each record: the state behind it for each state in front."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            ends = []
            for state in range(4):
                end = state
                for _, _, end in walk(r["codes"], tuple(r["after"]), state, False):
                    pass
                ends.append(end)
            rows.append({"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "ends": ends})
        yield _batch(rows, f"{_KEY}, ends array<long>")


def _states(table: pa.Table) -> pa.Table:
    """From the front: the state at the beginning of each record of one conversation."""
    state, out = 0, []
    for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"])):
        out.append({"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "state": state})
        state = r["ends"][state]
    return pa.Table.from_pylist(out, schema=_arrow(_STATES))


def _on_record(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the number of a record, which is its own whatever the conversation."""
    return left.join(right.drop("conv_id"), ["part", "block"], how)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find the faults of conversations and their cheapest repair.

    Reads ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored. Rows of a conversation are
    taken by turn, nulls first; rows of one turn by role and then by xxhash64 of the text, equal rows one after
    the other. A null role or text is one space. Rows without a conv_id are one conversation. A role's class
    is its first character (s, u or a); rows of other roles, or with an empty one, cannot be kept as they are.

    Returns records of conversations, in the order of (part, block) within one: ``turns`` (smallest, greatest,
    number of distinct ones, or empty), ``roles`` (first and last initial), ``faults`` (blank, duplicate,
    truncated, illegal pairs within the record), ``cost``, ``audit`` (initials of the edits), ``lines``
    (role and text of the repaired turns) and ``whole`` (the record is known to be all of its conversation). A very long conversation takes many records; no task holds more
    than a few of them. An empty table has none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    named = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.xxhash64(text).alias("_hash"),
        F.rand(11).alias("_salt"),  # equal rows may fill several ranges
    )
    order = ("conv_id", "turn", "role", "_hash", "_salt")
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    blocks = stored(ordered.mapInArrow(_pack(block_rows, block_bytes), BLOCKS), "conversations")
    record = ("conv_id", "part", "block", "turns", "roles", "faults", "codes", "lines")
    closed = blocks.filter("NOT open").select(*record).mapInArrow(_walk_closed, WALKED)

    cut = blocks.filter("open")
    keys = cut.select("conv_id", "part", "block", F.explode(F.array_distinct("keys")).alias("key")).filter("key IS NOT NULL")
    place = F.struct("part", "block")
    first = keys.groupBy(F.col("conv_id").alias("_conv_id"), F.col("key").alias("_key"))
    first = first.agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = keys.join(first, F.expr("key = _key AND conv_id <=> _conv_id")).filter(F.col("first") < place)
    late = late.groupBy("part", "block").agg(F.collect_list("key").alias("late"))
    opened = cut.join(late, ["part", "block"], "left").select(*record, "keys", "late")
    opened = stored(opened.mapInArrow(_with_late, OPEN), "open")
    heads = opened.select("conv_id", "part", "block", "matrix")
    ends = stored(heads.groupBy("conv_id").applyInArrow(_vectors, _ENDS), "ends")
    maps = _on_record(opened.select("conv_id", "part", "block", "codes"), ends).select("conv_id", "part", "block", "codes", "after")
    states = maps.mapInArrow(_maps, f"{_KEY}, ends array<long>").groupBy("conv_id").applyInArrow(_states, _STATES)
    ready = _on_record(_on_record(opened, ends), states).select(*record, "after", "last", "state")
    opened = ready.mapInArrow(_walk_open, WALKED)
    return closed.withColumn("whole", F.lit(True)).unionByName(opened.withColumn("whole", F.lit(False)))


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The turns of repaired conversations: conv_id, part, block and position (their order), role, text."""
    lines = repaired.select("conv_id", "part", "block", F.posexplode("lines").alias("position", "line"))
    return lines.select("conv_id", "part", "block", "position", "line.role", "line.text")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the records of each conversation, which lie one after the other."""
    open_one: dict | None = None
    digest, audit = hashlib.sha256(), []

    def closed(c: dict) -> dict:
        low, high, distinct = c["turns"] or (0, 0, 1)
        names = ("blank", "duplicate", "truncated", "illegal")
        return {
            "conv_id": c["conv_id"],
            "gaps": high - low + 1 - distinct,
            **dict(zip(names, c["faults"])),
            "cost": c["cost"],
            "audit": "".join(audit),
            "repaired_sha256": digest.hexdigest(),
        }

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if open_one is None or open_one["conv_id"] != r["conv_id"]:
                if open_one is not None:
                    out.append(closed(open_one))
                open_one, digest, audit, gap = r, hashlib.sha256(), [], b""
            else:
                c = open_one
                c["faults"] = [a + b for a, b in zip(c["faults"], r["faults"])]
                c["faults"][3] += c["roles"][1] + r["roles"][0] not in LEGAL
                c["roles"], c["cost"] = r["roles"], c["cost"] + r["cost"]
                if c["turns"] and r["turns"]:
                    both = c["turns"][2] + r["turns"][2] - (c["turns"][1] == r["turns"][0])
                    c["turns"] = [c["turns"][0], r["turns"][1], both]
                else:
                    c["turns"] = c["turns"] or r["turns"]
            audit.append(r["audit"])
            for line in r["lines"]:
                digest.update(gap + f"{line['role']}:{line['text']}".encode())
                gap = b"\n"
        if out:
            yield _batch(out, SUMMARY)
    if open_one is not None:
        yield _batch([closed(open_one)], SUMMARY)


def summaries(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the cost and initials of its edits, a digest of its repair.

    The digest is that of one text, so the records of a conversation pass one task in order, one at a time.
    Only those of conversations that were cut are brought together.
    """
    cut = repaired.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    parts = (df.drop("whole").mapInArrow(_assemble, SUMMARY) for df in (repaired.filter("whole"), cut))
    return next(parts).unionByName(next(parts))
