import hashlib
import heapq
import re
import zlib

import pytest
import xxhash
from conftest import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertline.llm.queries import QUERIES, with_damage
from alertline.llm.repair import DONE, repair, repaired_turns, summaries, vector_before, walk

WORD = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile("(s?(ua)+)?")


def faults_of(rows):
    """Of rows (turn, role, text) in order: the first fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        letters = WORD.findall(text)
        if not letters:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if letters[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """The least (cost, edits) over all edit sequences, by a search from the front through every state."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = (i, roles[-1:], roles)[:2]
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, lines
        if state in done:
            continue
        done.add(state)
        options = [("I", 2, i, r, ("user" if r == "u" else "assistant", "")) for r in "ua"]
        if i < len(rows):
            _, role, text = rows[i]
            extra = faults[i] == "truncated"
            options.append(("D", 3, i + 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and role[:1] in "sua":
                    options.append(("K", extra, i + 1, role[:1], (role, text)))
                options += [("R", 2 + extra, i + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for edit, price, j, r, line in options:
            if not r or re.fullmatch("s?(ua)*u?", roles + r):
                more = lines if line is None else (*lines, line)
                heapq.heappush(heap, (cost + price, audit + edit, j, roles + r, more))


def expected(rows):
    rows = list(rows)
    faults = faults_of(rows)
    cost, audit, lines = cheapest(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def in_order(rows):
    def place(row):
        turn, role, text = row
        hashed = xxhash.xxh64_intdigest(text.encode(), seed=42)
        return turn is not None, turn or 0, role.encode(), hashed - (1 << 64 if hashed >> 63 else 0)

    return sorted(rows, key=place)


def damaged(rows):
    """The contract's damage, row by row."""
    for conv_id, turn, role, text in rows:
        conv, at, role, text = (" " if x is None else x for x in (conv_id, turn, role, text))
        kind = zlib.crc32(f"{conv}:{at}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv_id, turn, role, text


CODES = st.lists(st.integers(0, 15).filter(lambda c: c & 12 != 12), max_size=40)


@settings(max_examples=300, deadline=None)
@given(CODES)
def test_edits_are_the_least_of_the_cheapest(codes):
    rows = [(0, "xsua"[c & 3], "text") for c in codes]
    faults = ["blank" if c & 4 else "truncated" if c & 8 else "" for c in codes]
    cost, audit, _ = cheapest(rows, faults)
    assert vector_before(bytes(codes), DONE)[0] == cost
    assert "".join(edit for edit, _, _ in walk(bytes(codes), DONE, 0, True)) == audit


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by_conversation = {conv_id: [] for conv_id, *_ in rows}
    for conv_id, *row in damaged(rows):
        by_conversation[conv_id].append(tuple(row))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, FOLDER).collect()}
    assert got == {conv_id: expected(in_order(found)) for conv_id, found in by_conversation.items()}


ODD = [
    (1, None, "user", "Hello."),
    (1, 0, "assistant", None),
    (1, 0, None, "What?"),
    (1, 5, "", "No role."),
    (1, 5, "tool", "A result"),
    (1, 9, "user", " \t\n"),
    (None, 0, "user", "Nobody."),
    (None, 1, "assistant", "Nobody, too"),
    (2, None, None, None),
    (3, 1, "user", "Same."),
    (3, 1, "user", "Same."),
    (3, 2, "assistant", "Same."),
    (3, 7, "assistant", "word " * 50_000 + "."),
    *((4, k // 2, ("user", "assistant", "system")[k % 3], f"Text {k % 40}{'.' * (k % 4)}") for k in range(300)),
    *((5, 1, "user", "All equal.") for _ in range(100)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(c, t, r, x, "clash", "clash") for c, t, r, x in ODD]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string, lines string").repartition(3)


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_odd_conversations_in_records_of_any_size(odd, block_rows):
    by_conversation = {}
    for conv_id, turn, role, text in ODD:
        by_conversation.setdefault(conv_id, []).append((turn, " " if role is None else role, " " if text is None else text))
    fixed = repair(odd, block_rows=block_rows).cache()
    got = {r.conv_id: tuple(r)[1:] for r in summaries(fixed).collect()}
    assert got == {conv_id: expected(in_order(rows)) for conv_id, rows in by_conversation.items()}
    assert fixed.agg(F.max(F.length("audit"))).first()[0] <= 3 * block_rows
    turns = repaired_turns(fixed).orderBy("part", "block", "position").collect()
    for conv_id in by_conversation:
        assert GOOD.fullmatch("".join(t.role[:1] for t in turns if t.conv_id == conv_id))


def test_no_conversations(odd):
    assert summaries(repair(odd.limit(0))).count() == 0
    assert with_damage(odd.limit(0)).count() == 0
