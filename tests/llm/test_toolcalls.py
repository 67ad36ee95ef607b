import json
from collections import Counter

from conftest import FOLDER

from alertline.llm.queries import QUERIES
from alertline.llm.toolcalls import canonical, link_calls, problems

CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, after string, level string"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"
GOOD = '{"query": "a", "limit": 2.0}'


def test_query_equals_brute_force(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    users = {(t.conv_id, t.turn): t.text for t in turns if t.role == "user"}
    answers = {(t.conv_id, t.turn - 1): t.text for t in turns if t.role == "assistant"}
    others = Counter((t.conv_id, t.turn, t.role, t.text) for t in turns if t.role not in ("user", "assistant"))
    rows = QUERIES["op10_tool_calls"](spark, FOLDER).collect()
    messages = [r for r in rows if r.status == "message"]
    assert Counter((r.conv_id, r.turn, *map(json.loads(r.message).get, ("role", "text"))) for r in messages) == others
    assert not any(r.valid or r.call_id or r.problems or r.level is not None for r in messages)
    got = {(r.conv_id, r.call_id): r for r in rows if r.status != "message"}
    assert len(got) + len(messages) == len(rows)
    assert set(got) == {(c, f"call_{c}_{t}") for c, t in set(users) | set(answers)}
    for (c, t), text in users.items():
        r = got[c, f"call_{c}_{t}"]
        before, u = 0, t
        while (c, u - 2) in users:
            before, u = before + 1, u - 2
        assert (r.turn, r.level) == (t, before)
        assert r.status == ("linked" if (c, t) in answers else "unanswered")
        n = len(text.split())
        ok = t % 3 == 0 or (1 <= n <= 40)
        lost = t >= 2 and (c, t - 2) not in users
        assert r.valid == (ok and not lost)
        message = json.loads(r.message)
        assert canonical(message) == r.message
        assert message["call"]["name"] == ("measure" if t % 3 == 0 else "search")
        if (c, t) in answers:
            assert message["result"] == {"content": answers[c, t], "turn": t + 1}
    for c, t in set(answers) - set(users):
        assert got[c, f"call_{c}_{t}"].status == "orphan result"


def test_odd_calls(spark):
    calls = [
        (1, 1, "a", "search", GOOD, None, "x"),
        (1, 2, "a", "search", GOOD, None, "x"),  # repeated identifier
        (1, 2, "b", "search", '{"query": "", "limit": true, "z": 1}', "a", "x"),
        (1, 3, "c", "nothing", "{}", "b", "x"),
        (1, 4, "d", "search", "[", "zzz", "x"),
        (1, 5, "e", "measure", '{"words": 1}', "f", "x"),
        (1, 6, "f", "measure", '{"words": NaN}', "e", "x"),
        (1, 7, "g", "measure", "[1]", "g", "x"),
        (2, 1, "a", "measure", '{"words": 1}', None, "x"),
        (2, 1, None, None, None, None, None),
        (None, None, "a", "measure", '{"words": 1}', None, None),
    ]
    results = [(1, 9, "a", "r1", "x"), (1, 8, "a", "r0", "x"), (1, 1, "b", None, "x"), (3, 1, "a", "lost", "x"), (1, 1, None, "n", "x")]
    rows = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    got = {(r.conv_id, r.call_id, r.turn, r.result_turn): r for r in rows}
    assert len(rows) == len(got) == len(calls) + 3
    a = got[1, "a", 1, 8]
    assert (a.status, a.level, a.valid) == ("linked", 0, True)
    assert a.message == (
        '{"call":{"arguments":{"limit":2,"query":"a"},"name":"search"},"id":"a",'
        '"result":{"content":"r0","turn":8},"status":"linked"}'
    )
    assert got[1, "a", 2, None].status == "duplicate" and got[1, "a", None, 9].status == "duplicate result"
    b = got[1, "b", 2, 1]
    assert (b.status, b.level) == ("early result", 1)
    assert b.problems == ["limit is not integer", "query is too short", "unknown z"]
    assert (got[1, "c", 3, None].level, got[1, "c", 3, None].problems) == (2, ["unknown tool"])
    assert got[1, "d", 4, None].problems == ["not JSON", "waits for an unknown call"] and got[1, "d", 4, None].level == 0
    for name, turn in (("e", 5), ("f", 6), ("g", 7)):
        assert got[1, name, turn, None].level is None and "waits in a circle" in got[1, name, turn, None].problems
    assert got[2, "a", 1, None].status == "unanswered" and got[2, None, 1, None].status == "unanswered"
    assert got[3, "a", None, 1].status == "orphan result" and got[1, None, None, 1].status == "orphan result"
    none = link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS))
    assert none.count() == 0


def test_long_chains_and_hot_conversations(spark):
    calls = [(1, k, f"c{k}", "measure", '{"words": 1}', f"c{k - 1}" if k else None, None) for k in range(1500)]
    rows = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS)).collect()
    assert all(r.level == r.turn and r.valid for r in rows) and len(rows) == 1500


def test_canonical_json():
    assert canonical({"b": 1.0, "a": [1.5, "é", None, True]}) == '{"a":[1.5,"é",null,true],"b":1}'
    assert problems('{"words": 2}', {"properties": {"words": {"type": "integer", "enum": [1]}}}) == (
        {"words": 2},
        ["words is not allowed"],
    )


def test_nested_and_loose_schemas():
    schema = {
        "properties": {
            "any": {},
            "maybe": {"type": ["array", "null"], "items": {"type": "integer", "minimum": 1}},
            "filter": {
                "type": "object",
                "properties": {"field": {"type": "string", "enum": ["a", "b"]}, "deep": {"items": {"required": ["x"]}}},
                "required": ["field"],
            },
        }
    }

    def found(arguments):
        return problems(arguments, schema)[1]

    assert found('{"any": [1, {"z": null}], "maybe": null, "filter": {"field": "a", "deep": [{"x": 1}]}}') == []
    assert found('{"maybe": [1, 0, "2", true]}') == ["maybe[1] is out of range", "maybe[2] is not integer", "maybe[3] is not integer"]
    assert found('{"maybe": 3, "filter": []}') == ["filter is not object", "maybe is not array or null"]
    assert found('{"filter": {"other": 1, "deep": [{}]}}') == [
        "missing filter.field", "missing filter.deep[0].x", "unknown filter.other"
    ]
    assert found('{"filter": {"field": "c"}}') == ["filter.field is not allowed"]


def test_text_that_is_no_utf8_is_not_json(spark):
    bad = '{"query":"\\ud800","limit":3}'
    rows = link_calls(
        spark.createDataFrame([(1, 1, "a", "search", bad, None, None)], CALLS), spark.createDataFrame([], RESULTS)
    ).collect()
    assert rows[0].problems == ["not JSON"] and not rows[0].valid
    assert json.loads(rows[0].message)["call"]["arguments"] == bad


def turns_of(rows):
    """The turns that the rows of the query hold: (conv_id, turn, role, text)."""
    found = []
    for r in rows:
        message = json.loads(r.message)
        if "call" in message:
            arguments = message["call"]["arguments"]
            found.append((r.conv_id, r.turn, "user", arguments.get("query", arguments.get("text"))))
        if "result" in message:
            found.append((r.conv_id, r.result_turn, "assistant", message["result"]["content"]))
        if r.status == "message":
            found.append((r.conv_id, r.turn, message["role"], message["text"]))
    return Counter(found)


def test_every_turn_is_found_with_its_whole_text(spark, tmp_path):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert turns_of(QUERIES["op10_tool_calls"](spark, FOLDER).collect()) == Counter(map(tuple, turns.collect()))
    long = " ".join(f"w{k}" for k in range(5000)) + " \t\n\"end"
    odd = [
        (1, 0, "system", long), (1, 1, "user", long), (1, 2, "assistant", long), (1, 3, "user", long), (1, 3, "tool", "x"),
        (2, 3, "user", ""), (2, 6, "user", None), (2, 5, "user", None), (2, 7, None, "no role"), (2, 7, None, None),
        (2, 7, None, None), (None, None, "user", "a b"), (None, None, "system", "a b"), (3, 4, "assistant", "a"), (3, 1, "user", ""),
    ]
    frame = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    assert turns_of(QUERIES["op10_tool_calls"](spark, str(tmp_path)).collect()) == Counter(odd)
