import json

import pytest

from fieldloom.llm import chat_links as C

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}


def call(i, needs=(), name="add", **arguments):
    return {"id": i, "name": name, "arguments": arguments, "depends_on": list(needs)}


def calls(*held):
    return json.dumps({"tool_calls": list(held)})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def rows(spark, held, **options):
    frame = spark.createDataFrame([(*r, "extra") for r in held], "conv_id long, turn long, role string, text string, level string").repartition(3)
    return C.link(frame, SCHEMAS).orderBy("conv_id", "turn", "place").collect()


def test_linking_order_and_status(spark):
    held = [
        (1, 0, "user", "do it"),
        (1, 1, "assistant", calls(call("x", a=1), call("y", ["x"], a=2), call("z", ["y", "x"], a=-1), call("u", ["nowhere"], a=1))),
        (1, 2, "tool", result("x")), (1, 3, "tool", result("y")), (1, 4, "tool", result("y")), (1, 5, "tool", result("lost")),
        (2, 0, "tool", result("x")), (2, 1, "assistant", calls(call("x", a=1))), (2, 2, "assistant", calls(call("x", a=5))),
        (3, 0, "assistant", calls(call("a", ["b"], a=1), call("b", ["a"], a=1))),
        (4, 0, "assistant", calls(call("w", name="none", a=1), call("", a=1), "text")),
    ]
    found = [(r["conv_id"], r["turn"], r["place"], r["kind"], r["level"], r["status"], r["linked_turn"]) for r in rows(spark, held)]
    assert found == [
        (1, 0, 0, "message", 0, "message", None),
        (1, 1, 0, "call", 0, "linked", 2), (1, 1, 1, "call", 2, "linked", 3), (1, 1, 2, "call", 4, "invalid", None), (1, 1, 3, "call", None, "unordered", None),
        (1, 2, 0, "result", 1, "linked", 1), (1, 3, 0, "result", 3, "linked", 1), (1, 4, 0, "result", None, "duplicate", None), (1, 5, 0, "result", None, "orphan", None),
        (2, 0, 0, "result", None, "orphan", None), (2, 1, 0, "call", 0, "open", None), (2, 2, 0, "call", None, "duplicate", None),
        (3, 0, 0, "call", None, "unordered", None), (3, 0, 1, "call", None, "unordered", None),
        (4, 0, 0, "call", 0, "invalid", None), (4, 0, 1, "call", None, "invalid", None), (4, 0, 2, "call", None, "invalid", None),
    ]


def test_schema_violations():
    check = lambda **a: C.violations(a, SCHEMAS["add"])
    assert check(a=1, b=["x"]) == [] and check(a=2.0) == []
    assert check() == ["$.a: missing"] and check(a=True) == ["$.a: not integer"] and check(a=-1) == ["$.a: out of range"]
    assert check(a=1, c=1) == ["$.c: unknown"] and check(a=1, b=[1]) == ["$.b[0]: not string"]


def test_canonical_json():
    assert C.canonical({"b": [1.0, 2.5, None], "a": {"z": "é", "y": True}}) == '{"a":{"y":true,"z":"é"},"b":[1,2.5,null]}'
    with pytest.raises(ValueError):
        C.canonical(float("nan"))


def test_odd_rows(spark):
    held = [(None, None, None, None), (1, None, "tool", result("x")), (1, 1, "assistant", "{broken"), (1, 2, "assistant", '{"tool_calls": []}'), (1, 3, "user", "x" * 100_000), (1, 3, "user", "x" * 100_000), (2, 0, "tool", "{}")]
    found = rows(spark, held)
    assert len(found) == len(held) and all(json.loads(r["json"]) for r in found)
    assert [r["status"] for r in found if r["kind"] == "result"] == ["orphan", "orphan"]
    assert C.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), SCHEMAS).count() == 0


def test_whole_table_by_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    held = {(r["conv_id"], r["turn"]): r for r in table.collect()}
    found = C.link_conversations(table).collect()
    assert len(found) == len(held)
    for r in found:
        key = (r["conv_id"], r["turn"])
        source, body = held[key], json.loads(r["json"])
        before, after = held.get((key[0], key[1] - 1)), held.get((key[0], key[1] + 1))
        if source["role"] == "user":
            depth, t = 0, key[1]
            while t >= 2:
                depth, t = depth + 2, t - 2
            assert body["arguments"] == {"prompt": source["text"], "turn": key[1]} and r["level"] == depth
            assert r["status"] == ("linked" if after and after["role"] == "assistant" else "open")
        elif source["role"] == "assistant":
            assert body["content"] == source["text"] and r["status"] == ("linked" if before and before["role"] == "user" else "orphan")
        else:
            assert (r["status"], body["content"]) == ("message", source["text"])


def test_ways_of_many_calls_with_several_needs_have_levels(spark, monkeypatch):
    monkeypatch.setattr(C, "DEPTH", 2, raising=False)  # a bound on the rounds, if there is one, ends here
    made = [call("c0"), call("c1"), *(call(f"c{i}", needs=(f"c{i - 1}", f"c{i - 2}")) for i in range(2, 7))]
    calls = [(1, i, "assistant", json.dumps({"tool_calls": [x]})) for i, x in enumerate(made)]
    rows = C.link(spark.createDataFrame(calls, "conv_id long, turn long, role string, text string")).collect()
    assert {r["call_id"]: r["level"] for r in rows} == {"c0": 0, "c1": 0, **{f"c{i}": 2 * (i - 1) for i in range(2, 7)}}
    assert "unordered" not in {r["status"] for r in rows}


DEEP = {n: '{"tool_calls": [{"id": "d", "name": "add", "arguments": {"a": ' + "[" * n + "]" * n + "}}]}" for n in (100, 3_000, 200_000)}


@pytest.mark.parametrize(
    "text",
    [
        '{"tool_calls": [{"id": "\\ud800", "name": "\\udfff", "arguments": {"\\ud83d": "\\ud83d\\ude00 \\ude00"}, "depends_on": ["\\ud800"]}]}',
        '{"tool_calls": [{"id": "i", "name": "add", "arguments": {"a": 1e999, "b": -1e999, "c": NaN, "d": Infinity, "e": 1e-999, "f": 1e300}}]}',
        '{"tool_calls": [{"id": "i", "name": "add", "arguments": {"a": ' + "9" * 5_000 + "}}]}",
        '{"tool_calls": [{"id": "i", "name": "add", "arguments": "{\\"a\\": 1e999}"}]}',
        *DEEP.values(),
        "{" * 100_000,
        '{"' + '\\"' * 50_000,
        '{"a": "' + "\\",
    ],
)
def test_hostile_json(spark, text):
    """Events of any text are valid rows with valid JSON, and the job goes on."""
    for role in ("assistant", "tool", "user"):
        for *_, body in C.parse(0, role, text, SCHEMAS):
            json.loads(body)
            body.encode()
    found = rows(spark, [(1, 0, "assistant", text), (1, 1, "tool", text), (1, 2, "tool", result("i"))])
    assert all(json.loads(r["json"]) is not None for r in found)


def test_defined_results_of_hostile_json():
    (place, kind, call_id, name, needs, errors, body), *_ = C.parse(0, "assistant", '{"tool_calls": [{"id": "\\ud800", "name": "add", "arguments": {"a": 1e999, "b": ["\\udfff"]}, "depends_on": ["\\ud801x"]}]}', SCHEMAS)
    assert (kind, call_id, needs) == ("call", "\ufffd", ["\ufffdx"]) and json.loads(body)["arguments"] == {"a": None, "b": ["\ufffd"]} and errors == ["$.a: not integer"]
    assert C.parse(0, "assistant", DEEP[100], SCHEMAS)[0][1] == "call"
    assert C.parse(0, "assistant", DEEP[3_000], SCHEMAS)[0][1] == "message" and json.loads(C.parse(0, "assistant", DEEP[3_000], SCHEMAS)[0][-1])["content"] == DEEP[3_000]


def test_an_identifier_that_repeats_very_often(spark):
    held = [(1, 0, "assistant", calls(call("x", a=1)))] + [(1, 1 + i, "tool", result("x", i)) for i in range(3_000)] + [(1, 9_000 + i, "assistant", calls(call("x", a=i))) for i in range(500)]
    found = rows(spark, held)
    assert [r["status"] for r in found] == ["linked", "linked", *["duplicate"] * 3_499]
    assert found[0]["linked_turn"] == 1 and found[1]["level"] == 1


def test_exact_repeats_of_rows(spark):
    held = [(1, 0, "assistant", calls(call("x", a=1)))] * 2 + [(1, 1, "tool", result("x"))] * 3
    assert sorted(r["status"] for r in rows(spark, held)) == ["duplicate"] * 3 + ["linked"] * 2
