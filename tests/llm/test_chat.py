"""Tool-call linking: order, validation, canonical JSON, and what cannot be linked."""

import json

import pytest

from answerlab.llm import chat

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>, step int"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string, json string"
TOOLS = [chat.Tool("add", {"x": "number", "on": "boolean"}, {"tags": "array", "at": "object", "n": "integer", "s": "string"})]


def linked(spark, calls, results):
    out = chat.link_tool_calls(
        spark.createDataFrame([(*c, 0) for c in calls], CALLS).repartition(3),
        spark.createDataFrame([(*r, "") for r in results], RESULTS),
        TOOLS,
    )
    return {(row["conv_id"], row["call_id"], row["turn"]): row for row in out.collect()}


def test_order_and_results(spark):
    good = '{"on": true, "x": 1.5}'
    calls = [
        (1, 5, "c", "add", good, ["a", "b", "b"]),
        (1, 4, "b", "add", good, ["a"]),
        (1, 9, "a", "add", good, []),
        (1, 6, "d", "add", good, None),
        (2, 1, "a", "add", good, ["nowhere", None]),
        (3, 1, "p", "add", good, ["q"]),
        (3, 2, "q", "add", good, ["p"]),
        (3, 3, "r", "add", good, ["q"]),
        (None, 1, "a", "add", good, ["b"]),
        (4, 1, None, "add", good, []),
        (5, 1, "twin", "add", good, []),
        (5, 2, "twin", "add", good, []),
    ]
    results = [(1, 8, "a", "late"), (1, 7, "a", "early"), (9, 1, "a", "orphan"), (None, 1, "a", "none"), (5, 3, "twin", "both")]
    found = linked(spark, calls, results)
    assert [found[1, i, t]["step"] for i, t in (("a", 9), ("b", 4), ("c", 5), ("d", 6))] == [0, 1, 2, 0]
    assert json.loads(found[1, "a", 9]["json"])["result"] == "early"
    assert found[2, "a", 1]["problems"] == "no_result,unknown_dependency"
    assert all(found[3, i, t]["step"] is None and "cycle" in found[3, i, t]["problems"] for i, t in (("p", 1), ("q", 2), ("r", 3)))
    assert found[None, "a", 1]["step"] == 0 and "no_result" in found[None, "a", 1]["problems"]
    assert found[4, None, 1]["step"] == 0
    assert found[5, "twin", 1]["problems"] == found[5, "twin", 2]["problems"] == ""
    assert len(found) == len(calls)
    frame = spark.createDataFrame([(*c, 0) for c in calls], CALLS)
    orphans = chat.orphan_results(frame, spark.createDataFrame([(*r, "") for r in results], RESULTS))
    assert sorted(r["content"] for r in orphans.collect()) == ["none", "orphan"]


@pytest.mark.parametrize(
    ("arguments", "problems"),
    [
        ('{"x": 1, "on": false, "tags": [], "at": {}, "n": 3, "s": ""}', ""),
        ('{"x": "1", "on": 0, "n": 1.5}', "type:n,type:on,type:x"),
        ('{"on": true, "zz": 1}', "extra:zz,missing:x"),
        ("[1]", "bad_json"),
        ('{"x": ', "bad_json"),
        (None, "bad_json"),
        ("", "bad_json"),
    ],
)
def test_arguments(spark, arguments, problems):
    found = linked(spark, [(1, 1, "a", "add", arguments, [])], [(1, 2, "a", "ok")])
    assert found[1, "a", 1]["problems"] == problems


def test_canonical_json(spark):
    long = "é\n\"\\" * 5000
    arguments = json.dumps({"z": {"b": 1, "a": [True, None, "x"]}, "on": True, "x": 2, "long": long})
    found = linked(spark, [(1, 1, "a", "other", arguments, ["b", "a"])], [(1, 2, "a", "ok")])[1, "a", 1]
    expected = {"arguments": json.loads(arguments), "depends_on": ["a", "b"], "id": "a", "name": "other", "result": "ok"}
    assert found["json"] == json.dumps(expected, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert found["problems"] == "cycle,unknown_dependency,unknown_tool"


def test_empty_tables(spark):
    assert linked(spark, [], []) == {}
    assert len(linked(spark, [(1, 1, "a", "add", "{}", [])], [])) == 1


def test_results_that_are_in_no_call_are_rows(spark):
    calls = [(1, 5, "a", "add", "{}", []), (1, 6, "b", "add", "{}", []), (2, 1, None, "add", "{}", []), (3, 1, "n", "add", "{}", [])]
    results = [
        (1, 7, "a", "first"), (1, 7, "a", "first"), (1, 7, "a", "later in order"), (1, 9, "a", "first"), (1, 8, "a", None),
        (1, 7, "z", "no such call"), (4, 1, "a", "no such conversation"), (None, 1, "a", "null"), (2, 2, None, "é\n\""),
        (3, 2, "n", None), (3, 2, "n", "text"),
    ]
    left, right = spark.createDataFrame([(*c, 0) for c in calls], CALLS), spark.createDataFrame([(*r, "") for r in results], RESULTS)
    rows = chat.link_turns(left, right.repartition(3), TOOLS).collect()
    # Every result is in a call's JSON or a row of its own.
    counted = {(1, "a"): (7, "first"), (3, "n"): (2, None)}
    expected = []
    for conv, turn, call, content in results:
        first = counted.get((conv, call))
        if first != (turn, content):
            what = "surplus_result" if first else "no_call"
            expected.append((conv, turn, call, None, what, {k: v for k, v in (("id", call), ("result", content)) if v is not None}))
    alone = [(*row[:5], json.loads(row["json"])) for row in rows if row["problems"] in ("no_call", "surplus_result")]
    assert sorted(alone, key=repr) == sorted(expected, key=repr)
    assert len(rows) == len(calls) + len(expected)
    assert chat.unlinked_results(left, spark.createDataFrame([], RESULTS)).collect() == []
    assert chat.unlinked_results(spark.createDataFrame([], CALLS), right).count() == len(results)
