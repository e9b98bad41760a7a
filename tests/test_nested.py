"""Nested records: which text counts, positions, identities."""

import datetime as dt
import json

from symtide.operators import nested as N

SCHEMA = "record_id long, conv_id long, loaded_at timestamp_ntz, raw_json string"
TOOL = {"type": "function", "function": {"name": "f"}}
GEN = {"predictionConfig": {"fields": [{"key": "x"}, {"key": N.TOOLS_KEY, "value": {"tools": [TOOL, None, TOOL]}}, {"key": N.TOOLS_KEY, "value": {"tools": TOOL}}, 7]}}
OBJ = {
    "messages": [
        {"versions": {"steps": {"content": [None, "x", {"type": "text", "text": "a"}], "genInfo": GEN}, "content": {"type": "text", "text": "a"}}},
        "plain",
        {"versions": [None, {"steps": [{"content": {"type": "text", "text": "b"}}, {"content": None}, 3]}, {"content": []}]},
        {},
    ]
}
WANT = {
    ("message", "0"), ("message", "2"), ("message", "3"), ("version", "0/0"), ("version", "2/1"), ("version", "2/2"), ("step", "0/0/0"), ("step", "2/1/0"), ("step", "2/1/1"),
    ("content", "0/0/0/2"), ("content", "0/0/-/0"), ("content", "2/1/0/0"), ("tool", "0/0/0/1/0"), ("tool", "0/0/0/1/2"), ("tool", "0/0/0/2/0"),
}


def t(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def found(df):
    return {(r["conv_id"], r["node_level"], r["node_path"]) for r in df.collect() if r["node_level"] in N.LEVELS}


def test_positions_and_choice(spark, clash):
    text, other = json.dumps(OBJ), json.dumps({"messages": [{}]})
    rows = [
        (1, 1, t(1), other), (2, 1, t(5), text), (3, 1, t(9), text[:-9]), (4, 1, None, other), (5, 2, t(1), "﻿ \n" + json.dumps(json.dumps("  " + text))), (6, 3, t(1), ""), (7, 3, t(2), None), (8, 4, t(1), "[1]"),
        (9, 5, t(1), other), (10, 5, t(1), json.dumps({"messages": None})), (11, None, t(1), text), (12, 6, t(3), json.dumps({"messages": {"versions": {}}})), (2, 1, t(5), text),
    ]
    got = found(N.nodes(clash(spark.createDataFrame(rows, SCHEMA))))
    assert got == {(c, *x) for c in (1, 2) for x in WANT} | {(6, "message", "0"), (6, "version", "0/0")}
    assert found(N.nodes(spark.createDataFrame(rows, SCHEMA), with_bodies=False)) == got
    assert N.nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_identities(spark):
    rows = [(1, 1, t(1), json.dumps(OBJ)), (2, 2, t(1), json.dumps(OBJ, indent=2))]
    bridge = N.nodes(spark.createDataFrame(rows, SCHEMA))
    a, b = ({(r["node_path"], r["node_level"]): r["node_hash"] for r in bridge.filter(f"conv_id = {c}").collect()} for c in (1, 2))
    assert a == b and a[("0/0/0/1/0", "tool")] == a[("0/0/0/1/2", "tool")] and a[("0/0/0/2", "content")] == a[("0/0/-/0", "content")] != a[("2/1/0/0", "content")]
    objects = {(r["node_level"], r["node_hash"]): r["n_occurrences"] for r in N.objects(bridge).collect()}
    assert objects[("tool", a[("0/0/0/1/0", "tool")])] == 6
    up = {(r["node_path"], r["node_level"]): (r["parent_path"], r["parent_hash"]) for r in bridge.filter("conv_id = 1").collect()}
    assert up[("0/0/0/g", "gen_info")] == ("0/0/0", a[("0/0/0", "step")]) and up[("0/0/0/1/0", "tool")] == ("0/0/0/g", a[("0/0/0/g", "gen_info")])
    bodies = {r["node_level"]: r["body"] for r in N.objects(bridge).filter("node_level IN ('step', 'gen_info')").collect() if "genInfo" in r["body"] or r["node_level"] == "gen_info"}
    assert '"f"' not in bodies["gen_info"] and '"x"' in bodies["gen_info"] and N.TOOLS_KEY not in bodies["step"]  # a tool is stored once, as a tool
    assert up[("0/0/-/0", "content")] == ("0/0", a[("0/0", "version")]) and up[("0", "message")] == ("", a[("", "conversation")])


def test_plain_values_tell_objects_apart(spark):
    fields = [{"content": c} for c in ("hello", "other", None, [], ["a"], ["b"], [{}], [{}, 1], [{}, 2], 0)] + [{}, {"tools": 1}, {"tools": [1]}, {"#content": []}, {"#content": [], "content": []}]
    steps = {"messages": [{"versions": [{"steps": fields}]}]}
    plain = [{"messages": m} for m in ("x", "y", None, ["x"], ["y"])] + [{"messages": [{"versions": v}]} for v in ("x", "y", 3)]
    rows = [(i, i, t(1), json.dumps(x)) for i, x in enumerate([steps, *plain])]
    objects = N.objects(N.nodes(spark.createDataFrame(rows, SCHEMA))).collect()
    n = lambda level: sum(r["node_level"] == level for r in objects)
    assert (n("step"), n("conversation"), n("message")) == (len(fields), len(rows), 4)
    assert any("hello" in r["body"] for r in objects) and all(r["n_occurrences"] == 1 for r in objects if r["node_level"] == "step")


def test_identities_without_bodies(spark):
    df = spark.createDataFrame([(1, 1, t(1), json.dumps(OBJ))], SCHEMA)
    full, lean = ({(r["node_path"], r["node_level"]): (r["node_hash"], r["parent_hash"]) for r in N.nodes(df, with_bodies=b).collect()} for b in (True, False))
    assert full == lean and all(h for h, _ in lean.values())


def test_any_depth_and_wrapping(spark):
    n, text = 60_000, json.dumps({"messages": [{}]})
    for _ in range(9):
        text = json.dumps(text)
    deep = lambda leaf: '{"messages": [{"a": ' + "[" * n + leaf + "]" * n + "}]}"
    rows = [(1, 1, t(1), deep("1")), (2, 2, t(1), deep("2")), (3, 3, t(1), deep("1")), (4, 4, t(1), text)]
    got = {(r["conv_id"], r["node_level"]): r["node_hash"] for r in N.nodes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[(1, "message")] == got[(3, "message")] != got[(2, "message")] and (4, "message") in got
    assert N.canonical(json.loads('{"b": [1, {}, []], "a": {"c": "\\u00e9"}}')) == '{"a":{"c":"\\u00e9"},"b":[1,{},[]]}'


def test_long_and_deep(spark):
    deep = "[" * 100_000
    rows = [(1, 1, t(1), json.dumps({"messages": [{"versions": []}] * 3000, "x": "y" * 300_000})), (2, 2, t(1), deep), (3, 3, t(1), '{"messages": [{"a": "\\ud800"}]}')]
    got = found(N.nodes(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == 3001 and (3, "message", "0") in got
