"""Deeply nested records as flat tables."""

import json

from ferrule.operators import nested


def flat(spark, payloads):
    df = spark.createDataFrame([(i, p, "y") for i, p in enumerate(payloads)], "record_id long, payload string, label string")
    return sorted(tuple(r) for r in nested.children(nested.nodes(df)).collect())


PAPER = {
    "filename": "a.pdf",
    "materials": [
        None,
        {"material_id": "MAT_1", "normalized_formula": "LiCoO2", "elements": {"Li": 1.0, "Co": "0.335"}, "properties": [None, {"property_name": "Voltage", "raw_value": "2.5"}, {"property_name": None}]},
        {"material_id": None, "elements": [["O", 2.0], {"symbol": "P", "amount": 1}, {"el": {"symbol": "S"}, "amount": "5.7"}], "properties": {"property_name": "Density", "raw_value": 3}},
        {"material_id": "MAT_1", "elements": '{"Na": 0.7}'},
    ],
    "relations": [
        {"material_id": "MAT_1", "property_name": "Voltage", "property_value": {"version": 2, "field": {"raw_value": "2.5"}}},
        {"material_id": "MAT_99", "property_name": "X", "property_value": '{"raw_value": "7"}'},
        None,
        {"property_name": "Y", "property_value": "plain"},
        {"material_id": "NONE", "property_value": None},
    ],
}
WANT = [
    ("element", 2, 0, "Co", "335"), ("element", 2, 0, "Li", "1000"), ("element", 3, 0, "O", "2000"), ("element", 3, 0, "P", "1000"), ("element", 3, 0, "S", "5700"), ("element", 4, 0, "Na", "700"),
    ("material", 2, 0, "LiCoO2", "MAT_1"), ("material", 3, 0, "NONE", "NONE"), ("material", 4, 0, "NONE", "MAT_1"),
    ("property", 2, 2, "Voltage", "2.5"), ("property", 2, 3, "NONE", "NONE"), ("property", 3, 1, "Density", "3"),
    ("relation", 0, 2, "X", "7"), ("relation", 0, 4, "Y", "plain"), ("relation", 0, 5, "NONE", "NONE"), ("relation", 2, 1, "Voltage", "2.5"),
]


def test_shapes(spark):
    text = json.dumps(PAPER)
    wrapped = [text, "﻿" + text, json.dumps(text), json.dumps({"data": {"paper": PAPER}}), json.dumps([PAPER]), json.dumps({"schema_version": 1, "papers": [PAPER]})]
    assert flat(spark, wrapped) == sorted((i, *w) for i in range(len(wrapped)) for w in WANT)


def test_unreadable(spark):
    bad = [None, "", "  ", "NONE", "{", json.dumps(PAPER)[:-20], "[]", "{}", "3", '"x"', "[" * 5000, json.dumps({"materials": None, "relations": {}})]
    assert flat(spark, bad) == []


def test_intervals_nest():
    rows = nested.payload_nodes(json.dumps(PAPER))
    pre, post = [r[1] for r in rows], [r[2] for r in rows]
    assert len(set(pre)) == len(pre) and len(set(post)) == len(post)
    for m in (r for r in rows if r[0] == "material"):
        inside = [r for r in rows if m[1] < r[1] and r[2] < m[2]]
        assert all(r[0] in ("element", "property") for r in inside)


def test_repeated_rows_and_empty(spark):
    text = json.dumps(PAPER)
    df = spark.createDataFrame([(1, text), (1, text)], "record_id long, payload string")
    assert nested.children(nested.nodes(df)).count() == len(WANT)
    assert nested.children(nested.nodes(df.limit(0))).count() == 0


def test_any_depth():
    """Materials under 500 wrappers, and a payload encoded ten times as a string."""
    import json

    v = {"materials": [{"material_id": "m", "normalized_formula": "LiF"}]}
    want = [("material", "LiF", "m")]
    deep = v
    for i in range(500):
        deep = {"inner": deep} if i % 2 else [deep]
    text = json.dumps(v)
    for _ in range(10):
        text = json.dumps(text)
    for payload in (json.dumps(deep), text, json.dumps({"a": json.dumps(json.dumps(v))})):
        assert [(n[0], n[4], n[5]) for n in nested.payload_nodes(payload)] == want
    assert nested.payload_nodes("[" * 100_000 + "]" * 100_000) == []
