import json

from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.functions.jsonx import read_one
from sessionloom.operators import shred

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from("abcd"), x, max_size=3), max_leaves=20)


def paths(value, at="", item=False):
    if isinstance(value, dict):
        own = [at] if item else []
        return own + [p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)]
    return [p for i, v in enumerate(value) for p in paths(v, f"{at}[{i}]", True)] if isinstance(value, list) else []


@given(VALUES)
@settings(max_examples=300, deadline=None)
def test_elements_come_back_from_the_levels(value):
    if isinstance(value, dict | list):
        assert sorted(shred.elements(shred.shred(value))) == sorted(paths(value))


@given(VALUES)
@settings(max_examples=200, deadline=None)
def test_tables_keep_every_scalar_and_parent(value):
    if not isinstance(value, dict | list):
        return
    rows = shred.tables(shred.shred(value))
    nodes = {node for _, node, _, _ in rows}
    assert all(up in nodes for _, node, up, _ in rows if node)

    kept = sum(v is not None for _, _, _, fields in rows for v in json.loads(fields).values())
    assert kept == scalars_not_null(value)


def scalars_not_null(v):
    if isinstance(v, dict):
        return sum(map(scalars_not_null, v.values()))
    if isinstance(v, list):
        return sum(map(scalars_not_null, v))
    return v is not None


def test_levels_of_a_known_record():
    columns = {shred.name(p) + "{}" * flag: levels for p, flag, levels in shred.shred({"a": [{"x": 1}, {}, None]})}
    assert columns["a[]{}"] == [(0, 3, None), (1, 3, None), (1, 2, None)]  # object, object, null element
    assert columns["a[].x"] == [(0, 4, 1), (1, 2, None), (1, 2, None)]
    assert columns["a[]"] == [(0, 2, None), (1, 2, None), (1, 3, None)]  # the null is a value of the element itself


def test_read_one():
    assert read_one(' {"a": 1} ') == (True, {"a": 1})
    for bad in (None, "", " ", "{", "{} {}", "{}x", "NaN", '{"a": Infinity}', "[1,]", "'a'"):
        assert read_one(bad) == (False, None)
    assert read_one("9" * 9000)[0]
    assert read_one("[" * 100_000 + "]" * 100_000)[0]
    assert not read_one("[" * 100_000 + "]" * 99_999)[0]


def test_frames(spark):
    rows = [("s", 1, '{"content": [{"a": 1}, {"b": [{"c": 2}]}]}'), ("s", 1, '{"content": [{"a": 1}, {"b": [{"c": 2}]}]}'), ("s", 2, None), ("s", 3, "{"), (None, 4, "[{}]"), ("s", None, "[{}]"), ("s", 5, '[{"x": "\\ud800"}]'), ("s", 6, json.dumps({"k": [{"t": "x" * 200_000}] * 30}))]
    df = spark.createDataFrame([(*r, "n") for r in rows], "session_id string, line_no int, payload string, node_path string")
    got = {(r.line_no, r.node_path) for r in shred.object_elements(df).collect()}
    assert {x for x in got if x[0] == 1} == {(1, "content[0]"), (1, "content[1]"), (1, "content[1].b[0]")}
    assert (5, "[0]") in got and len([x for x in got if x[0] == 6]) == 30 and {x[0] for x in got} == {1, 5, 6}
    assert shred.object_elements(df).count() == len(got)
    assert shred.flat_tables(df).where("line_no = 1").count() == 4
    assert shred.level_columns(df.limit(0)).count() == 0 and shred.object_elements(df.limit(0)).count() == 0
