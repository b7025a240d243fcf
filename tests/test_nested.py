import json

from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.functions.jsonx import BAD, decode, loads_deep
from webloom.operators.nested import COLLECTIONS, flatten, inside, label, node_table

SOURCES = {"m": None, "l": "links"}
NAMES = frozenset(COLLECTIONS)


def paths(m, l=BAD):
    return [(n[2], n[1]) for n in label([(m, None), (l, "links")], NAMES, False)]


def naive(value, path="", parent="$", name=None):
    """The same by plain recursion."""
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            p = f"{path}.{k}" if path else k
            if k in NAMES and isinstance(v, (dict, list)):
                out += naive_items(v, p, parent, False)
            else:
                out += naive(v, p, parent)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += naive(v, f"{path}[{i}]", parent)
    return out


def naive_items(value, path, parent, strings):
    out = []
    for i, v in enumerate(value if isinstance(value, list) else [value]):
        p = f"{path}[{i}]"
        if isinstance(v, dict) or strings and isinstance(v, str):
            out.append((parent, p))
            out += naive(v, p, p)
        elif isinstance(v, list):
            out += naive(v, p, parent)
    return out


def test_paths():
    m = {"images": [{"variants": {"w": 1}}, None, {"b": 2}], "og": {"images": [{}]}, "lists": {"items": ["q", {"lists": [{"items": [{"t": 1}]}]}]}, "rows": [["a"], {"cells": [{"v": 1}]}]}
    assert paths(m) == [
        ("$", "images[0]"), ("images[0]", "images[0].variants[0]"), ("$", "images[2]"), ("$", "og.images[0]"), ("$", "lists[0]"), ("lists[0]", "lists[0].items[1]"), ("lists[0].items[1]", "lists[0].items[1].lists[0]"),
        ("lists[0].items[1].lists[0]", "lists[0].items[1].lists[0].items[0]"), ("$", "rows[1]"), ("rows[1]", "rows[1].cells[0]"),
    ]
    assert paths(BAD, ["u", None, {"hops": [{}, {}]}]) == [("$", "links[0]"), ("$", "links[2]"), ("links[2]", "links[2].hops[0]"), ("links[2]", "links[2].hops[1]")]
    assert paths(BAD, {"href": "x"}) == [("$", "links[0]")]


keys = st.sampled_from([*COLLECTIONS, "og", "text", "a.b"])
trees = st.recursive(st.none() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=4) | st.dictionaries(keys, c, max_size=4), max_leaves=25)


@given(trees, trees)
@settings(max_examples=150, deadline=None)
def test_against_recursion(m, l):
    m, l = (BAD if x is None or isinstance(x, str) else x for x in (m, l))
    want = (naive(m) if m is not BAD else []) + (naive_items(l, "links", "$", True) if isinstance(l, (list, dict)) else [])
    assert paths(m, l if isinstance(l, (list, dict)) else BAD) == want


@given(trees)
@settings(max_examples=100, deadline=None)
def test_intervals_contain(m):
    nodes = label([(m, None)], NAMES, False)
    by = {n[1]: n for n in nodes}
    for n in nodes:
        assert n[5] < n[6]
        if n[2] != "$":
            assert by[n[2]][5] < n[5] and n[6] < by[n[2]][6] and n[7] == by[n[2]][5]


def test_decode():
    assert decode(json.dumps(json.dumps([1]))) == [1]
    assert all(decode(x) is BAD for x in (None, "", "  ", "[1", "NaN", "null", '"plain"', "[" * 100_000))
    assert decode("[" + "9" * 5000 + "]")


def test_flatten_edges(spark):
    deep = json.dumps({"lists": [{"items": [{"t": "\ud800"}]}]})
    rows = [(1, deep, None, "x"), (1, deep, None, "x"), (None, None, '["a"]', None), (2, "", "[", ""), (3, "{}", json.dumps(json.dumps(["u"] * 3)), "y")]
    df = spark.createDataFrame(rows, "key bigint, m string, l string, kind string")
    got = sorted((str(r["key"]), r["node_path"]) for r in flatten(df, "key", SOURCES).collect())
    assert got == sorted([("1", "lists[0]"), ("1", "lists[0].items[0]")] * 2 + [("None", "links[0]")] + [("3", f"links[{i}]") for i in range(3)])
    assert flatten(df.limit(0), "key", SOURCES).count() == 0


def test_tables_link(spark):
    nodes = flatten(spark.createDataFrame([(1, '{"lists": [{"items": [{"t": 1}, {"t": 2}]}], "images": [{}]}', None)], "id bigint, m string, l string"), "id", SOURCES)
    pairs = inside(node_table(nodes, "items"), node_table(nodes, "lists"), "id").collect()
    assert sorted((r["outer_path"], r["inner_path"]) for r in pairs) == [("lists[0]", "lists[0].items[0]"), ("lists[0]", "lists[0].items[1]")]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20), st.sampled_from([None, 1]))
def test_deep_reader_reads_as_json(value, indent):
    text = json.dumps(value, indent=indent)
    assert loads_deep(text) == json.loads(text)
    for cut in (text[:-1], text + "]", text.replace(":", ",", 1)):
        try:
            want = json.loads(cut)
        except ValueError:
            want = BAD
        try:
            got = loads_deep(cut)
        except (ValueError, IndexError):
            got = BAD
        assert got == want


def test_deep_nesting():
    deep = '{"x":[' * 30_000 + '{"images":[{"a":1},null,{"variants":{"b":2}}]}' + "]}" * 30_000
    nodes = label([(decode(deep), None)], NAMES, True)
    assert [n[0] for n in nodes] == ["images", "images", "variants"] and nodes[2][2] == nodes[1][1] and nodes[1][2] == "$"
    assert decode(deep[:-1]) is BAD and decode("[" * 50_000) is BAD
