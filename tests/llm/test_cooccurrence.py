import json
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from webloom.llm import cooccurrence as C


def test_addresses():
    assert C.addresses(json.dumps(["a", {"href": "b", "url": "x"}, {"href": None, "url": "c"}, None, {"hops": [{"href": "no"}]}, "a", 5])) == ["a", "b", "c"]
    assert C.addresses(json.dumps(json.dumps(["a"]))) == ["a"] and C.addresses('{"href": "solo"}') == ["solo"]
    assert all(C.addresses(x) == [] for x in (None, "", "[", "null", "3"))


def brute(rows, least):
    n, pairs, total = Counter(), Counter(), 0
    for r in rows:
        items = sorted(set(C.addresses(r)))
        total += bool(items)
        n.update(items)
        pairs.update(combinations(items, 2))
    return {(a, b): (c, n[a], n[b], total) for (a, b), c in pairs.items() if c >= least}


def test_against_brute_force(spark, monkeypatch):
    random.seed(2)
    rows = [json.dumps(["hot"] * random.randint(0, 1) + [f"i{int(random.paretovariate(0.8))}" for _ in range(random.randint(0, 9))]) for _ in range(600)] + [None, "", "[", "[]", json.dumps([""] + ["hot"])] * 6
    df = spark.createDataFrame([(r, "clash", i) for i, r in enumerate(rows)], "j string, item string, row int").repartition(5)
    for flush, bound in ((4_000_000, 1 << 25), (50, 0)):  # small flushes and a shuffled dictionary give the same
        monkeypatch.setattr(C, "FLUSH", flush)
        monkeypatch.setattr(C, "BROADCAST_BYTES", bound)
        got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in C.cooccurrences(df, "j", 3).collect()}
        assert got == brute(rows, 3)
    assert C.cooccurrences(df.limit(0), "j").count() == 0


def test_llr(spark):
    row = C.cooccurrences(spark.createDataFrame([('["a","b"]',)] * 10 + [('["a"]',)] * 5 + [('["b"]',)] * 6 + [('["c"]',)] * 9, "j string"), "j").first()
    k = np.array([[10, 5], [6, 9]], float)
    h = lambda x: sum(v * math.log(v) for v in np.ravel(x) if v)
    want = 2 * (h(k) + k.sum() * math.log(k.sum()) - h(k.sum(0)) - h(k.sum(1)))
    assert abs(row["llr"] - want) < 1e-9 and abs(row["lift"] - 10 * 30 / (15 * 16)) < 1e-12


def test_combine():
    a, b, n = C._combine(np.array([2, 1, 2]), np.array([1, 5, 1]), np.array([1, 1, 4]))
    assert (a.tolist(), b.tolist(), n.tolist()) == ([1, 2], [5, 1], [1, 5])


def test_long_row(spark, monkeypatch):
    """A row of many items is cut up, and the pairs are the same."""
    rows = [(json.dumps([f"u{i}" for i in range(60)]),)] * 5 + [(json.dumps(["u1", "u2"]),)] * 2
    df = spark.createDataFrame(rows, "j string")
    want = {(a, b): 5 + 2 * ((a, b) == ("u1", "u2")) for a in (f"u{i}" for i in range(60)) for b in (f"u{i}" for i in range(60)) if a < b}
    parts = [(pa.RecordBatch.from_arrays([pa.array([list(range(60)), [1, 2], [7]], pa.list_(pa.int64()))], names=["ids"]))]
    whole = {}
    for flush in (C.FLUSH, 100):
        monkeypatch.setattr(C, "FLUSH", flush)
        counts = {}
        for batch in C._stripes(iter(parts)):
            for a, near, n in zip(*(c.to_pylist() for c in batch.columns)):
                for b, k in zip(near, n):
                    counts[a, b] = counts.get((a, b), 0) + k
        assert not whole or counts == whole
        whole = counts
    assert len(whole) == 60 * 59 // 2 and whole[1, 2] == 2
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in C.cooccurrences(df, "j").collect()}
    assert got == want
