import random

import numpy as np

from webloom.llm import neardup as N

random.seed(9)
WORDS = [f"w{i}" for i in range(900)]


def text(n=120):
    return " ".join(random.choice(WORDS) for _ in range(n))


def edited(t, share):
    return " ".join(random.choice(WORDS) if random.random() < share else w for w in t.split())


def jaccard(x, y):
    a, b = N.shingles(x), N.shingles(y)
    common = len(np.intersect1d(a, b))
    return common / (len(a) + len(b) - common)


def test_shingles():
    assert N.shingles("one two") is None and N.shingles(text(59)) is None and len(N.shingles("a b c d", 4)) == 2
    assert np.array_equal(N.shingles("A, b! c d", 4), N.shingles("a b C - d.", 4))
    assert len(N.shingles("编辑在云山城统计了快照" * 8)) == 11  # runs of characters
    assert N.shingles(text(300_000)) is not None and len(N.bands(N.shingles(text(9000)))) == N.BANDS


def test_bound():
    for n, share in ((400, 0.01), (400, 0.05), (400, 0.2), (400, 0.9), (6000, 0.1)):
        x = text(n)
        a, b = N.shingles(x), N.shingles(edited(x, share))
        maps = [np.frombuffer(N.bit_map(v), np.uint64)[None] for v in (a, b)]
        for words in (16, *(m.shape[1] for m in maps)):
            if words <= min(m.shape[1] for m in maps):
                seen = np.bitwise_count(N.fold(maps[0], words) ^ N.fold(maps[1], words)).sum()
                assert seen <= len(np.setxor1d(a, b))
    values = N.shingles(text(3000))
    assert np.array_equal(N.fold(np.frombuffer(N.bit_map(values), np.uint64)[None], 16)[0], np.frombuffer(_short_map(values), np.uint64))


def _short_map(values):
    bits = np.zeros(1024, np.uint8)
    bits[(values >> np.uint64(11)) % np.uint64(1024)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def test_against_brute_force(spark, monkeypatch):
    texts = [text(random.randint(50, 300)) for _ in range(40)] + [text(3000)]
    for t in [*texts[:20], texts[40]]:
        texts += [edited(t, s) for s in (0.02, 0.06, 0.12, 0.3)] + [t, t.upper()]
    rows = [(i, t, None, "c") for i, t in enumerate(texts)] + [(9001, None, None, None), (9002, "", "t", None), (9003, "short", None, None)]
    df = spark.createDataFrame(rows, "id bigint, text string, title string, size string").repartition(6)
    ok = [i for i, t in enumerate(texts) if N.shingles(t) is not None]
    want = {(i, j) for i in ok for j in ok if i < j and jaccard(texts[i], texts[j]) >= 0.5}
    # many tile pairs, few pages a band, blocks of copies, small flushes and a shuffled pick give the same
    for tile, step, ids, hot, copies, flush in ((1 << 14, 512, 1_000_000, 1 << 16, 1024, 1_000_000), (3, 2, 0, 1 << 16, 2, 3), (3, 2, 0, 3, 1, 1)):
        for name, value in {"TILE": tile, "STEP": step, "BROADCAST_IDS": ids, "COPIES": copies, "FLUSH": flush}.items():
            monkeypatch.setattr(N, name, value)
        classes, links = N.near_duplicates(df, "id", "text", "title", hot=hot)
        own = dict(map(tuple, classes.collect()))
        assert sorted(own) == ok and all(N.shingles(texts[i]).tobytes() == N.shingles(texts[c]).tobytes() and c <= i for i, c in own.items())
        found = [tuple(r) for r in links.collect()]
        assert len(found) == len(set(found)) and all(a < b and a in own.values() and b in own.values() for a, b in found)
        got = [tuple(r) for r in N.pairs(classes, links).collect()]
        assert len(got) == len(set(got)) and set(got) - want == set()
        assert len(want - set(got)) <= 0.005 * len(want)  # the recall of the bands
    classes, links = N.near_duplicates(df.limit(0), "id", "text", "title")
    assert classes.count() == 0 and N.pairs(classes, links).count() == 0


def test_no_broadcast_of_bands(spark):
    """Estimates of exploded rows are too low: no join on them may be left to the size estimate."""
    df = spark.createDataFrame([(i, text(70), None) for i in range(20)], "id bigint, text string, title string")
    classes, links = N.near_duplicates(df, "id", "text", "title")
    for plan in (links, N.pairs(classes, links)):
        assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
