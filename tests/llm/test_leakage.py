import random

import numpy as np

from webloom.llm import leakage as L

random.seed(3)
WORDS = [f"w{i}" for i in range(400)]


def words(n):
    return [random.choice(WORDS) for _ in range(n)]


def test_words():
    assert L.words_of("Ka­geard’s CAFÉ, x_y-2!") == ["kageard", "s", "café", "x", "y", "2"] and L.words_of(None) == L.words_of(" ") == []
    assert L.words_of("ｆｕｌｌ​ width") == ["full", "width"]


def test_edit_distance():
    assert [L.edit_distance(list("kitten"), list(b), 3) for b in ("kitten", "sitting", "zzzzzz")] == [0, 3, 4]
    assert L.edit_distance(list("ab"), list("abc"), 0) == 1


def test_equal_windows_have_equal_keys():
    x = L.symbols(words(40))
    y = np.concatenate((L.symbols(words(7)), x[5:17], L.symbols(words(9))))
    assert L.window_keys(x, np.array([5]), 12, 0, 36) == L.window_keys(y, np.array([7]), 12, 0, 36)


def test_found(spark):
    items = [(i, " ".join(words(random.randint(8, 60)))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for k in range(120):
        body = words(random.randint(0, 150))
        if k % 3 == 0:
            source = items[random.randrange(30)][1].split()
            n = random.choice([5, 11, 12, 13, 40])
            body[7:7] = [w.upper() + "," for w in source[:n]]
        docs.append((k, " ".join(body), "clash"))
    docs += [(500, None, None), (501, "", None), (0, docs[0][1], None), (502, items[0][1] + " " + "pad " * 300_000, None)]
    index = {}
    for i, t in items:
        w = L.words_of(t)
        for k in range(len(w) - 11):
            index.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t, _ in docs for w in [L.words_of(t)] for k in range(len(w) - 11) for i in index.get(tuple(w[k : k + 12]), ())}
    left, right = spark.createDataFrame(docs, "doc_id bigint, text string, item string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in L.leaks(left, "doc_id", "text", right, "item_id", "text").collect()} == want
    for empty in (left.limit(0), left):
        assert L.leaks(empty, "doc_id", "text", right.limit(0), "item_id", "text").count() == 0


def test_recall_with_edits(spark):
    """Random substitutions, insertions and deletions within the bound, against edit distance itself."""
    for edits in (1, 2, 3):
        rng = np.random.default_rng(edits)
        items, docs = [(i, " ".join(words(12))) for i in range(60)], []
        for i, text in items:
            w, left = text.split(), edits
            while left:
                k = int(rng.integers(0, len(w)))
                if left >= 2 and rng.random() < 0.6:
                    w.insert(k, f"zz{left}")
                    del w[int(rng.integers(0, len(w)))]
                    left -= 2
                else:
                    w[k] = f"yy{left}"
                    left -= 1
            assert L.edit_distance(text.split(), w, edits) <= edits
            docs.append((i, " ".join(words(20) + w + words(20))))
        left, right = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        got = {tuple(r) for r in L.leaks(left, "doc_id", "text", right, "item_id", "text", max_edits=edits, recall=0.95).collect()}
        assert sum((i, i) in got for i in range(60)) >= 0.9 * 60, edits
        texts, tokens = dict(docs), dict(items)
        for d, i in got:
            w = texts[d].split()
            assert min(L.edit_distance(tokens[i].split(), w[k : k + 12], edits) for k in range(len(w) - 11)) <= edits


def test_many_items(spark, monkeypatch):
    """A join by shuffle gives the same."""
    items = [(i, " ".join(words(20))) for i in range(50)]
    docs = [(i, " ".join(words(9) + t.split()[4:18])) for i, t in items if i % 2]
    left, right = spark.createDataFrame(docs, "d string, t string"), spark.createDataFrame(items, "i bigint, t string")
    want = {(str(i), i) for i, _ in docs}
    for windows in (L.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(L, "BROADCAST_WINDOWS", windows)
        assert {tuple(r) for r in L.leaks(left, "d", "t", right, "i", "t").collect()} == want
