import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no rank file")


@pytest.fixture(scope="module")
def other():
    """The same vocabulary in another library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


texts = st.text(max_size=60) | st.text(st.sampled_from(" \n\t'sédrеж快。12!?<|endoftext|>­́"), max_size=80)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_same_as_other_library(other, text):
    assert T.encode(text) == other.encode(text, add_special_tokens=False).ids
    assert T.decode(T.encode(text)) == text


@given(texts, st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_cuts_change_nothing(text, size):
    assert "".join(T.pieces(text, size)) == text
    assert [i for p in T.pieces(text, size) for i in T.encode(p)] == T.encode(text)


def test_edges(spark):
    long = "It's 12 o'clock,  快照 of the day.\n" * 20_000
    rows = [(1, "a b"), (2, ""), (3, None), (4, long), (None, "a b"), (1, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as key")
    got = T.token_ids(df, "doc_id", "text").collect()
    assert len(got) == 6 and sorted(len(r["ids"]) for r in got)[:2] == [0, 0] and T.decode(next(r["ids"] for r in got if r["doc_id"] == 4)) == long
    assert T.token_ids(df.limit(0), "doc_id", "text").count() == 0
