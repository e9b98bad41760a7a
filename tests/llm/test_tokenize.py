"""Byte-level BPE: round trips, and the ids of an independent encoder."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symtide.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{T.VOCABULARIES}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return T.read_ranks(T._file("byte_bpe_50k.tiktoken", None))


@pytest.fixture(scope="module")
def both(ranks):
    return T.BytePairEncoder(ranks), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80))
def test_random_texts(both, text):
    bpe, other = both
    ids = bpe.encode(text)
    assert ids == other.encode_ordinary(text) and bpe.decode(ids) == text


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "it's  we'll\n\n x", "a" * 20_000, "ab" * 9_000, "日本語 тест ✅ 👩‍💻", " " * 500 + "x", "x" + "́" * 300])
def test_cases(both, text):
    bpe, other = both
    assert bpe.encode(text) == other.encode_ordinary(text)


def test_operator(spark, clash):
    df = clash(spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (3, "hello world")], "doc_id long, text string"))
    got = T.encode(df)
    assert got.schema["ids"].dataType.simpleString() == "array<int>"
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == [(1, (31373, 995)), (2, ()), (3, ()), (3, (31373, 995))]
    assert {r["text"] for r in T.decode(got).collect()} == {"hello world", ""}
    assert T.encode(df.limit(0)).count() == 0


def test_small_memory(ranks):
    bpe = T.BytePairEncoder(ranks, remembered=2)
    assert bpe.encode("one two three one two three") == T.BytePairEncoder(ranks).encode("one two three one two three")
