import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passageworks.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    raw = open(tokens.default_vocabulary(), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tokens.ForcedBoundaryEncoder(raw, tokens.split_pattern()), tiktoken.Encoding("own", pat_str=tokens.split_pattern(), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("ab1 '!.\n\t　\xa0\x1c\x85日é́​🏰stdre"), max_size=40)))
def test_equal_to_encoding_at_once(both, text):
    own, whole = both
    assert own.encode(text) == whole.encode_ordinary(text)


def test_pairs_that_no_token_holds_are_cuts(both):
    own, whole = both
    assert own.space_cuts
    long = "日本語" * 3000 + "x" * 20_000 + "<|endoftext|>" + "!?" * 5000
    assert own.encode(long) == whole.encode_ordinary(long)


def test_table(spark, both):
    texts = [None, "", "   ", "a b", "a b", "long " * 50_000, "<|endoftext|>", "\n\nx  y"]
    df = spark.createDataFrame([(i if i != 3 else None, t, [1], "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, __x string")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_corpus(df).collect()]
    assert len(got) == len(texts)
    assert sorted(got, key=repr) == sorted(((i if i != 3 else None, both[1].encode_ordinary(t or "")) for i, t in enumerate(texts)), key=repr)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_other_vocabulary_and_its_bound(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Grüße 日本")], "doc_id long, text string")
    assert tokens.encode_corpus(df, vocabulary=tokens.default_vocabulary("byte_bpe_multi_50k.tiktoken")).first()["ids"]
    monkeypatch.setattr(tokens, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        tokens.encode_corpus(df)
