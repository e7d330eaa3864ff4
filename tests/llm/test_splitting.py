from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passageworks.llm.splitting import split_oversized, split_spans


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab .\n\r。！日́‍🏰👍🏽🇩🇪　"), max_size=200), st.integers(1, 40), st.integers(0, 39))
def test_round_trip(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            split_spans(text, size, overlap)
        return
    spans = split_spans(text, size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= size for a, b, _ in spans)
    assert all(c == b - overlap and d > b for (_, b, _), (c, d, _) in pairwise(spans))
    assert text[: spans[0][1]] + "".join(text[b:d] for (_, b, _), (_, d, _) in pairwise(spans)) == text


def pieces(text, size, overlap=0):
    return [text[a:b] for a, b, _ in split_spans(text, size, overlap)]


def test_natural_boundaries():
    assert pieces("One two. Three four.\n\nFive six. Seven.", 22) == ["One two. Three four.\n\n", "Five six. Seven."]
    assert pieces("One two. Three four. Five.", 21) == ["One two. Three four. ", "Five."]
    assert pieces("alpha beta gamma", 11) == ["alpha beta ", "gamma"]
    assert pieces("東西。南北！中", 4) == ["東西。", "南北！中"]
    assert pieces("x" * 10, 4) == ["xxxx", "xxxx", "xx"]
    assert pieces("👩‍🔬👩‍🔬", 4) == ["👩‍🔬", "👩‍🔬"]
    assert pieces("é" * 3, 3) == ["é"] * 3
    assert pieces("abcdef ghi", 5, 2)[1].startswith(pieces("abcdef ghi", 5, 2)[0][-2:])


def test_table(spark):
    long = "word " * 40_000
    rows = [("a", "short", 10, 0), ("b", None, 10, 0), ("c", "", 10, 0), ("d", "x" * 25, 10, 5), ("d", "x" * 25, 10, 5), (None, "y" * 11, 10, 0), ("e", "z", 5, 5), ("f", "z", None, 0), ("g", long, 512, 64), ("h", "🏰" * 10, 10, 0)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "chunk_id string, text string, chunk_size int, chunk_overlap int, piece string, start int")
    got = split_oversized(df).collect()
    by = lambda k: sorted((r["piece_idx"], r["piece"], r["status"]) if r["piece_idx"] is not None else (None, r["piece"], r["status"]) for r in got if r["chunk_id"] == k)
    assert by("a") == [(0, "short", "whole")] and by("c") == [(0, "", "whole")] and by("h")[0][2] == "whole"
    assert by("b") == [(None, None, "null_text")] and by("e") == by("f") == [(None, None, "bad_config")]
    assert [p for _, p, _ in by("d")] == ["x" * 10] * 8 and by(None) == [(0, "y" * 10, "split"), (1, "y", "split")]
    g = sorted((r["start"], r["end"], r["piece"], r["n_pieces"]) for r in got if r["chunk_id"] == "g")
    assert all(len(p) <= 512 and p == long[a:b] for a, b, p, _ in g) and len(g) == g[0][3]
    assert split_oversized(df.limit(0)).count() == 0
