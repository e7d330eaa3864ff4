"""Text and vector expressions against plain Python."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passageworks.functions import text as T
from passageworks.functions import vectors as V

SPACES = ["\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", "　", " "]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_strip_and_normalise_know_every_white_space(spark):
    values = [f"{s}a{s}{s}B{s}" for s in SPACES] + ["", " ", None, "x"]
    assert column(spark, values, T.strip("x")) == [v.strip() if v is not None else None for v in values]
    assert column(spark, values, T.normalise("x")) == [re.sub(r"\s+", " ", v.lower().strip()) if v is not None else None for v in values]


def test_blank_and_null_like(spark):
    values = [None, "", " \n", "　", "null", " NaN ", "N/A", "none", "text", "nulls"]
    assert column(spark, values, T.blank("x")) == [v is None or not v.strip() for v in values]
    assert column(spark, values, T.null_like("x")) == [True] * 8 + [False, False]


def test_exact_match_keeps_inner_double_spaces(spark):
    rows = spark.createDataFrame([("a - b", "a b"), ("The Cat!", " the cat"), ("x", None), ("", "")], "p string, g string")
    assert [r[0] for r in rows.select(T.exact_match("p", "g")).collect()] == [0.0, 1.0, None, 1.0]


def test_has_answer_ignores_null_answers(spark):
    rows = spark.createDataFrame([("The  Red\nMill", ["red mill"]), ("x", [None]), ("x", []), ("x", None), (None, ["a"]), ("x", [""])], "t string, a array<string>")
    assert [r[0] for r in rows.select(T.has_answer(F.coalesce("t", F.lit("")), "a")).collect()] == [True, False, False, False, False, True]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_bit_parallel_lcs(a, b):
    assert T._lcs(a, b) == lcs(a, b)


def test_rouge_l(spark):
    assert T.rouge_l("", "a") == T.rouge_l(None, None) == 0.0
    assert T.rouge_l("the cat sat", "the cat ran", stem=False) == pytest.approx(2 / 3)
    assert T.rouge_l("running dogs", "run dog") == 1.0  # words of up to three letters are their own stems
    rows = spark.createDataFrame([(1, "a b c", "a c"), (2, None, "x"), (3, "long " * 5000, "long " * 5000)], "k int, p string, g string")
    assert [r["rouge_l"] for r in T.rouge_l_scores(rows, ["k"], "p", "g").orderBy("k").collect()] == pytest.approx([0.8, 0.0, 1.0])


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_stems(word, stem):
    assert T.porter(word) == stem


def test_prompt(spark):
    rows = spark.createDataFrame([("q", ["a", None]), (None, [])], "q string, c array<string>")
    first, second = (r[0] for r in rows.select(T.prompt("q", "c")).collect())
    assert first == T.PROMPT_HEAD + "[1] a\n\n[2] \n\nQuestion: q\n\nAnswer:"
    assert second == T.PROMPT_HEAD + "\n\nQuestion: \n\nAnswer:"


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = rows.select(V.norm("a"), V.unit("a"), V.cosine("a", "b"), V.squared_distance("a", "b"), V.score(V.cosine("a", "b"), "cosine")).collect()
    assert got[0][0] == 5 and got[0][1] == [0.6, 0.8] and got[0][2] == pytest.approx(0.96) and got[0][3] == 2
    assert got[1][1] == [0.0, 0.0] and got[1][2] == 0 and got[1][4] == 0.5


def test_invalid_vectors(spark):
    values = [[1.0, 2.0], None, [1.0], [1.0, math.nan], [1.0, math.inf], [1.0, None], [0.0, 0.0]]
    assert column(spark, values, V.invalid("x", 2), "array<float>") == [False, True, True, True, True, True, False]
