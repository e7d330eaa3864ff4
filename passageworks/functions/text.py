"""Text expressions with the white-space and comparison rules of the evaluation data, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as a class of a regular expression (Java and RE2 alike).
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that stand for no text, and answers a CSV reader takes for null.
NULL_LIKE = ["null", "none", "nan", "n/a", "na", ""]
NA_VALUES = ["None", "NA", "null", "n/a", "nan", "N/A", "NaN", "#N/A", "<NA>", "NULL", ""]


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Without white space of any script at either end; null stays null."""
    return F.regexp_replace(_column(text), rf"^{WHITE}+|{WHITE}+\z", "")


def normalise(text: Column | str) -> Column:
    """Lower case, stripped, every run of white space one space."""
    return F.regexp_replace(strip(F.lower(_column(text))), rf"{WHITE}+", " ")


def bare(text: Column | str) -> Column:
    """``normalise`` and then no punctuation; spaces around it stay, so "a - b" keeps two."""
    return F.regexp_replace(normalise(text), r"[^\p{L}\p{N}_ ]", "")


def blank(text: Column | str) -> Column:
    """True for null and blank texts."""
    return F.coalesce(strip(text) == "", F.lit(True))


def null_like(text: Column | str) -> Column:
    return F.coalesce(F.lower(strip(text)).isin(NULL_LIKE), F.lit(True))


def not_available(value: Column | str) -> Column:
    """The value, or null where a CSV reader would read a missing value."""
    return F.when(~_column(value).isin(NA_VALUES), _column(value))


def exact_match(prediction: Column | str, gold: Column | str) -> Column:
    return (bare(prediction) == bare(gold)).cast("double")


def has_answer(text: Column | str, answers: Column | str, normalised: bool = False) -> Column:
    """Whether the normalised text contains any normalised answer; null answers count for nothing.

    ``normalised`` says that the answers are so already, which saves the work for every text.
    """
    own, same = normalise(text), (lambda a: a) if normalised else normalise
    return F.coalesce(F.exists(F.filter(answers, lambda a: a.isNotNull()), lambda a: F.contains(own, same(a))), F.lit(False))


def metadata_of(df: DataFrame, text: str, name: str = "metadata") -> DataFrame:
    """``text`` and a map of all other columns, as texts; null columns are not in it."""
    others = [c for c in df.columns if c != text]
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in others]) if others else F.array().cast("array<struct<key:string,value:string>>")
    return df.select(F.col(text), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias(name))


def words(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(_column(text)), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def rouge_l_scores(df: DataFrame, keys: list[str], prediction: str, gold: str, stem: bool = True) -> DataFrame:
    """Keys and ``rouge_l``: the F measure of the longest common subsequence, by Arrow batches.

    Null counts as empty; either side empty gives 0.  Words over three letters
    are stemmed if ``stem``.  The time is the product of the two lengths over
    the machine's word size (bit-parallel), so long texts do no harm.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [rouge_l(p, g, stem) for p, g in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], [*keys, "rouge_l"])

    schema = df.select(*keys).withColumn("rouge_l", F.lit(0.0)).schema
    return df.select(*keys, F.col(prediction).cast("string").alias("__p"), F.col(gold).cast("string").alias("__g")).mapInArrow(run, schema)


def rouge_l(prediction: str | None, gold: str | None, stem: bool = True) -> float:
    import re

    a, b = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (prediction, gold))
    if stem:
        a, b = ([porter(w) if len(w) > 3 else w for w in x] for x in (a, b))
    if not a or not b:
        return 0.0
    common = _lcs(a, b)
    return 2 * common / (len(a) + len(b))


def _lcs(a: list[str], b: list[str]) -> int:
    """Bit-parallel: one bit per word of ``a``, one step per word of ``b``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for w in b:
        matches = places.get(w, 0) & row
        row = (row + matches | row - matches) & whole
    return len(a) - row.bit_count()


# ------------------------------------------------------------------ stemming
# The suffix rules of Porter's published algorithm.

_STEP_2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP_4 = ("ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of an English word by Porter's algorithm."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and "v" in _shape(w[: -len(x)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP_2, _STEP_3):
        found = max((x for x in rules if w.endswith(x)), key=len, default=None)
        if found and _measure(w[: -len(found)]) > 0:
            w = w[: -len(found)] + rules[found]
    found = next((x for x in sorted(_STEP_4, key=len, reverse=True) if w.endswith(x)), None)
    if found and _measure(w[: -len(found)]) > 1 and (found != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(found)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# The wording around passages and question in a prompt.
PROMPT_HEAD = "Answer the question using only the context below. Cite sources as [1], [2] etc.\n\nContext:\n"
PROMPT_QUESTION, PROMPT_TAIL = "\n\nQuestion: ", "\n\nAnswer:"


def prompt(question: Column | str, chunks: Column | str) -> Column:
    """The question after its numbered passages (an array of texts); nulls count as empty."""
    numbered = F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c, F.lit(""))))
    context = F.coalesce(F.array_join(numbered, "\n\n"), F.lit(""))
    return F.concat(F.lit(PROMPT_HEAD), context, F.lit(PROMPT_QUESTION), F.coalesce(_column(question), F.lit("")), F.lit(PROMPT_TAIL))


def preview(text: Column | str, length: int = 80) -> Column:
    return F.replace(F.substring(_column(text), 1, length), F.lit("\n"), F.lit(" "))
