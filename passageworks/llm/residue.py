"""Template residue, filler, error pages and script notices among real texts.

Method: weak labels come from response statuses and phrases
(:mod:`residue_labels`); a linear classifier with an L2 penalty is trained on
hashed n-grams, length and title features of sentences; it is validated on
hosts it has not seen; every sentence of every document is then scored by it,
and a document is a case if one of its sentences is.

Tokens are words, numbers, single ideographs and runs of one mark.  Their
hashes, the pairs of them, and sequences of three and four shapes (how a token
is written, and whether it touches the one before) are made for whole batches
at once, without a loop over tokens.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.llm.residue_judged import CASES, PROSE
from passageworks.llm.residue_labels import contrast, sentences, triggered, weak_label
from passageworks.session import cut_lineage

#: Size of the hashed feature space, as a power of two.
BITS = 18
#: Bounds of the labelled sample that the classifier is fitted on: documents read for it, and sentences kept.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES = 20_000, 40_000
#: One sentence of easy prose in so many is kept, and of prose with words that notices have too; one host in so many is held out.
EASY_EVERY, HARD_EVERY, HELD_OUT_EVERY = 24, 4, 5
#: Prose up to this length is all kept, since it is much like a notice.
SHORT_CHARS = 48
#: Probability from which a sentence is a case.
THRESHOLD = 0.5
#: Share of the loss that falls to cases, far rarer than prose, and that falls to the contrast sentences.
CASES_WEIGH, CONTRAST_WEIGHS = 0.12, 0.4
#: Characters of sentences that are scored at once.
SLICE_CHARS = 500_000

# ---------------------------------------------------------------- features

_SPACE, _LETTER, _DIGIT, _MARK, _IDEOGRAPH, _END = range(6)
_KNOWN = 1 << 17
#: Words that programs print for a missing value: they are shapes of their own.
_VALUES = ("none", "null", "undefined", "nan", "nil", "object", "na", "n", "a", "ref", "value", "xxxx", "xxx")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over all bits."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, case and hash of the lower-case form of every code point below ``_KNOWN``; once per process."""
    kind, case, lower = np.full(_KNOWN, _MARK, np.uint8), np.zeros(_KNOWN, np.uint8), np.arange(_KNOWN)
    for i in range(_KNOWN):
        c = chr(i)
        category = unicodedata.category(c)
        if category[0] in "LM":
            kind[i] = _IDEOGRAPH if 0x3040 <= i <= 0x30FF or 0x3400 <= i <= 0x9FFF or 0xF900 <= i <= 0xFAFF else _LETTER
            low = c.lower()
            case[i] = low != c
            lower[i] = ord(low) if len(low) == 1 else i
        elif category[0] == "N":
            kind[i] = _DIGIT
        elif category[0] in "ZC":
            kind[i] = _SPACE
    kind[0], kind[-1] = _END, _IDEOGRAPH  # all beyond the table is the last of it
    powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, _U))
    return kind, case, _mix(lower + 1), powers


def _word_hash(word: str) -> int:
    _, _, hashed, powers = _tables()
    return int((hashed[[ord(c) for c in word]] * powers[: len(word)]).sum(dtype=_U))


def features(parts: list[str], titles: list[int], alone: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence of each row, hashed columns in each row) of the sentences ``parts``.

    ``titles`` is 0 where the document has no title, 1 where the sentence holds
    it, else 2; ``alone`` says that the document is one sentence.
    """
    kind_of, case_of, hashed, powers = _tables()
    text = "\0" + "\0".join(x.replace("\0", " ") if "\0" in x else x for x in parts) + "\0"
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), _KNOWN - 1)
    kind = kind_of[code]
    begins = np.empty(len(code), bool)
    begins[0] = True
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _IDEOGRAPH) | (kind[1:] == _END) | (kind[1:] == _MARK) & (code[1:] != code[:-1])
    start = np.flatnonzero(begins)
    size = np.diff(start, append=len(code))
    of = np.cumsum(begins) - 1
    within = np.arange(len(code)) - start[of]
    word = np.add.reduceat(hashed[code] * powers[np.minimum(within, 63)], start)
    upper = np.add.reduceat(case_of[code].astype(np.int64), start)
    first_upper = case_of[code[start]]
    k, head = kind[start], code[start]

    # numbers count alike, but for the three digits of a status; runs of a mark count up to four
    status = (k == _DIGIT) & (size == 3) & ((head == ord("4")) | (head == ord("5")))
    number = (k == _DIGIT) & ~status
    word[number] = _mix(np.minimum(size[number], 5) + 1000)
    marks = k == _MARK
    word[marks] = _mix(head[marks].astype(np.int64) * 8 + np.minimum(size[marks], 4) + 1_000_000)
    # shapes
    shape = np.zeros(len(start), np.int64)
    letters = k == _LETTER
    shape[letters] = np.where(upper[letters] == 0, 1, np.where(upper[letters] == size[letters], np.where(size[letters] == 1, 2, 3), np.where((first_upper[letters] == 1) & (upper[letters] == 1), 4, 5)))
    shape[k == _DIGIT] = 6
    shape[status] = 7
    shape[k == _IDEOGRAPH] = 8
    shape[marks] = 100 + head[marks].astype(np.int64) * 8 + np.minimum(size[marks], 4)
    values = letters & np.isin(word, np.array([_word_hash(x) for x in _VALUES], _U))
    shape[values] += 10 + (word[values] % _U(1 << 20)).astype(np.int64) * 16 + (1 << 24)

    keep = k != _SPACE
    glued = np.r_[False, k[:-1] != _SPACE][keep]
    k, word, shape = k[keep], word[keep], shape[keep] * 2 + glued
    end = k == _END
    shape[end], word[end] = 98, _U(98)
    closes = np.flatnonzero(end)
    last = closes[np.maximum(np.cumsum(end) - 1 - end, 0)]  # the mark that the sentence of a token, or that it closes, begins with
    at = np.arange(len(k))
    place = at - last

    def back(values: np.ndarray, n: int) -> np.ndarray:
        return np.where(place >= n, values[np.maximum(at - n, 0)], values.dtype.type(0))

    s = shape.astype(_U)
    s1, s2, s3 = (back(s, n) for n in (1, 2, 3))
    lengths = np.diff(closes) - 1
    sentence = np.maximum(np.cumsum(end) - 1 - end, 0)
    own, first = np.unique(_mix(word) << _U(22) | sentence.astype(_U) & _U((1 << 22) - 1), return_index=True)
    distinct = np.bincount((own & _U((1 << 22) - 1)).astype(np.int64)[~end[first]], minlength=len(parts))
    ratio = np.where(lengths >= 6, distinct * 8 // np.maximum(lengths, 1), 9)
    # where the same words come over and over, each counts once
    kept = (ratio > 2)[sentence] | end
    kept[first] = True
    columns = np.empty((len(k), 4), _U)
    columns[:, 0] = word
    columns[:, 1] = back(word, 1) * _U(3) + word * _U(7) + _U(11)
    columns[:, 2] = (s2 * _U(1 << 21) + s1) * _U(1 << 21) + s + _U(1 << 62)
    columns[:, 3] = ((s3 * _U(1_000_003) + s2) * _U(1_000_003) + s1) * _U(1_000_003) + s + _U(1 << 61)
    # what closes a sentence carries what is known of all of it instead of a word
    bucket = np.minimum(np.log2(np.maximum(lengths, 1) + 1) * 2, 15).astype(np.int64)
    repeated = (lengths >= 6) & (distinct * 3 <= lengths)
    whole = 1 + (bucket * 2 + repeated) * 2 + np.asarray(alone, np.int64)
    columns[closes[1:], 0] = _mix(whole + (1 << 40))
    columns = (_mix(columns) >> _U(64 - BITS)).astype(np.int32)
    more = (np.asarray(titles, np.int64) * 16 + np.minimum(bucket, 9), 1000 + ratio, 2000 + ratio, 3000 + np.asarray(alone, np.int64) * 16 + np.minimum(bucket, 9))
    more = (_mix(np.stack(more, axis=1) + (1 << 41)) >> _U(64 - BITS)).astype(np.int32)
    kept[0] = False  # opens the first sentence and closes none
    return np.concatenate([sentence[kept], np.arange(len(parts))]), np.concatenate([columns[kept], more])


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n)


def _known_title(part: str, title: str | None) -> int:
    return 0 if not title else 1 if title in part else 2


# -------------------------------------------------------------- classifier


@dataclass
class ResidueModel:
    """Weights of the linear classifier, and how it did.

    ``precision`` and ``recall`` are those on ``held_out`` sentences of unseen
    hosts against the weak labels, ``judged_precision`` and ``judged_recall``
    those on ``judged`` sentences judged by hand, which no label and no
    training has seen.
    """

    weights: np.ndarray
    bias: float
    fitted_on: int = 0
    held_out: int = 0
    precision: float = 0.0
    recall: float = 0.0
    judged: int = 0
    judged_precision: float = 0.0
    judged_recall: float = 0.0

    def logits(self, parts: list[str], titles: list[int], alone: list[bool]) -> np.ndarray:
        if not parts:
            return np.zeros(0)
        at, columns = features(parts, titles, alone)
        total, rows = _sums(at, self.weights[columns].sum(axis=1), len(parts)), np.bincount(at, minlength=len(parts))
        return self.bias + total / np.sqrt(4 * rows)

    def scores(self, texts: list[str | None], titles: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """Probability of the worst sentence of each text, and that sentence; sentences are scored in slices."""
        worst, which = np.full(len(texts), -np.inf), [None] * len(texts)
        parts, own, named, alone, chars = [], [], [], [], 0

        def flush() -> None:
            nonlocal chars
            z = self.logits(parts, named, alone)
            by = np.lexsort((-z, own)) if parts else ()
            for i in by:
                if z[i] > worst[own[i]]:
                    worst[own[i]], which[own[i]] = z[i], parts[i]
            parts.clear(), own.clear(), named.clear(), alone.clear()
            chars = 0

        for i, (text, title) in enumerate(zip(texts, titles)):
            if not text:
                continue
            found = list(sentences(text))
            for part in found:
                parts.append(part)
                own.append(i)
                named.append(_known_title(part, title))
                alone.append(len(found) == 1)
                chars += len(part)
                if chars > SLICE_CHARS:
                    flush()
        flush()
        return 1 / (1 + np.exp(-np.clip(worst, -50, 50))), which


def _fit(parts: list[str], titles: list[int], alone: list[bool], labels: np.ndarray, made: np.ndarray, penalty: float = 2e-6, passes: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by accelerated gradient steps; cases and contrast sentences have fixed shares of the loss."""
    at, columns = features(parts, titles, alone)
    n = len(parts)
    scale = 1 / np.sqrt(4 * np.bincount(at, minlength=n))
    used, columns = np.unique(columns.ravel(), return_inverse=True)
    columns, at = columns.ravel(), np.repeat(at, 4)
    value = scale[at]
    share = np.ones(n)
    for is_made, part in ((True, CONTRAST_WEIGHS), (False, 1 - CONTRAST_WEIGHS)):
        for case, weight in ((True, CASES_WEIGH), (False, 1 - CASES_WEIGH)):
            mine = (made == is_made) & ((labels > 0) == case)
            share[mine] = part * weight / max(1, mine.sum())
    w, bias = np.zeros(len(used)), 0.0
    m, m_bias, second, second_bias = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for step in range(1, passes + 1):
        z = np.bincount(at, value * w[columns], n) + bias
        error = share * (1 / (1 + np.exp(-z)) - labels)
        g = np.bincount(columns, value * error[at], len(used)) + penalty * w
        g_bias = error.sum()
        m, m_bias = 0.9 * m + 0.1 * g, 0.9 * m_bias + 0.1 * g_bias
        second, second_bias = 0.99 * second + 0.01 * g * g, 0.99 * second_bias + 0.01 * g_bias**2
        rate, a, b = 0.1, 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / a) / (np.sqrt(second / b) + 1e-8)
        bias -= rate * (m_bias / a) / (np.sqrt(second_bias / b) + 1e-8)
    vector = np.zeros(1 << BITS)
    vector[used] = w
    return vector, float(bias)


def _measured(said: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    hits = int((said & truth).sum())
    return hits / max(1, int(said.sum())), hits / max(1, int(truth.sum()))


def _held_out(host: str | None) -> bool:
    return zlib.crc32((host or "").encode()) % HELD_OUT_EVERY == 0


def labelled_sample(df: DataFrame, key: str, text: str, title: str, host: str, documents: int = SAMPLE_DOCUMENTS, limit: int = SAMPLE_SENTENCES) -> DataFrame:
    """At most ``limit`` weakly labelled sentences from about ``documents`` documents, chosen by their hash.

    Sentences beside a case are no prose for certain, so that they get no label.
    """
    every = max(1, -(-df.count() // documents))
    rows = df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0) if every > 1 else df
    rows = rows.where(F.length(F.col(text)) > 0).select(F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title"), F.col(host).cast("string").alias("host"))
    schema = "sentence string, title int, host string, alone boolean, label int, h long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, named, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = list(sentences(value))
                labels = list(map(weak_label, parts))
                seed, beside = zlib.crc32(value.encode("utf-8", "replace")), 1 in labels
                for part, label in zip(parts, labels):
                    h = zlib.crc32(part.encode("utf-8", "replace"), seed)
                    if label is None or not label and (beside or len(part) > SHORT_CHARS and h % (HARD_EVERY if triggered(part) else EASY_EVERY)):
                        continue
                    out.append((part, _known_title(part, named), source, len(parts) == 1, label, h))
            if out:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["sentence", "title", "host", "alone", "label", "h"])

    return rows.mapInArrow(run, schema).orderBy("h", "sentence", "host").limit(limit)


def unlabelled(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: ``sentences`` of all texts, those of either label, and ``unclear``, those that get none and are neither trained nor measured on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [weak_label(part) for value in batch.column(0).to_pylist() if value for part in sentences(value)]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in (len(labels), labels.count(1), labels.count(0), labels.count(None))], ["sentences", "cases", "prose", "unclear"])

    counts = df.select(F.col(text).cast("string")).mapInArrow(run, "sentences long, cases long, prose long, unclear long")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])


def train(df: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", host: str = "source", documents: int = SAMPLE_DOCUMENTS, limit: int = SAMPLE_SENTENCES) -> ResidueModel:
    """Fits the classifier on the sample's hosts that are not held out and on the contrast sentences, and measures it on the hosts that are."""
    rows = labelled_sample(df, key, text, title, host, documents, limit).collect()  # bounded by ``limit``
    known = [r for r in rows if not _held_out(r["host"])]
    unseen = [r for r in rows if _held_out(r["host"])]
    prose, cases = contrast()
    made = [*prose, *cases]
    parts = [r["sentence"] for r in known] + made
    titles = [r["title"] for r in known] + [2 * (i % 2) for i in range(len(made))]
    alone = [r["alone"] for r in known] + [i % 3 == 0 for i in range(len(made))]
    labels = np.array([r["label"] for r in known] + [0] * len(prose) + [1] * len(cases), float)
    weights, bias = _fit(parts, titles, alone, labels, np.arange(len(parts)) >= len(known))
    model = ResidueModel(weights, bias, len(parts), len(unseen), judged=len(CASES) + len(PROSE))
    if unseen:
        said = model.logits([r["sentence"] for r in unseen], [r["title"] for r in unseen], [r["alone"] for r in unseen]) > 0
        model.precision, model.recall = _measured(said, np.array([r["label"] for r in unseen]) > 0)
    said, _ = model.scores([*CASES, *PROSE], ["Title"] * model.judged)
    model.judged_precision, model.judged_recall = _measured(said >= THRESHOLD, np.arange(model.judged) < len(CASES))
    return model


def score_documents(df: DataFrame, model: ResidueModel, key: str = "doc_id", text: str = "text", title: str = "title", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``df``: key, ``probability`` of its worst sentence, ``sentence`` itself, and ``is_residue``.

    Null, empty and blank texts have probability 0 and no sentence.  Repeated
    rows each keep theirs, null keys stay null, texts are read whole, an empty
    table gives an empty table; other columns are left out whatever their
    names.  The weights are broadcast (a fixed 2 MB); no shuffle.
    """
    schema = T.StructType([df.schema[key], T.StructField("probability", T.DoubleType()), T.StructField("sentence", T.StringType()), T.StructField("is_residue", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, which = shared.value.scores(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            p = np.where([x is None for x in which], 0.0, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(which, pa.string()), pa.array(p >= threshold, pa.bool_())], schema.names)

    return df.select(F.col(key), F.col(text).cast("string").alias("__text"), F.col(title).cast("string").alias("__title")).mapInArrow(run, schema)


def find_residue(df: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", host: str = "source") -> DataFrame:
    """The rows that carry residue: key, probability and the sentence that shows it."""
    model = train(df, key, text, title, host)
    return score_documents(df, model, key, text, title).where("is_residue").drop("is_residue")


def exclude_residue(df: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", host: str = "source") -> DataFrame:
    """``df`` without the documents that carry residue; rows with a null key are kept."""
    found = cut_lineage(find_residue(df, key, text, title, host).select(F.col(key).alias("__key")).distinct())
    return df.join(found, df[key] == F.col("__key"), "left_anti")
