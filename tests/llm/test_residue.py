import numpy as np
import pytest

from passageworks.llm import residue as R
from passageworks.llm.residue_judged import CASES as JUDGED_CASES
from passageworks.llm.residue_judged import PROSE as JUDGED_PROSE
from passageworks.llm.residue_labels import NOTICES, PROSE, sentences, weak_label

CASES = ["Please allow JavaScript on this page.", "HTTP error 404", "503 Service Unavailable", "Zugriff verweigert", "Lorem ipsum dolor sit amet, consectetur elit.", "Hello {{ last_name }}, we got your form.", "Heading: undefined", "At null the quay of null sold null boats.", "hey hey hey hey hey hey hey hey", "Name: ______  Street: ______"]
LOGS = ["2023-01-05 10:12:44 [ERROR] worker=3 took_ms=12.5", "2021-11-30T08:00:01 [INFO] rows=120 bytes=4096"]


def test_weak_labels():
    assert [weak_label(x) for x in CASES] == [1] * len(CASES)
    assert all(weak_label(x) != 1 for x in (*PROSE, *LOGS))


def test_phrases_inside_longer_sentences_abstain():
    for x in ("The words “Page not found” appeared on 12 of the 30 screens.", "Typesetters like lorem ipsum as dummy text since nobody stops to read it.", "The template for {{company}} starts on {{date}}.", "Your `badge` at {{company}} waits.", "The slots are for ${name} := ${other}.", "The [old] mill", "[WARN]"):
        assert weak_label(x) is None
    assert weak_label("Your job at {{company}} starts on {{date}}.") == 1


def test_judged_sentences_are_apart_from_training():
    prose, cases = R.contrast()
    assert not {*prose, *cases, *NOTICES} & {*JUDGED_CASES, *JUDGED_PROSE}


def test_unclear_sentences_are_counted(spark):
    texts = ["The template for {{company}} starts on {{date}}.", "404 Not Found", "The mill was sold.", None, ""]
    got = R.unlabelled(spark.createDataFrame([(x,) for x in texts], "text string")).first()
    assert tuple(got) == (3, 1, 1, 1)


def test_sentences_cover_the_whole_text():
    text = "One. Two!\nThis line is long enough. It is split 東西。南北。 " + "x" * 5000 + " end"
    parts = list(sentences(text))
    assert parts[:5] == ["One. Two!", "This line is long enough.", "It is split 東西。", "南北。", "x" * 600] and parts[-1].endswith("end")
    assert list(sentences("")) == list(sentences(" \n　")) == []


def test_features_do_not_depend_on_the_batch():
    """Every sentence has the same features alone and among others: none crosses a border."""
    parts = ["Hello {{ name }}!", "東西 2024", "a", "…", "word " * 9, "x" * 600, "The end"]
    at, columns = R.features(parts, [0, 1, 2, 0, 1, 2, 0], [False] * 7)
    for i, part in enumerate(parts):
        _, alone = R.features([part], [[0, 1, 2, 0, 1, 2, 0][i]], [False])
        assert sorted(map(tuple, columns[at == i])) == sorted(map(tuple, alone))


def test_training_separates():
    prose = [x for x in PROSE[:40]]
    labels = np.array([1.0] * len(CASES) + [0.0] * len(prose))
    parts = [*CASES, *prose]
    weights, bias = R._fit(parts, [0] * len(parts), [False] * len(parts), labels, np.zeros(len(parts), bool))
    p, _ = R.ResidueModel(weights, bias).scores(parts, [None] * len(parts))
    assert ((p > 0.5) == (labels > 0)).all()


@pytest.fixture(scope="module")
def corpus(spark):
    filler = [f"{a} of {b} was {c} in {y}. It stands near {b} and {d}." for y, (a, b, c, d) in enumerate([(a, b, c, d) for a in ("The mill", "The dam", "A bridge") for b in ("Leeds", "Kiel", "Oldham", "Brno") for c in ("built", "sold", "moved") for d in ("the river", "a wood", "the sea")], 1800)]
    texts = filler + CASES + [f"{filler[i]}\n\n{x}" for i, x in enumerate(CASES)] + LOGS * 3 + list(PROSE[:20])
    rows = [(i, x, "Title" if i % 3 else None, f"host{i % 11}", "clash") for i, x in enumerate(texts)]
    rows += [(9001, None, "t", None, ""), (9002, "", None, "h", ""), (9003, " \n ", "t", "h", ""), (None, CASES[0], "t", "h", ""), (9004, "word " * 60_000 + CASES[0], "t", "h", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, title string, source string, probability string"), len(filler)


def test_corpus(spark, corpus):
    df, n = corpus
    found = sorted((r["doc_id"] for r in R.find_residue(df).collect()), key=repr)
    cases = {*range(n, n + 2 * len(CASES)), None, 9004}
    assert len(set(found) & cases) >= 0.95 * len(cases) and len(set(found) - cases) <= 1 and not {9001, 9002, 9003} & set(found)
    left = R.exclude_residue(df)
    assert left.columns == df.columns and left.where("doc_id = 9001 OR doc_id IS NULL").count() == 2
    assert R.find_residue(df.limit(0)).count() == 0


def test_held_out_hosts(spark, corpus):
    model = R.train(corpus[0])
    assert model.held_out > 0 and model.recall >= 0.8 and model.precision >= 0.8
    assert model.judged == len(JUDGED_CASES) + len(JUDGED_PROSE) and model.judged_precision >= 0.9 and model.judged_recall >= 0.5
    rows = R.labelled_sample(corpus[0], "doc_id", "text", "title", "source", limit=10)
    assert rows.count() == 10
