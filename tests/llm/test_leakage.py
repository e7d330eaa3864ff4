import re

from hypothesis import given, settings
from hypothesis import strategies as st

from passageworks.llm import leakage as L


def plain(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def shares(text, item, n):
    a, b = plain(text), plain(item)
    windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in windows for i in range(len(a) - n + 1))


WORDS = st.lists(st.sampled_from(["a", "B", "c", "Ω", "日", "x1", "İ", "ΟΔΟΣ"]), max_size=30).map(lambda w: " ,".join(w))


@settings(max_examples=500, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=3), st.integers(1, 5))
def test_against_brute_force(text, items, n):
    found = L.LeakIndex(enumerate(items), n).find(text)
    assert set(found) == {i for i, item in enumerate(items) if shares(text, item, n)}
    for spans in found.values():
        assert all(len(plain(text[a:b])) == count >= n for a, b, count in spans)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def tables(spark):
    docs = [(1, f"Before. {ITEM.upper().replace(' ', ' -- ')}! After."), (2, None), (3, ""), (4, ITEM[:-18]), (5, "x " * 100_000 + ITEM), (5, "x " * 100_000 + ITEM), (None, ITEM), (7, ITEM.replace("seven", "sev_en")), (8, f"{ITEM} and again {ITEM}")]
    items = [(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (4, "nothing of this kind is in any of the documents here at all today")]
    return spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, words string"), spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, doc_id int")


def test_table(spark):
    docs, items = tables(spark)
    for words in (10**6, 5):
        got = [(r["doc_id"], r["item_id"], r["words"]) for r in L.find_leaks(docs, items, block_words=words).collect()]
        assert sorted(got, key=repr) == sorted([(1, 1, 14), (4, 1, 12), (5, 1, 14), (5, 1, 14), (None, 1, 14), (8, 1, 14)], key=repr)
    assert L.find_leaks(docs.limit(0), items).count() == 0 and L.find_leaks(docs, items.limit(0)).count() == 0
    same = L.find_leaks(docs, items.withColumnRenamed("doc_id", "z").withColumnRenamed("item_id", "doc_id"), item_key="doc_id")
    assert same.columns[:2] == ["doc_id", "item_doc_id"] and same.count() == 6


def test_removal(spark):
    docs, items = tables(spark)
    clean = L.remove_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert L.find_leaks(clean, items).count() == 0  # rows with a null key too
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[1] == "Before.  ! After." and texts[2] is None and texts[7] == ITEM.replace("seven", "sev_en") and texts[8] == "  and again  "
    left = sorted((r["doc_id"] for r in L.remove_leaks(docs, items, whole_documents=True).collect()), key=repr)
    assert left == [2, 3, 7]


def test_repeated_keys_are_cut_by_their_own_spans(spark):
    docs, items = tables(spark)
    rows = spark.createDataFrame([(1, f"a {ITEM} b"), (1, "words that nobody has leaked and that must stay where they are, every one of them"), (1, f"{ITEM} c")], "doc_id long, text string")
    for words in (10**6, 5):
        got = sorted(r["text"] for r in L.remove_leaks(rows, items, block_words=words).collect())
        assert got == ["  c", "a   b", "words that nobody has leaked and that must stay where they are, every one of them"]
