"""Operators of the core against brute force and on awkward rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageworks.operators import answers, chunking, evaluate, generate, index, ingest, rerank, retrieval, store, telemetry
from passageworks.operators.regular_grid import regular_grid
from passageworks.sources import readers
from passageworks.streaming.ingest import ingest_passages, resume_state

# ------------------------------------------------------------------ chunkers


def fixed(text, size, overlap):
    out, start, i = [], 0, 0
    while text:
        piece = text[start : start + size].strip()
        if piece:
            out.append((i, piece))
        if start + size >= len(text):
            break
        start, i = start + size - overlap, i + 1
    return out


def test_fixed_chunks(spark):
    texts = ["a" * n for n in range(25)] + [None, "   ", "ab   cd" * 3, "日本🏰" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for size, overlap in ((7, 0), (7, 3), (1, 0), (30, 29)):
        got = sorted((r["k"], r["chunk_idx"], r["chunk_text"]) for r in chunking.chunk_fixed(rows, "k", "t", size, overlap).collect())
        assert got == sorted((k, i, p) for k, t in enumerate(texts) for i, p in fixed(t or "", size, overlap))
    with pytest.raises(ValueError):
        chunking.chunk_fixed(rows, "k", "t", 5, 5)


# ----------------------------------------------------------------- retrieval


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("block", [3, 1000])
def test_dense_topk(spark, metric, block):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties and zero vectors
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in retrieval.dense_topk(rows.where("vec_id % 6 = 0"), rows, 5, metric, query_block=block).collect():
        got.setdefault(r["qid"], []).append((r["rk"], r["did"], r["score"]))
    for q in range(0, 60, 6):
        s = retrieval.similarity(x[q : q + 1], x, metric)[0]
        score = (s + 1) / 2 if metric == "cosine" else s if metric == "dot" else 1 / (1 - s)
        best = sorted((-round(v, 9), i) for i, v in enumerate(score) if i != q)[:5]
        assert [(i, pytest.approx(-v)) for v, i in best] == [(d, s) for _, d, s in sorted(got[q])]


def test_dense_topk_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert retrieval.dense_topk(none, some, 3).count() == 0
    assert retrieval.dense_topk(some, none, 3).count() == 0


def test_ivf_with_every_cell_probed_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((80, 8)))], "vec_id long, embedding array<float>")
    cells = index.train_cells(rows, 5)
    asked = rows.where("vec_id % 20 = 0")
    found = index.ivf_search(asked, index.build_ivf(rows, cells), cells, 5, 5)
    assert index.recall_at(retrieval.dense_topk(asked, rows, 5), found).first()[0] == 1.0


def test_probes_are_chosen_for_the_recall(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 16)))], "vec_id long, embedding array<float>")
    cells = index.train_cells(rows, 12)
    asked, stored = rows.where("vec_id % 20 = 0"), index.build_ivf(rows, cells)
    exact = retrieval.dense_topk(asked, rows, 5)
    measured = index.recall_by_probes(exact, asked, stored, cells)
    assert len(measured) == 12 and measured == sorted(measured) and measured[-1] == 1.0
    nprobe = index.choose_nprobe(rows.where("vec_id % 20 <> 0"), stored, cells, 5, 0.92)
    assert 3 < nprobe < 12
    for n in (3, nprobe):
        assert index.recall_at(exact, index.ivf_search(asked, stored, cells, 5, n)).first()[0] == pytest.approx(measured[n - 1])
    assert measured[nprobe - 1] >= 0.85 > measured[2]


@pytest.mark.parametrize("metric", retrieval.METRICS)
def test_every_index_type_uses_its_metric(spark, metric):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 8)) * rng.uniform(0.2, 5, (200, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 20 = 0")
    exact = retrieval.dense_topk(asked, rows, 5, metric)
    for kind, least in (("flat", 1.0), ("ivf_flat", 1.0), ("ivf_sq", 0.8), ("ivf_pq", 0.6)):
        config = index.IndexConfig(8, metric, kind, nlist=3, nprobe=3, m_pq=4, nbits_pq=6)
        stored, cells, quantiser = index.build_index(rows, config)
        assert ("embedding" in stored.columns) == (quantiser is None)
        assert index.recall_at(exact, index.search_index(asked, stored, cells, quantiser, config, 5)).first()[0] >= least


def test_sq8_error_is_at_most_half_a_step(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 4))
    x[:, 3] = 7.0  # a constant dimension
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    coded = index.sq8_encode(rows, index.sq8_ranges(rows)).select("embedding", index.sq8_decode().alias("y")).collect()
    step = (x.max(0) - x.min(0)) / 255
    assert all((np.abs(np.array(r["embedding"]) - np.array(r["y"])) <= step + 1e-9).all() for r in coded)


def test_index_config_and_round_trip(spark, tmp_path):
    with pytest.raises(ValueError):
        index.IndexConfig(64, index_type="hnsw")
    with pytest.raises(ValueError):
        index.IndexConfig(64, index_type="ivf_pq", m_pq=7)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    cells = index.train_cells(rows, 3)
    index.save_index(index.build_ivf(rows, cells), cells, index.IndexConfig(2, nlist=3, embedder_name="a"), str(tmp_path))
    stored, centroids, config = index.load_index(spark, str(tmp_path))
    assert stored.count() == 20 and centroids.count() == 3 and config.nlist == 3 and not config.enough_to_train(20)
    with pytest.raises(ValueError):
        config.check_embedder("b")


def test_find_answers(spark):
    docs = spark.createDataFrame([("a", "The  OLD mill"), ("b", None), ("c", ""), ("d", "mill old")], "doc string, t string")
    gold = spark.createDataFrame([(1, "old mill"), (2, None), (3, " "), (4, "Mill"), (5, "old mill")], "q long, a string")
    for limit in (10**6, 3):
        got = {tuple(r) for r in answers.find_answers(docs, gold, "doc", "t", "q", "a", limit).collect()}
        assert got == {("a", 1), ("a", 4), ("a", 5), ("d", 4)}
    assert answers.find_answers(docs.limit(0), gold, "doc", "t", "q", "a").count() == 0
    assert answers.find_answers(docs, gold.limit(0), "doc", "t", "q", "a").count() == 0


# ------------------------------------------------------------------- reports


def gain(rel, k):
    g = lambda r: sum(x / math.log2(i + 2) for i, x in enumerate(r[:k]))
    return g(rel) / g(sorted(rel, reverse=True)) if g(sorted(rel, reverse=True)) else 0.0


def test_retrieval_metrics(spark):
    lists = [[], [True], [False, True, True], [False] * 4, [True] * 3, [False] * 12 + [True]]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(lists)], "i int, rel array<boolean>")
    for k in (0, 1, 10):
        m = evaluate.retrieval_metrics("rel", k)
        for r, got in zip(lists, rows.orderBy("i").select(*[m[n].alias(n) for n in m]).collect()):
            n = sum(r[:k])
            assert got["precision"] == pytest.approx(n / k if k else 0)
            assert got["recall"] == pytest.approx(min(n / max(sum(r), 1), 1))
            assert got["rr"] == pytest.approx(1 / (r.index(True) + 1) if True in r else 0)
            assert got["hit"] == (n > 0) and got["ndcg"] == pytest.approx(gain(r, k))


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 40, 100])
def test_p95_is_the_reference_rank(spark, n):
    values = [float((i * 37) % 11) - 3 for i in range(n)]
    rows = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("a", math.nan), ("b", None)], "g string, v double")
    got = [tuple(r) for r in evaluate.p95(rows, ["g"], "v").collect()]
    assert got == [("a", n, sorted(values)[min(int(n * 0.95), n - 1)])]


def test_rerank_keeps_the_order_of_ties(spark):
    hits = spark.createDataFrame([(1, r, f"c{r}", float(s)) for r, s in ((1, 1), (2, 5), (3, 1), (4, 5))], "trace_id long, rank int, chunk_id string, s double")
    got = [r["chunk_id"] for r in rerank.rerank(hits, F.col("s"), 3).orderBy("new_rank").collect()]
    assert got == ["c2", "c4", "c1"]


def test_id_metrics(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["b", "z"]), ([], ["a"]), (["a"], [])], "r array<string>, g array<string>")
    m = evaluate.id_metrics(F.col("r"), F.col("g"), 2)
    assert [tuple(x) for x in rows.select(*m.values()).collect()] == [(0.5, 0.5, 1.0, 0.5), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)]


def test_server_retries(spark):
    waits, calls = [], []

    def send(url, body):
        calls.append(body)
        if len(calls) < 3:
            raise OSError("down")
        return iter([{"message": {"content": ""}}, {"message": {"content": "yes"}, "prompt_eval_count": 3, "eval_count": 2, "eval_duration": 1_000_000_000}])

    out = generate.ModelServer(send=send, sleep=waits.append).generate("q")
    assert out["answer"] == "yes" and out["tokens_per_sec"] == 2 and waits == [5, 15] and out["ttft_ms"] is not None
    with pytest.raises(OSError):
        generate.ModelServer(send=lambda *_: (_ for _ in ()).throw(OSError()), sleep=waits.append).generate("q")


# -------------------------------------------------------------------- ingest


def test_batches_number_all_rows(spark):
    rows = spark.createDataFrame([(i % 50, str(i)) for i in range(203)], "a int, b string").repartition(7)
    got = ingest.assign_batches(rows, [F.col("a"), F.col("b")], 10).collect()
    by = sorted((r["a"], r["b"]) for r in got)
    assert [(r["a"], r["b"], r["pos"], r["batch_idx"]) for r in sorted(got, key=lambda r: r["pos"])] == [(a, b, i, i // 10) for i, (a, b) in enumerate(by)]
    assert ingest.assign_batches(rows.limit(0), [F.col("a")], 10).count() == 0


def test_passage_files(spark, tmp_path):
    lines = ["id\ttext\ttitle", "1\thello\tA", "2\t   \tB", "3", '4\t"quo ""ted"" x"\tC', "", '5\t"multi\nline"\tD', "6\t lead\tE", "7\tnull\tF", '8\tab"c\tG', "9\tx\tH\textra"]
    (tmp_path / "p.tsv").write_text("\n".join(lines) + "\n")
    got = {r["id"]: r["text"] for r in readers.read_passages(spark, str(tmp_path)).collect()}
    assert got == {"1": "hello", "4": 'quo "ted" x', "5": "multi\nline", "6": " lead", "7": "null", "8": 'ab"c', "9": "x"}


def test_question_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question,short_answers,long_answers\nq1,NA,long\nq2,1.50,\nq3,,\nq4,none,"a, b"\n')
    got = [tuple(r) for r in readers.read_questions(spark, str(tmp_path)).orderBy("query").collect()]
    assert got == [("q1", "long", ["long"]), ("q2", "1.50", ["1.50"]), ("q4", "none", ["none", "a, b"])]


def test_questions_in_memory(spark):
    rows = readers.questions_of(spark, [{"query": "a", "gold_answer": "x"}, {"query": "b"}, {"query": "c", "all_answers": ["y", "z"]}], "mine").collect()
    assert [(r["dataset"], r["sample_id"], r["gold_answer"], r["all_answers"]) for r in rows] == [("mine", 0, "x", ["x"]), ("mine", 1, None, []), ("mine", 2, None, ["y", "z"])]
    assert readers.questions_of(spark, []).count() == 0


def test_stream_restarts_without_repeating(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.tsv").write_text(f"id\ttext\ttitle\n{i}a\tone\t\n{i}b\t \t\n")
        for _ in range(2):
            ingest_passages(spark, str(source), str(target)).awaitTermination()
        assert resume_state(spark, str(target)).first()["n_chunks"] == i + 1


# ----------------------------------------------------------------- telemetry


def test_in_runs_meets_both_ends(spark):
    at = lambda s: dt.datetime(2031, 1, 1) + dt.timedelta(seconds=s)
    samples = spark.createDataFrame([(at(s),) for s in (0, 299, 300, 301, 900)] + [(None,)], "timestamp timestamp_ntz")
    runs = spark.createDataFrame([(1, at(299), at(301)), (2, at(5), at(1)), (3, None, at(9)), (4, at(0), at(2000))], "trace_id long, start timestamp_ntz, end timestamp_ntz")
    got = sorted((r["trace_id"], r["timestamp"]) for r in telemetry.in_runs(samples, runs).collect())
    assert got == [(1, at(299)), (1, at(300)), (1, at(301))] + [(4, at(s)) for s in (0, 299, 300, 301, 900)]


GRID = "run_id string, timestamp timestamp_ntz, recv_at timestamp_ntz, m double, extra int, slot int, value string"


def grid(spark, rows, **options):
    t = lambda s: None if s is None else dt.datetime(2031, 3, 4) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(r, t(s), t(at), m, 1, 2, "clash") for r, s, at, m in rows], GRID)
    return {(x["run_id"], (x["slot"] - dt.datetime(2031, 3, 4)).total_seconds()): (x["value"], x["status"]) for x in regular_grid(df, ["m"], **options).collect()}


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_grid(spark, block):
    rows = [("a", 5, 6, 1.0), ("a", 5, 6, 1.0), ("a", 9, 9, 2.0), ("a", 3, 99, 7.0), ("a", 45, 46, 6.0), ("a", 49, 50, math.nan), ("a", 200, 200, 9.0), ("a", 215, 215, None), ("a", None, 1, 5.0)]
    rows += [("none", 12, 12, None), ("none", 31, 31, math.nan), (None, -5, 0, 4.0)]
    got = grid(spark, rows, longest_gap=3, block=block)
    assert got[("a", 0)] == (2.0, "observed") and got[("a", 40)] == (6.0, "observed")
    assert [got[("a", s)] for s in (10, 20, 30)] == [(3.0, "interpolated"), (4.0, "interpolated"), (5.0, "interpolated")]
    assert all(got[("a", s)] == (None, "missing") for s in range(50, 200, 10))
    assert got[("a", 200)] == (9.0, "observed") and got[("a", 210)] == (None, "missing")
    assert {k: v for k, v in got.items() if k[0] == "none"} == {("none", s): (None, "missing") for s in (10, 20, 30)}
    assert got[(None, -10)] == (4.0, "observed") and len(got) == 22 + 3 + 1


def test_grid_of_nothing_and_in_another_zone(spark):
    assert grid(spark, []) == {}
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [("a", s, s, float(s)) for s in (0, 86400 * 26 + 7200, 86400 * 26 + 7260)]  # a night when clocks change
    expected = grid(spark, rows)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert grid(spark, rows) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# --------------------------------------------------------------------- store


@pytest.mark.parametrize("kind", index.INDEX_TYPES)
def test_vector_store(spark, tmp_path, kind):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((120, 8))
    rows = spark.createDataFrame([(f"c{i:03}", f"text {i}", {"n": str(i)}, v.tolist()) for i, v in enumerate(x)] + [("bad", "", None, [1.0])], "chunk_id string, text string, metadata map<string,string>, embedding array<float>")
    own = store.VectorStore(spark, index.IndexConfig(8, "cosine", kind, 3, 3, m_pq=4, nbits_pq=5, embedder_name="e"))
    with pytest.raises(ValueError):
        own.finalize()
    own.add(rows.where("chunk_id < 'c060' OR chunk_id = 'bad'"))
    if kind != "flat":
        with pytest.raises(RuntimeError):
            own.save(str(tmp_path / "s"))
    own.finalize().add(rows.where("chunk_id >= 'c060'"))
    assert len(own) == 120 and own.is_trained and own.index().count() == 120
    own.save(str(tmp_path / "s"))
    store.save_pointer(spark, str(tmp_path / "p"), "mine", str(tmp_path / "s"))
    again = store.open_pointer(spark, str(tmp_path / "p"), "e")
    assert again.config == own.config and len(again) == 120 and "size=120" in repr(again)
    with pytest.raises(ValueError):
        store.open_pointer(spark, str(tmp_path / "p"), "other")
    hits = again.retrieve(again.chunks().where("vec_id % 10 = 0").select("vec_id", "embedding"), 3)
    first = {r["qid"]: (r["chunk_id"], r["metadata"]["n"]) for r in hits.where("rk = 1").collect()}
    assert first == {i: (f"c{i:03}", str(i)) for i in range(0, 120, 10)}


def test_store_trains_of_itself(spark):
    rows = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(30)], "chunk_id string, embedding array<float>")
    own = store.VectorStore(spark, index.IndexConfig(2, "l2", "ivf_flat", 2, 2, train_size=20))
    assert not own.add(rows.where("chunk_id < 'c2'")).is_trained and own.add(rows.where("chunk_id >= 'c2'")).is_trained
    assert own.index().count() == 30 and own.chunks().select("vec_id").distinct().count() == 30
