"""Registered queries over vectors, indexes and traces, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from passageworks.functions import text as T
from passageworks.functions import vectors as V
from passageworks.operators import evaluate as E
from passageworks.operators import generate, index, report, rerank, retrieval
from passageworks.plans.corpus import folder, sql_bare, sql_normalise, sql_strip
from passageworks.operators.store import VectorStore, open_pointer, save_pointer
from passageworks.session import cut_lineage, read_table
from passageworks.sources.readers import write_report

QUERIES, ORACLE = {}, {}
TOP, CUT = 30, 10
#: Recall that probes are chosen for on other vectors, so that 0.9 is reached on the query set.
TUNED_RECALL = 0.92


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------- vectors


def _vectors(spark, d):
    return read_table(spark, d, "embeddings")


def _asked(df):
    """The stated query set: every row whose id is divisible by 20, against all rows."""
    return df.where("vec_id % 20 = 0")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 9) AS value FROM embeddings")
def embedding_norms(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(V.norm("embedding"), 9).alias("value"))


@query("""
    WITH n AS (SELECT vec_id, embedding::double[] AS e, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS n FROM chunk_vectors
               WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT vec_id, unnest(generate_series(0, 63))::int AS pos, round(unnest(list_transform(e, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END)), 9) AS value FROM n""")
def l2_normalise(spark, d):
    rows = read_table(spark, d, "chunk_vectors").where(~V.invalid("embedding", 64))
    return rows.select("vec_id", F.posexplode(V.unit("embedding")).alias("pos", "v")).select("vec_id", "pos", F.round("v", 9).alias("value"))


@query("SELECT vec_id, chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
def skip_invalid(spark, d):
    return read_table(spark, d, "chunk_vectors").where(~V.invalid("embedding", 64)).select("vec_id", "chunk_id")


_PAIRS = "SELECT q.vec_id AS qid, x.vec_id AS did, {0} AS score FROM embeddings q, embeddings x WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id"
_SCORES = {
    "cosine": "(list_cosine_similarity(q.embedding::double[], x.embedding::double[]) + 1) / 2",
    "dot": "list_dot_product(q.embedding::double[], x.embedding::double[])",
    "l2": "1 / (1 + pow(list_distance(q.embedding::double[], x.embedding::double[]), 2))",
}


def sql_topk(metric: str, k: int) -> str:
    return f"""
        WITH s AS ({_PAIRS.format(f'round({_SCORES[metric]}, 9)')}),
        r AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::int AS rk, score FROM s)
        SELECT qid, did, rk, score FROM r WHERE rk <= {k}"""


def _topk(spark, d, metric="cosine", k=TOP):
    rows = _vectors(spark, d)
    return retrieval.dense_topk(_asked(rows), rows, k, metric)


@query(sql_topk("cosine", TOP))
def dense_topk_cosine(spark, d):
    return _topk(spark, d)


@query(sql_topk("dot", TOP))
def dense_topk_dot(spark, d):
    return _topk(spark, d, "dot")


@query(sql_topk("l2", TOP))
def dense_topk_l2(spark, d):
    return _topk(spark, d, "l2")


@query(f"SELECT qid, did, rk, round(1 - (1 - (2 * score - 1)), 6) AS score FROM ({sql_topk('cosine', CUT)})")
def chroma_cosine(spark, d):
    """Scores as one minus the cosine distance."""
    return _topk(spark, d, k=CUT).select("qid", "did", "rk", F.round(1 - (1 - (2 * F.col("score") - 1)), 6).alias("score"))


@query("""
    WITH h AS (SELECT DISTINCT trace_id, unnest(retrieved, recursive := true) FROM run_traces),
    r AS (SELECT trace_id, chunk_id, score, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id)::int AS rk FROM h)
    SELECT trace_id, chunk_id, rk, score FROM r WHERE rk <= 3""")
def rank_hits(spark, d):
    hits = rerank.pairs(read_table(spark, d, "run_traces")).select("trace_id", "chunk_id", "score", "rank", "text").distinct()
    return retrieval.rank_hits(hits, 3, "trace_id", "chunk_id")


@query(f"SELECT qid, did, rk, score, label FROM ({sql_topk('cosine', CUT)}) JOIN embeddings ON did = vec_id")
def topk_lookup(spark, d):
    return retrieval.lookup(_topk(spark, d, k=CUT), _vectors(spark, d).select("vec_id", "label"))


def _scored(metric):
    def scores(spark, d):
        """Every vector against the one after it."""
        a = _vectors(spark, d).select("vec_id", "embedding")
        b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("x"))
        raw = {"cosine": V.cosine, "dot": V.dot, "l2": V.squared_distance}[metric]("embedding", "x")
        return a.join(b, "vec_id").select("vec_id", F.round(V.score(raw, metric), 9).alias("score"))

    return scores


for _metric, _sql in _SCORES.items():
    QUERIES[f"score_{_metric}"] = _scored(_metric)
    ORACLE[f"score_{_metric}"] = f"SELECT q.vec_id, round({_sql}, 9) AS score FROM embeddings q JOIN embeddings x ON x.vec_id = q.vec_id + 1"


_REL = f"""
    WITH t AS ({sql_topk('cosine', TOP)}),
    r AS (SELECT qid, list(q.label = x.label ORDER BY rk) AS rel FROM t JOIN embeddings q ON q.vec_id = qid JOIN embeddings x ON x.vec_id = did GROUP BY qid),
    g AS (SELECT qid, rel, list_sum(list_transform(rel[1:10], lambda x, i: CASE WHEN x THEN 1.0::double ELSE 0 END / log2(i + 1))) AS dcg,
          list_sum(list_transform(list_reverse_sort(rel)[1:10], lambda x, i: CASE WHEN x THEN 1.0::double ELSE 0 END / log2(i + 1))) AS ideal, len(list_filter(rel, lambda x: x)) AS n, len(list_filter(rel[1:10], lambda x: x)) AS n10 FROM r),
    m AS (SELECT qid, n10 / 10.0::double AS precision, least(n10 / greatest(n, 1)::double, 1.0) AS recall, CASE WHEN n > 0 THEN 1.0::double / list_position(rel, true) ELSE 0 END AS rr, (n10 > 0)::int::double AS hit, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg FROM g)"""
_METRICS = ("precision", "recall", "rr", "hit", "ndcg")


def _by_query(spark, d):
    rows = _vectors(spark, d).select("vec_id", "label")
    hits = _topk(spark, d)
    q, x = rows.withColumnsRenamed({"vec_id": "qid", "label": "ql"}), rows.withColumnsRenamed({"vec_id": "did", "label": "xl"})
    joined = hits.join(x, "did").join(q, "qid")
    # a query's hits are bounded by TOP
    return joined.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", (F.col("ql") == F.col("xl")).alias("r")))), lambda s: s["r"]).alias("rel"))


@query(f"{_REL} SELECT qid, " + ", ".join(f"round({m}, 9) AS {m}" for m in _METRICS) + " FROM m")
def retrieval_metrics(spark, d):
    m = E.retrieval_metrics("rel", CUT)
    return _by_query(spark, d).select("qid", *[F.round(m[n], 9).alias(n) for n in _METRICS])


@query(f"{_REL} SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in _METRICS) + " FROM m")
def retrieval_report(spark, d):
    m = E.retrieval_metrics("rel", CUT)
    return _by_query(spark, d).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(m[n]), 9).alias(n) for n in _METRICS])


# ------------------------------------------------------------------- indexes

_CELLS = "SELECT vec_id AS cell, embedding::double[] AS c FROM embeddings ORDER BY vec_id LIMIT 16"


def _fixed_cells(spark, d):
    """The first 16 vectors stand for trained centroids, so that results can be compared."""
    return _vectors(spark, d).orderBy("vec_id").limit(16).select(F.col("vec_id").cast("int").alias("cell_id"), F.col("embedding").cast("array<double>").alias("centroid"))


@query(f"""
    WITH c AS ({_CELLS}), v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
    n AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(pow(list_distance(e, c), 2), 9), cell) AS at FROM v, c),
    p AS (SELECT a.vec_id AS qid, b.vec_id AS did FROM n a JOIN n b ON a.cell = b.cell WHERE a.at <= 4 AND b.at = 1 AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    s AS (SELECT qid, did, round({_SCORES['cosine']}, 9) AS score FROM p JOIN embeddings q ON q.vec_id = qid JOIN embeddings x ON x.vec_id = did),
    r AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::int AS rk, score FROM s)
    SELECT qid, did, rk, score FROM r WHERE rk <= {CUT}""")
def ivf_probe(spark, d):
    rows, cells = _vectors(spark, d).select("vec_id", "embedding"), _fixed_cells(spark, d)
    return index.ivf_search(_asked(rows), index.build_ivf(rows, cells), cells, CUT, 4)


@query("SELECT unnest(range(16))::int AS cell_id, 64 AS dimensions")
def ivf_train(spark, d):
    return index.train_cells(_vectors(spark, d), 16).select("cell_id", F.size("centroid").alias("dimensions"))


def _trained(rows):
    """Index, trained cells, and the fewest probes that reach the recall asked for on vectors outside the query set."""
    cells = index.train_cells(rows, index.cells_for(rows.count()))
    stored, cells = cut_lineage(index.build_ivf(rows, cells)), cut_lineage(cells)
    return stored, cells, index.choose_nprobe(rows.where("vec_id % 20 <> 0"), stored, cells, CUT, TUNED_RECALL)


@query()
def ivf_recall(spark, d):
    rows = _vectors(spark, d).select("vec_id", "embedding")
    stored, cells, nprobe = _trained(rows)
    return index.recall_at(_topk(spark, d, k=CUT), index.ivf_search(_asked(rows), stored, cells, CUT, nprobe))


_PROBED = f"""
    c AS ({_CELLS}), v0 AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
    n0 AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(pow(list_distance(e, c), 2), 9), cell) AS at FROM v0, c),
    p AS (SELECT a.vec_id AS qid, b.vec_id AS did FROM n0 a JOIN n0 b ON a.cell = b.cell WHERE a.at <= 4 AND b.at = 1 AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""


def _fixed_search(spark, d, kind, quantiser):
    """Search by squared distance in four of the sixteen fixed cells, from codes."""
    rows, cells = _vectors(spark, d).select("vec_id", "embedding"), _fixed_cells(spark, d)
    config = index.IndexConfig(64, "l2", kind, 16, 4, m_pq=8)
    return index.search_index(_asked(rows), index.encode_index(rows, cells, quantiser, config), cells, quantiser, config, CUT)


@query(f"""
    WITH {_PROBED},
    x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x FROM embeddings),
    g AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i),
    y AS (SELECT vec_id, list(lo + (CASE WHEN hi > lo THEN greatest(least(floor((x - lo) / (hi - lo) * 255), 255), 0) ELSE 0 END + 0.5) / 255 * (hi - lo) ORDER BY i) AS y FROM x JOIN g USING (i) GROUP BY vec_id),
    s AS (SELECT qid, did, round(1 / (1 + pow(list_distance(q.e, y.y), 2)), 9) AS score FROM p JOIN v0 q ON q.vec_id = qid JOIN y ON y.vec_id = did),
    r AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::int AS rk, score FROM s)
    SELECT qid, did, rk, score FROM r WHERE rk <= {CUT}""")
def ivf_sq_search(spark, d):
    return _fixed_search(spark, d, "ivf_sq", index.sq8_ranges(_vectors(spark, d)))


def _tuned(rows, exact, config, asked):
    """The index of ``config``, with the fewest probes that reach the recall asked for on other vectors."""
    cells, quantiser = index.train_index(rows, config)
    own = cut_lineage(index.encode_index(rows, cells, None, replace(config, index_type="ivf_flat")))
    # cells are chosen by distance whatever the metric, so that probes are measured against that metric's exact hits
    measured = index.recall_by_probes(exact, asked, own, cells)
    nprobe = next((i for i, x in enumerate(measured, 1) if x >= TUNED_RECALL), len(measured))
    return index.encode_index(rows, cells, quantiser, config), cells, quantiser, replace(config, nprobe=nprobe)


def _quantised(kind):
    def recall(spark, d):
        """Recall of the index with trained codes under each metric, best hits scored again by their vectors; probes tuned on other vectors."""
        rows, out = _vectors(spark, d).select("vec_id", "embedding"), None
        nlist = index.cells_for(rows.count())
        others = rows.where("vec_id % 20 = 7")
        for metric in retrieval.METRICS:
            config = index.IndexConfig(64, metric, kind, nlist, m_pq=16)
            stored, cells, quantiser, config = _tuned(rows, retrieval.dense_topk(others, rows, CUT, metric), config, others)
            found = index.search_index(_asked(rows), stored, cells, quantiser, config, CUT, vectors=rows, rescore=10)
            own = index.recall_at(_topk(spark, d, metric, CUT), found).select(F.lit(metric).alias("metric"), F.lit(config.nprobe).alias("nprobe"), "recall")
            out = own if out is None else out.unionByName(own)
        return out

    return recall


for _kind in ("ivf_sq", "ivf_pq"):
    QUERIES[f"{_kind}_recall"] = _quantised(_kind)


@query(f"WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT i.index_type, n::bigint AS n_vectors, n::bigint AS n_found, (n // 20 + (n % 20 > 0)::int)::bigint AS n_first FROM n, (VALUES ('flat'), ('ivf_flat'), ('ivf_sq'), ('ivf_pq')) i(index_type)")
def vector_store(spark, d):
    """Every index type behind one interface: added in two parts, trained, saved, loaded, searched with all cells probed.

    ``n_found`` counts vectors whose own id comes back, ``n_first`` those of the query set for which it comes first.
    """
    rows = _vectors(spark, d).select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    out = None
    for kind in index.INDEX_TYPES:
        config = index.IndexConfig(64, "cosine", kind, 4, 4, m_pq=16, embedder_name="hash-64")
        built, path = VectorStore(spark, config), folder(spark, "collection")
        built.add(rows.where("chunk_id % 2 = 0")).finalize().add(rows.where("chunk_id % 2 = 1"))
        built.save(f"{path}/index")
        save_pointer(spark, f"{path}/pointer", kind, f"{path}/index")
        store = open_pointer(spark, f"{path}/pointer", "hash-64")
        asked = store.chunks().where("chunk_id % 20 = 0").select("vec_id", "embedding")
        first = store.search(asked, 1).where("qid = did").agg(F.count("*").alias("n_first"))
        found = store.chunks().join(store.index().select("vec_id"), "vec_id").agg(F.count("*").alias("n_found"))
        own = first.crossJoin(found).select(F.lit(kind).alias("index_type"), F.lit(len(store)).cast("long").alias("n_vectors"), "n_found", "n_first")  # one row each
        out = own if out is None else out.unionByName(own)
    return out


@query()
def index_roundtrip(spark, d):
    """An index written by cell, loaded and searched."""
    path, rows = folder(spark, "index"), _vectors(spark, d).select("vec_id", "embedding")
    trained, cells, nprobe = _trained(rows)
    index.save_index(trained, cells, index.IndexConfig(64, index_type="ivf_flat", nlist=cells.count(), nprobe=nprobe, embedder_name="hash-64"), path)
    stored, centroids, config = index.load_index(spark, path)
    config.check_embedder("hash-64")
    return index.ivf_search(_asked(rows), stored, centroids, CUT, config.nprobe)


@query("SELECT config_id, count(*) AS n FROM chunks GROUP BY config_id")
def store_reload(spark, d):
    path = folder(spark, "store")
    read_table(spark, d, "chunks").write.parquet(path)
    return spark.read.parquet(path).groupBy("config_id").agg(F.count("*").alias("n"))


@query("SELECT vec_id, 'embeddings' AS store FROM embeddings UNION ALL SELECT vec_id, 'chunk_vectors' FROM chunk_vectors WHERE embedding IS NOT NULL")
def index_append(spark, d):
    return _vectors(spark, d).select("vec_id", F.lit("embeddings").alias("store")).unionByName(read_table(spark, d, "chunk_vectors").where("embedding IS NOT NULL").select("vec_id", F.lit("chunk_vectors").alias("store")))


@query("""
    WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x FROM embeddings),
    r AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i),
    c AS (SELECT vec_id, x, lo, hi, CASE WHEN hi > lo THEN greatest(least(floor((x - lo) / (hi - lo) * 255), 255), 0) ELSE 0 END AS code FROM x JOIN r USING (i))
    SELECT vec_id, sum(code)::bigint AS code_sum, round(max(abs(x - (lo + (code + 0.5) / 255 * (hi - lo)))), 9) AS worst FROM c GROUP BY vec_id""")
def sq8_roundtrip(spark, d):
    rows = _vectors(spark, d)
    coded = index.sq8_encode(rows, index.sq8_ranges(rows))
    error = F.array_max(F.zip_with("embedding", index.sq8_decode(), lambda x, y: F.abs(x.cast("double") - y)))
    return coded.select("vec_id", F.aggregate("code", F.lit(0).cast("long"), lambda s, c: s + c).alias("code_sum"), F.round(error, 9).alias("worst"))


_BOOKS = f"WITH c AS ({_CELLS}), b AS (SELECT (row_number() OVER (ORDER BY cell) - 1)::int AS code, p.part, c[p.part * 8 + 1:p.part * 8 + 8] AS c FROM c, (SELECT unnest(generate_series(0, 7))::int AS part) p)"
_CODES = """,
    v AS (SELECT vec_id, part, (embedding::double[])[part * 8 + 1:part * 8 + 8] AS e FROM embeddings, (SELECT unnest(generate_series(0, 7))::int AS part)),
    n AS (SELECT vec_id, part, code, row_number() OVER (PARTITION BY vec_id, part ORDER BY round(pow(list_distance(e, c), 2), 9), code) AS place FROM v JOIN b USING (part)),
    k AS (SELECT vec_id, part, code FROM n WHERE place = 1)"""


def _fixed_books(spark, d):
    numbered = _fixed_cells(spark, d).agg(F.array_sort(F.collect_list(F.struct("cell_id", "centroid"))).alias("c")).select(F.posexplode("c.centroid").alias("code", "c"))
    return numbered.select("code", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part"), "c").select("part", "code", F.slice("c", F.col("part") * 8 + 1, 8).alias("centroid"))


@query(_BOOKS.replace("(row_number() OVER (ORDER BY cell) - 1)::int", "(dense_rank() OVER (ORDER BY cell) - 1)::int") + _CODES + " SELECT vec_id, part, code FROM k")
def pq_encode(spark, d):
    return index.pq_encode(_vectors(spark, d), _fixed_books(spark, d))


@query(_BOOKS.replace("(row_number() OVER (ORDER BY cell) - 1)::int", "(dense_rank() OVER (ORDER BY cell) - 1)::int").replace("WITH c AS", "WITH c AS", 1) + _CODES + ", " + _PROBED.replace(f"c AS ({_CELLS}), ", "") + f""",
    a AS (SELECT q.vec_id AS qid, k.vec_id AS did, sum(pow(list_distance(q.e, b.c), 2)) AS distance FROM v q JOIN k USING (part) JOIN b ON b.part = k.part AND b.code = k.code WHERE q.vec_id % 20 = 0 GROUP BY ALL),
    s AS (SELECT qid, did, round(1 / (1 + distance), 9) AS score FROM p JOIN a USING (qid, did)),
    r AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::int AS rk, score FROM s)
    SELECT qid, did, rk, score FROM r WHERE rk <= {CUT}""")
def ivf_pq_search(spark, d):
    return _fixed_search(spark, d, "ivf_pq", _fixed_books(spark, d))


@query(_BOOKS.replace("(row_number() OVER (ORDER BY cell) - 1)::int", "(dense_rank() OVER (ORDER BY cell) - 1)::int") + _CODES + """
    SELECT q.vec_id AS qid, k.vec_id AS did, round(sum(pow(list_distance(q.e, b.c), 2)), 6) AS distance FROM v q JOIN k USING (part) JOIN b ON b.part = k.part AND b.code = k.code WHERE q.vec_id % 20 = 0 GROUP BY ALL""")
def pq_adc(spark, d):
    rows, books = _vectors(spark, d), _fixed_books(spark, d)
    return index.pq_distances(_asked(rows), index.pq_codes(rows, books), books).select("qid", "did", F.round("distance", 6).alias("distance"))


@query("""
    WITH g AS (SELECT vec_id // 4 AS g, vec_id, embedding::double[] AS e FROM embeddings),
    p AS (SELECT a.g, a.vec_id AS x, b.vec_id AS y, list_dot_product(a.e, b.e) AS s FROM g a JOIN g b ON b.g = a.g + 1),
    r AS (SELECT g, avg(m) AS p FROM (SELECT g, x, max(s) AS m FROM p GROUP BY g, x) GROUP BY g),
    t AS (SELECT g, avg(m) AS r FROM (SELECT g, y, max(s) AS m FROM p GROUP BY g, y) GROUP BY g)
    SELECT g, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f FROM r JOIN t USING (g)""")
def bertscore_greedy(spark, d):
    """Vectors in fours stand for the token vectors of a text, compared with the next four."""
    g = _vectors(spark, d).groupBy(F.floor(F.col("vec_id") / 4).alias("g")).agg(F.collect_list("embedding").alias("e"))
    following = g.select((F.col("g") - 1).alias("g"), F.col("e").alias("other"))
    return g.join(following, "g").select("g", F.round(E.bertscore("e", "other"), 6).alias("f"))


# -------------------------------------------------------------------- traces


def _traces(spark, d):
    """Each run once: arrival repeats rows."""
    return read_table(spark, d, "run_traces").dropDuplicates(["trace_id"])


def _labelled(spark, d):
    return E.with_labels(_traces(spark, d), read_table(spark, d, "qa_samples"))


_T = f"""
    WITH t AS (SELECT * FROM run_traces QUALIFY row_number() OVER (PARTITION BY trace_id) = 1),
    g AS (SELECT sample_id, CASE WHEN {sql_strip('gold_answer')} <> '' THEN gold_answer END AS gold, list_filter(all_answers, lambda a: coalesce({sql_normalise('a')} <> '', false)) AS answers FROM qa_samples),
    l AS (SELECT t.*, gold, answers FROM t LEFT JOIN g USING (sample_id))"""
_HAS = f"len(list_filter(coalesce(answers, []), lambda a: contains({sql_normalise('coalesce(x.text, $$$$)')}, {sql_normalise('a')}))) > 0"
_RELEVANT = lambda hits: f"list_transform(coalesce({hits}, []), lambda x: {_HAS})"


@query(f"{_T}, h AS (SELECT trace_id, unnest(retrieved) AS x, answers FROM l) SELECT trace_id, x.rank AS rank, {_HAS} AS relevant FROM h")
def has_answer(spark, d):
    rows = _labelled(spark, d).select("trace_id", F.col("answers"), F.explode("retrieved").alias("x"))
    return rows.select("trace_id", "x.rank", T.has_answer(F.coalesce("x.text", F.lit("")), "answers").alias("relevant"))


_BEFORE_AFTER = f"""{_T},
    b AS (SELECT pipeline, answers, {_RELEVANT('retrieved')} AS b, {_RELEVANT('reranked')} AS a FROM l WHERE len(answers) > 0),
    m AS (SELECT pipeline, len(a) AS k, a, b, list_reverse_sort(a) AS ia, list_reverse_sort(b) AS ib FROM b),
    s AS (SELECT pipeline,
        CASE WHEN list_contains(b, true) THEN 1.0::double / list_position(b, true) ELSE 0 END AS mrr_before, CASE WHEN list_contains(a, true) THEN 1.0::double / list_position(a, true) ELSE 0 END AS mrr_after,
        coalesce(list_sum(list_transform(b[1:k], lambda x, i: x::int::double / log2(i + 1))) / nullif(list_sum(list_transform(ib[1:k], lambda x, i: x::int::double / log2(i + 1))), 0), 0) AS ndcg_before,
        coalesce(list_sum(list_transform(a, lambda x, i: x::int::double / log2(i + 1))) / nullif(list_sum(list_transform(ia, lambda x, i: x::int::double / log2(i + 1))), 0), 0) AS ndcg_after,
        coalesce(len(list_filter(b[1:k], lambda x: x))::double / nullif(k, 0), 0) AS precision_before, coalesce(len(list_filter(a, lambda x: x))::double / nullif(k, 0), 0) AS precision_after,
        (len(list_filter(b[1:k], lambda x: x)) > 0)::int::double AS hit_before, (len(list_filter(a, lambda x: x)) > 0)::int::double AS hit_after FROM m)"""
_RERANK = [f"{n}_{w}" for n in ("mrr", "ndcg", "precision", "hit") for w in ("before", "after")]


def _rerank_report(spark, d):
    rel = lambda hits: E.relevance(F.coalesce(F.col(hits)["text"], F.array().cast("array<string>")), "answers")
    rows = _labelled(spark, d).where(F.size("answers") > 0).select("pipeline", rel("retrieved").alias("b"), rel("reranked").alias("a"))
    m = E.rerank_metrics(F.col("b"), F.col("a"))
    return rows.groupBy("pipeline").agg(*[F.round(F.avg(m[n]), 9).alias(n) for n in _RERANK])


@query(f"{_BEFORE_AFTER} SELECT pipeline, " + ", ".join(f"round(avg({n}), 9) AS {n}" for n in _RERANK) + ", " + ", ".join(f"round(avg({n}_after) - avg({n}_before), 6) AS {n}_delta" for n in ("mrr", "ndcg", "precision")) + " FROM s GROUP BY pipeline")
def rerank_report(spark, d):
    return _rerank_report(spark, d).select("*", *[F.round(F.col(f"{n}_after") - F.col(f"{n}_before"), 6).alias(f"{n}_delta") for n in ("mrr", "ndcg", "precision")])


_PIPELINES = ["flat_passthrough", "ivfsq_cross"]


@query(f"{_BEFORE_AFTER}, r AS (" + " UNION ALL ".join(f"SELECT pipeline, '{n}' AS metric, round(avg({n}), 9) AS value FROM s GROUP BY pipeline" for n in _RERANK) + ") SELECT metric, " + ", ".join(f"max(value) FILTER (pipeline = '{p}') AS {p}" for p in _PIPELINES) + " FROM r GROUP BY metric")
def compare_pipelines(spark, d):
    return E.compare(_rerank_report(spark, d), "pipeline", _RERANK, _PIPELINES)


@query(f"{_T} SELECT trace_id, query, unnest(retrieved, recursive := true) FROM t")
def rerank_pairs(spark, d):
    return rerank.pairs(_traces(spark, d))


@query(f"{_T}, p AS (SELECT trace_id, unnest(retrieved, recursive := true) FROM t) SELECT trace_id, rank, chunk_id, score FROM p WHERE rank <= 3")
def rerank_passthrough(spark, d):
    return rerank.passthrough(rerank.pairs(_traces(spark, d)), 3).select("trace_id", "rank", "chunk_id", "score")


_WORDS = lambda x: f"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"


@query(f"""{_T}, p AS (SELECT trace_id, query, unnest(retrieved, recursive := true) FROM t),
    w AS (SELECT trace_id, rank, chunk_id, {_WORDS('query')} AS q, {_WORDS('text')} AS x FROM p),
    s AS (SELECT trace_id, rank, chunk_id, round(CASE WHEN len(q) + len(x) = 0 THEN 0 ELSE len(list_intersect(q, x))::double / (len(q) + len(x) - len(list_intersect(q, x))) END, 9) AS rerank_score FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY rerank_score DESC, rank)::int AS new_rank FROM s)
    SELECT trace_id, rank, chunk_id, rerank_score, new_rank FROM r WHERE new_rank <= 5""")
def rerank_scored(spark, d):
    score = F.round(rerank.overlap_score(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))), 9)
    return rerank.rerank(rerank.pairs(_traces(spark, d)), score, 5).select("trace_id", "rank", "chunk_id", "rerank_score", "new_rank")


@query(f"""{_T} SELECT trace_id, '{T.PROMPT_HEAD}' || coalesce(array_to_string(list_transform(retrieved, lambda c, i: '[' || i || '] ' || coalesce(c.text, '')), chr(10) || chr(10)), '')
    || '{T.PROMPT_QUESTION}' || coalesce(query, '') || '{T.PROMPT_TAIL}' AS prompt FROM t""")
def build_prompt(spark, d):
    return _traces(spark, d).select("trace_id", T.prompt("query", F.col("retrieved")["text"]).alias("prompt"))


@query(f"{_T} SELECT trace_id, ({sql_bare('answer')} = {sql_bare('gold')})::int::double AS value FROM l WHERE gold IS NOT NULL")
def exact_match(spark, d):
    return _labelled(spark, d).where("gold IS NOT NULL").select("trace_id", T.exact_match("answer", "gold").alias("value"))


@query(f"{_T} SELECT pipeline, count(*) AS n_samples, count(gold) AS n_labelled, round(avg(({sql_bare('answer')} = {sql_bare('gold')})::int::double), 9) AS exact_match FROM l GROUP BY pipeline")
def generation_report(spark, d):
    return _labelled(spark, d).groupBy("pipeline").agg(F.count("*").alias("n_samples"), F.count("gold").alias("n_labelled"), F.round(F.avg(T.exact_match("answer", "gold")), 9).alias("exact_match"))


@query()
def rouge_l(spark, d):
    return T.rouge_l_scores(_labelled(spark, d).where("gold IS NOT NULL"), ["trace_id"], "answer", "gold")


@query(f"""
    WITH RECURSIVE {_T.strip().removeprefix('WITH')},
    p AS (SELECT trace_id, regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+') AS a, regexp_extract_all(lower(gold), '[a-z0-9]+') AS b FROM l WHERE gold IS NOT NULL),
    r AS (SELECT trace_id, 0 AS i, a, b, list_transform(b, lambda x: 0) AS best FROM p
        UNION ALL SELECT trace_id, i + 1, a, b, list_transform(generate_series(1, len(b)), lambda j: list_max(list_transform(generate_series(1, j), lambda k: greatest(best[k], CASE WHEN b[k] = a[i + 1] THEN 1 + CASE WHEN k > 1 THEN best[k - 1] ELSE 0 END ELSE 0 END))))::int[] FROM r WHERE i < len(a))
    SELECT trace_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2 * coalesce(list_max(best), 0)::double / (len(a) + len(b)) ELSE 0 END AS rouge_l FROM r WHERE i = len(a)""")
def rouge_l_nostem(spark, d):
    return T.rouge_l_scores(_labelled(spark, d).where("gold IS NOT NULL"), ["trace_id"], "answer", "gold", stem=False)


@query(f"""{_T}, i AS (SELECT trace_id, list_transform(coalesce(retrieved, []), lambda x: x.chunk_id) AS r, list_transform(coalesce(reranked, []), lambda x: x.chunk_id) AS w FROM t),
    h AS (SELECT *, len(list_filter(r[1:{CUT}], lambda c: list_contains(w, c))) AS hits, list_filter(list_transform(r, lambda c, i: CASE WHEN list_contains(w, c) THEN i END), lambda i: i IS NOT NULL) AS places FROM i)
    SELECT trace_id, round(CASE WHEN len(r) > 0 THEN hits / {CUT}.0::double ELSE 0 END, 9) AS precision, round(coalesce(hits / nullif(len(w), 0)::double, 0), 9) AS recall, (hits > 0)::int::double AS hit, round(CASE WHEN len(places) > 0 THEN 1.0::double / places[1] ELSE 0 END, 9) AS rr FROM h""")
def id_metrics(spark, d):
    none = F.array().cast("array<string>")
    m = E.id_metrics(F.coalesce(F.col("retrieved")["chunk_id"], none), F.coalesce(F.col("reranked")["chunk_id"], none), CUT)
    return _traces(spark, d).select("trace_id", *[F.round(m[n], 9).alias(n) for n in ("precision", "recall", "hit", "rr")])


@query(f"{_T} SELECT count(*) AS n_traces, count(gold) AS n_gold, count(*) FILTER (len(answers) > 0) AS n_answers, round(avg(CASE WHEN len(answers) > 0 THEN (len(retrieved) > 0)::int::double END), 9) AS answered FROM l")
def labelled_only(spark, d):
    """Unlabelled samples count in the total, not in what needs labels."""
    some = F.size("answers") > 0
    return _labelled(spark, d).agg(F.count("*").alias("n_traces"), F.count("gold").alias("n_gold"), F.count_if(some).alias("n_answers"), F.round(F.avg(F.when(some, (F.size("retrieved") > 0).cast("double"))), 9).alias("answered"))


@query(f"{_T} SELECT trace_id, len(retrieved)::int AS retrieved_k, len(reranked)::int AS context_chunks, length(answer)::int AS answer_chars FROM t")
def stage_meta(spark, d):
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return _traces(spark, d).select("trace_id", size("retrieved").alias("retrieved_k"), size("reranked").alias("context_chunks"), F.length("answer").alias("answer_chars"))


@query(f"{_T} SELECT trace_id, query, answer, coalesce(len(retrieved), 0)::int AS n_retrieved, retrieved[1].chunk_id AS first_chunk, reranked[1].score AS first_score, latency_ms['retrieve'] AS retrieve_ms, wall_time['pipeline_start']::varchar AS started FROM t")
def trace_struct(spark, d):
    """Traces as nested JSON, of which fields are read again."""
    rows = _traces(spark, d)
    nested = F.struct("query", "retrieved", "reranked", "answer", "latency_ms", "wall_time")
    # times are written to the microsecond, not to the millisecond as by default
    json = rows.select("trace_id", F.to_json(nested, {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"))
    # NaN has no number in JSON, so that it is written and read as text; a text of any length is read, and what cannot be read is an error, not a null
    reading = {"allowNonNumericNumbers": "true", "maxStringLen": str(2**31 - 1), "mode": "FAILFAST"}
    again = F.from_json("json", rows.select(nested.alias("x")).schema["x"].dataType.simpleString(), reading).alias("x")
    hit = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return json.select("trace_id", again).select("trace_id", "x.*").select(
        "trace_id", "query", "answer", F.coalesce(F.when(F.col("retrieved").isNotNull(), F.size("retrieved")), F.lit(0)).alias("n_retrieved"), hit("retrieved")["chunk_id"].alias("first_chunk"), hit("reranked")["score"].alias("first_score"),
        F.try_element_at("latency_ms", F.lit("retrieve")).alias("retrieve_ms"), F.try_element_at("wall_time", F.lit("pipeline_start")).cast("string").alias("started"),
    )


@query(f"{_T} SELECT trace_id, regexp_extract(coalesce(retrieved[1].text, ''), '^(.*?[.!?])(\\s|\\z)|^(.*)\\z', 0, 's') AS answer FROM t")
def extracted_answers(spark, d):
    """The extractive stand-in for a generator."""
    return _traces(spark, d).select("trace_id", generate.extract_answer(F.col("retrieved")["text"]).alias("answer"))


@query()
def pipeline_run(spark, d):
    """Every question through the whole pipeline over the passages, with the stand-ins for models."""
    from passageworks.operators.chunking import chunk_prechunked
    from passageworks.operators.pipeline import QuestionPipeline, hash_vectors

    chunks = chunk_prechunked(read_table(spark, d, "passages").dropDuplicates(["id"]), "id", "text").select(F.col("id").cast("long").alias("vec_id"), "chunk_id", F.col("chunk_text").alias("text"))
    store = chunks.join(hash_vectors(chunks, "vec_id", "text"), "vec_id")
    return QuestionPipeline(store).run(read_table(spark, d, "qa_samples")).select("sample_id", F.size("retrieved").alias("n_retrieved"), F.size("reranked").alias("n_reranked"), "prompt", "answer")


@query("SELECT sample_id, 64 AS embedding_dim, 30 AS requested_k, 4::bigint AS n_stages, 3::bigint AS n_clocks, true AS in_order FROM qa_samples")
def pipeline_traced(spark, d):
    """The same with latencies, wall times and stage metadata."""
    from passageworks.operators.chunking import chunk_prechunked
    from passageworks.operators.pipeline import QuestionPipeline, hash_vectors

    chunks = chunk_prechunked(read_table(spark, d, "passages").dropDuplicates(["id"]), "id", "text").select(F.col("id").cast("long").alias("vec_id"), "chunk_id", F.col("chunk_text").alias("text"))
    store = chunks.join(hash_vectors(chunks, "vec_id", "text"), "vec_id")
    runs = QuestionPipeline(store).run_traced(read_table(spark, d, "qa_samples"))
    clock = lambda name: F.col("wall_time")[name]
    in_order = (clock("pipeline_start") <= clock("generate_start")) & (clock("generate_start") <= clock("pipeline_end"))
    return runs.select("sample_id", "meta.embedding_dim", "meta.requested_k", F.size("latency_ms").cast("long").alias("n_stages"), F.size("wall_time").cast("long").alias("n_clocks"), in_order.alias("in_order"))


# -------------------------------------------------------------------- report

_STAGE_MS = lambda stage: f"CASE WHEN latency_ms['{stage}'] IS NULL OR isnan(latency_ms['{stage}']) THEN 0 ELSE latency_ms['{stage}'] END"
_SPACED = lambda x: f"len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
_REPORTED = {f"{s}_{n}": (stage, f) for s, stage in zip(report.STAGES, ("embedding", "retrieval", "reranking", "generation")) for n, f in (("mean", "avg_latency_ms"), ("p95", "p95_latency_ms"), ("qps", "qps"))}
_REPORTED |= {n: ("retrieval", "mrr" if n == "rr" else n) for n in report.RETRIEVAL} | {n: ("reranking", n) for n in (*report.RERANK, "mrr_delta", "ndcg_delta", "precision_delta")}
_REPORTED |= {"exact_match": ("generation", "exact_match"), "prompt_tokens": ("generation", "avg_prompt_tokens"), "completion_tokens": ("generation", "avg_completion_tokens"), "ttft": ("generation", "avg_ttft_ms")}
_GAIN = lambda x, k: f"list_sum(list_transform({x}[1:{k}], lambda x, i: x::int::double / log2(i + 1)))"


@query(f"""{_BEFORE_AFTER},
    ms AS (SELECT pipeline, trace_id, {', '.join(f'{_STAGE_MS(s)} AS {s}' for s in report.STAGES)} FROM t),
    speed AS (SELECT pipeline, {', '.join(f'round(avg({s}), 6) AS {s}_mean, list_sort(list({s}))[least(floor(count(*) * 0.95::double), count(*) - 1)::int + 1] AS {s}_p95, round(coalesce(count(*) / nullif(sum({s}) / 1000, 0), 0), 6) AS {s}_qps' for s in report.STAGES)} FROM ms GROUP BY pipeline),
    q AS (SELECT pipeline, {', '.join(f'round(avg({n}), 6) AS {n}' for n in report.RERANK)} FROM s GROUP BY pipeline),
    f AS (SELECT pipeline, len(list_filter(b[1:{CUT}], lambda x: x)) AS n10, len(list_filter(b, lambda x: x)) AS n, b, list_reverse_sort(b) AS ib FROM b),
    found AS (SELECT pipeline, round(avg(n10 / {CUT}.0::double), 6) AS precision, round(avg(least(n10 / greatest(n, 1)::double, 1)), 6) AS recall, round(avg(CASE WHEN n > 0 THEN 1.0::double / list_position(b, true) ELSE 0 END), 6) AS rr, round(avg((n10 > 0)::int::double), 6) AS hit,
        round(avg(coalesce({_GAIN('b', CUT)} / nullif({_GAIN('ib', CUT)}, 0), 0)), 6) AS ndcg FROM f GROUP BY pipeline),
    c AS (SELECT pipeline, count(*) AS n_samples, count(gold) AS n_labelled, max(len(retrieved))::int AS top_k, replace(min(wall_time['pipeline_start'])::varchar, ' ', 'T') AS started, round(avg(({sql_bare('answer')} = {sql_bare('gold')})::int::double), 6) AS exact_match,
        round(avg({_SPACED('query')}), 6) AS prompt_tokens, round(avg({_SPACED('answer')}), 6) AS completion_tokens, NULL::double AS ttft FROM l GROUP BY pipeline)
    SELECT pipeline, n_samples, n_labelled, top_k, started, {', '.join(n if not n.endswith('_delta') else f"round({n.replace('delta', 'after')} - {n.replace('delta', 'before')}, 6) AS {n}" for n in _REPORTED)}
    FROM c JOIN speed USING (pipeline) JOIN q USING (pipeline) JOIN found USING (pipeline) WHERE pipeline IS NOT NULL""")
def evaluation_report(spark, d):
    """The whole report of every pipeline, written as nested JSON and read again."""
    tokens = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    counted = lambda c: F.when(F.col(c).isNotNull(), tokens(c))
    rows = _labelled(spark, d).withColumns({"prompt_tokens": counted("query"), "completion_tokens": counted("answer")})
    found = report.evaluate(rows.where("pipeline IS NOT NULL"), CUT, "qa_samples")
    path = folder(spark, "report")
    write_report(found, path)
    again = spark.read.schema(found.schema).json(path)
    figures = [F.col("stages")[stage][f].alias(n) for n, (stage, f) in _REPORTED.items()]
    return again.select("pipeline", "n_samples", "n_labelled", F.col("config.retriever_top_k").alias("top_k"), F.col("pipeline_start").alias("started"), *figures)


@query()
def report_summary(spark, d):
    """The report as lines of text, ROUGE-L and BERTScore among them."""
    return report.summary(report.evaluate(_labelled(spark, d), CUT, "qa_samples"))
