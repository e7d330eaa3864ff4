"""Vector indexes as partitioned tables: inverted file, 8-bit scalar and product quantisers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions import vectors as V
from passageworks.operators.retrieval import HITS, METRICS, QUERY_BLOCK, Best, dense_topk, in_query_blocks, matrix, rank_hits, scored, similarity
from passageworks.session import cut_lineage

INDEX_TYPES = ("flat", "ivf_flat", "ivf_pq", "ivf_sq")


@dataclass(frozen=True)
class IndexConfig:
    """Settings of an index; checked when made."""

    dimension: int
    metric: str = "cosine"
    index_type: str = "flat"
    nlist: int = 4096
    nprobe: int = 64
    m_pq: int = 96
    nbits_pq: int = 8
    train_size: int = 262_144
    embedder_name: str | None = None

    def __post_init__(self):
        if self.index_type not in INDEX_TYPES:
            raise ValueError(f"index_type must be one of {INDEX_TYPES}, not {self.index_type!r}")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}, not {self.metric!r}")
        if self.index_type == "ivf_pq" and self.dimension % self.m_pq:
            raise ValueError(f"dimension {self.dimension} is not divisible by m_pq {self.m_pq}")

    def check_embedder(self, name: str) -> None:
        """Fails if the index was built with another embedder; an unnamed one passes."""
        if self.embedder_name is not None and self.embedder_name != name:
            raise ValueError(f"the index was built with {self.embedder_name!r}, not {name!r}")

    def enough_to_train(self, n: int) -> bool:
        """Whether ``n`` vectors are the advised 39 per list."""
        return n >= 39 * self.nlist


def train_cells(df: DataFrame, cells: int, vector: str = "embedding", sample: int = 262_144, key: str = "vec_id", rounds: int = 5, seed: int = 1) -> DataFrame:
    """``cell_id, centroid`` by k-means over at most ``sample`` vectors, chosen by the hash of their id."""
    rows = df.where(F.col(vector).isNotNull()).select(key, vector)
    every = max(1, -(-rows.count() // sample))
    rows = rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, maxIter=rounds, seed=seed).fit(rows)
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(found, "cell_id int, centroid array<double>")


def cells_for(n: int, nlist: int = 4096) -> int:
    """Cells for ``n`` vectors: as many as leave the advised 39 vectors each, ``nlist`` at most."""
    return max(1, min(nlist, n // 39))


def _table(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and centroids, by id: their number is a setting of the index, not of the data."""
    rows = sorted(cells.select("cell_id", "centroid").collect(), key=lambda r: r["cell_id"])
    return np.array([r["cell_id"] for r in rows], np.int32), np.array([r["centroid"] for r in rows], np.float64)


def _nearest(x: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` nearest centroids of every vector, by squared distance to 9 places, then by place."""
    out = []
    own = (centroids * centroids).sum(axis=1)
    for at in range(0, len(x), step := max(1, 4_000_000 // len(centroids))):
        v = x[at : at + step]
        d = np.round(np.maximum((v * v).sum(axis=1)[:, None] + own[None, :] - 2 * v @ centroids.T, 0), 9)
        out.append(d.argmin(axis=1)[:, None] if count == 1 else np.argsort(d, axis=1, kind="stable")[:, :count])
    return np.concatenate(out) if out else np.zeros((0, count), np.int64)


def nearest_cells(df: DataFrame, cells: DataFrame, count: int, key: str, vector: str) -> DataFrame:
    """``key, cell_id, place`` (from 1) of the ``count`` cells nearest to every vector, ties by cell; no shuffle."""
    names, centroids = _table(cells)
    shared = df.sparkSession.sparkContext.broadcast((names, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centroids = shared.value
        for batch in batches:
            near = _nearest(matrix(batch.column(1)), centroids, count)
            at = np.repeat(np.arange(len(near)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(names[near.ravel()]), pa.array(np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(near)))], [key, "cell_id", "place"])

    return df.select(key, vector).mapInArrow(run, T.StructType([df.schema[key], T.StructField("cell_id", T.IntegerType()), T.StructField("place", T.IntegerType())]))


def build_ivf(df: DataFrame, cells: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``df`` with the ``cell_id`` of every vector's nearest centroid; write it partitioned by that column.  No shuffle."""
    names, centroids = _table(cells)
    shared = df.sparkSession.sparkContext.broadcast((names, centroids))
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centroids = shared.value
        for batch in batches:
            home = names[_nearest(matrix(batch.column(at)), centroids, 1)[:, 0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], [*batch.schema.names, "cell_id"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell_id", T.IntegerType())]))


def ivf_search(
    queries: DataFrame, index: DataFrame, cells: DataFrame, k: int, nprobe: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, metric: str = "cosine",
    stored: str | None = None, decode: Callable[[pa.Array], np.ndarray] | None = None,
) -> DataFrame:
    """``qid, did, rk, score`` (by ``metric``) of the ``k`` best in the ``nprobe`` cells nearest to each query.

    Queries travel in blocks of a fixed size to the partitions of the index,
    where each batch is compared, cell by cell, with the queries that probe
    the cell; a partition sends only its ``k`` best per query on.  So no row of
    the index is shuffled and a hot cell is worked on by all tasks that hold
    its rows.  ``stored`` and ``decode`` name a column of codes and how vectors
    are read from it.
    """
    names, centroids = _table(cells)
    read = decode or matrix

    def search(ids: np.ndarray, q: np.ndarray, shared) -> DataFrame:
        visits = queries.sparkSession.sparkContext.broadcast(names[_nearest(q, centroids, nprobe)] if len(q) else np.zeros((0, 1), np.int32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, q), visited = shared.value, visits.value
            best = Best(ids, k, exclude_self)
            flat = np.argsort(visited, axis=None, kind="stable")
            probed, begins = np.unique(visited.ravel()[flat], return_index=True)
            ends = np.append(begins[1:], len(flat))
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                did, home = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                order = np.argsort(home, kind="stable")
                x = None
                for cell, begin, end in zip(probed, begins, ends):
                    own = order[np.searchsorted(home, cell, sorter=order) : np.searchsorted(home, cell, "right", sorter=order)]
                    if len(own):
                        x = read(batch.column(1)) if x is None else x
                        of = flat[begin:end] // visited.shape[1]
                        for at in range(0, len(own), 2048):
                            rows = own[at : at + 2048]
                            best.add(similarity(q[of], x[rows], metric), did[rows], of)
            yield from best.batches()

        return index.select(F.col(key).cast("long").alias("id"), stored or vector, "cell_id").mapInArrow(run, HITS)

    found = in_query_blocks(queries, search, key, vector, QUERY_BLOCK)
    return rank_hits(found.select("qid", "did", F.round(scored(F.col("similarity"), metric), 9).alias("score")), k)


def recall_by_probes(exact: DataFrame, queries: DataFrame, index: DataFrame, cells: DataFrame, key: str = "vec_id", vector: str = "embedding") -> list[float]:
    """Recall of the search with 1, 2, ... cells probed: an exact hit is found as soon as its cell is visited."""
    homes = exact.select("qid", "did").join(index.select(F.col(key).alias("did"), "cell_id"), "did")
    places = nearest_cells(queries, cells, n := cells.count(), key, vector).withColumnRenamed(key, "qid")
    found = {r["place"]: r["count"] for r in homes.join(places, ["qid", "cell_id"]).groupBy("place").count().collect()}  # one row per cell
    total, out, sum_ = sum(found.values()), [], 0
    for place in range(1, n + 1):
        sum_ += found.get(place, 0)
        out.append(sum_ / total if total else 1.0)
    return out


def choose_nprobe(queries: DataFrame, index: DataFrame, cells: DataFrame, k: int, recall: float, key: str = "vec_id", vector: str = "embedding", most: int = 1000) -> int:
    """Fewest probes with which about ``most`` of ``queries``, chosen by the hash of their id, find ``recall`` of their exact hits."""
    every = max(1, -(-queries.count() // most))
    asked = queries.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0)
    measured = recall_by_probes(dense_topk(asked, index, k, key=key, vector=vector), asked, index, cells, key, vector)
    return next(i for i, x in enumerate(measured, 1) if x >= recall)


def sq8_ranges(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: least and greatest value of every dimension."""
    each = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    packed = each.agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("r"))  # one row per dimension
    return packed.select(F.col("r.lo").cast("array<double>").alias("lo"), F.col("r.hi").cast("array<double>").alias("hi"))


def sq8_encode(df: DataFrame, ranges: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with ``code array<int>`` of 0..255 per dimension, and ``lo`` and ``hi`` to decode it."""
    place = F.transform(vector, lambda x, i: F.coalesce((x.cast("double") - F.get("lo", i)) / F.nullif(F.get("hi", i) - F.get("lo", i), F.lit(0.0)), F.lit(0.0)))
    code = F.transform(place, lambda p: F.least(F.greatest(F.floor(p * 255), F.lit(0)), F.lit(255)).cast("int"))
    return df.crossJoin(F.broadcast(ranges)).withColumn("code", code)  # one row on the right


def sq8_decode(code: str = "code") -> F.Column:
    return F.transform(code, lambda c, i: F.get("lo", i) + (c + 0.5) / 255 * (F.get("hi", i) - F.get("lo", i)))


def pq_train(df: DataFrame, m: int, codes: int, vector: str = "embedding", key: str = "vec_id", sample: int = 65_536, rounds: int = 8, seed: int = 1) -> DataFrame:
    """``part, code, centroid``: a codebook per sub-space, each by k-means over the same bounded sample."""
    dimensions = df.select(F.size(vector)).first()[0]
    if dimensions % m:
        raise ValueError(f"{dimensions} dimensions are not divisible by {m}")
    width = dimensions // m
    every = max(1, -(-df.count() // sample))
    rows = df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("part"), "v").select("id", "part", F.slice("v", F.col("part") * width + 1, width).alias("v"))

    def fit(table: pa.Table) -> pa.Table:
        x = np.unique(np.array(table["v"].to_pylist()), axis=0)  # at most the sample
        c = x[np.random.default_rng(seed).choice(len(x), min(codes, len(x)), replace=False)]
        for _ in range(rounds):
            at = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            n = np.bincount(at, minlength=len(c))[:, None]
            total = np.stack([np.bincount(at, x[:, d], len(c)) for d in range(width)], axis=1)
            c = np.where(n > 0, total / np.maximum(n, 1), c)
        return pa.table({"part": pa.array([table["part"][0].as_py()] * len(c), pa.int32()), "code": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return parts.groupBy("part").applyInArrow(fit, "part int, code int, centroid array<double>")


def _books(books: DataFrame) -> np.ndarray:
    """(part, code, width) of the codebooks; parts with fewer codes repeat their last one, which no vector takes."""
    rows = books.select("part", "code", "centroid").collect()  # a setting of the index
    parts, codes = 1 + max(r["part"] for r in rows), 1 + max(r["code"] for r in rows)
    out = np.full((parts, codes, len(rows[0]["centroid"])), np.nan)
    for r in rows:
        out[r["part"], r["code"]] = r["centroid"]
    for part in out:
        known = ~np.isnan(part[:, 0])
        part[~known] = part[known][-1]
    return out


def pq_codes(df: DataFrame, books: DataFrame, vector: str = "embedding", code: str = "code") -> DataFrame:
    """``df`` with ``code array<int>``: the nearest centroid in each sub-space, ties by code; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(_books(books))
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        width = books.shape[2]
        for batch in batches:
            x = matrix(batch.column(at))
            found = np.stack([_nearest(x[:, i * width : (i + 1) * width], book, 1)[:, 0] for i, book in enumerate(books)], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(found)], [*batch.schema.names, code])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(code, T.ArrayType(T.IntegerType()))]))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def pq_encode(df: DataFrame, books: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, part, code``: the nearest centroid in each sub-space, ties by code."""
    return pq_codes(df.select(key, vector), books, vector).select(key, F.posexplode("code").alias("part", "code"))


def pq_decoder(books: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """Vectors from codes.  Distances to them are the asymmetric distances that a table of a query's distances would add up."""
    own = _books(books)

    def decode(codes: pa.Array) -> np.ndarray:
        at = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), -1)
        return own[np.arange(at.shape[1])[None, :], at].reshape(len(at), -1)

    return decode


def sq8_decoder(ranges: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    own = ranges.first()  # one row
    lo, hi = np.array(own["lo"]), np.array(own["hi"])
    return lambda codes: lo + (codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), -1) + 0.5) / 255 * (hi - lo)


def pq_distances(queries: DataFrame, codes: DataFrame, books: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``qid, did, distance`` of a stated query set to all rows with ``code``: asymmetric distances, query block by query block.

    Every pair is a row; for the nearest ones search an index.
    """
    decode = pq_decoder(books)

    def search(ids: np.ndarray, q: np.ndarray, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                did, x = batch.column(0).to_numpy(), decode(batch.column(1))
                for i, own in zip(ids, q):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(did), i)), pa.array(did), pa.array(((x - own) ** 2).sum(axis=1))], ["qid", "did", "similarity"])

        return codes.select(F.col(key).cast("long").alias("id"), "code").mapInArrow(run, HITS)

    return in_query_blocks(queries, search, key, vector, QUERY_BLOCK).withColumnRenamed("similarity", "distance")


def build_index(df: DataFrame, config: IndexConfig, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Index of the configured type, its cells, and what its codes are read with: ranges, codebooks or nothing."""
    cells, quantiser = train_index(df, config, key, vector)
    return encode_index(df, cells, quantiser, config, key, vector), cells, quantiser


def _own(df: DataFrame, config: IndexConfig, key: str, vector: str) -> DataFrame:
    """Unit vectors for cosine, vectors as they are otherwise."""
    return df.select(key, (V.unit(vector) if config.metric == "cosine" else F.col(vector).cast("array<double>")).alias(vector))


def train_index(df: DataFrame, config: IndexConfig, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame | None]:
    """Cells, and ranges or codebooks, fitted on a bounded sample (ranges on all); a flat index is one cell."""
    own = _own(df, config, key, vector)
    if config.index_type == "flat":
        cells = df.sparkSession.createDataFrame([(0, [0.0] * config.dimension)], "cell_id int, centroid array<double>")
    else:
        cells = cut_lineage(train_cells(own, config.nlist, vector, config.train_size, key))
    if config.index_type == "ivf_sq":
        return cells, cut_lineage(sq8_ranges(own, vector))
    if config.index_type == "ivf_pq":
        return cells, cut_lineage(pq_train(own, config.m_pq, 1 << config.nbits_pq, vector, key))
    return cells, None


def encode_index(df: DataFrame, cells: DataFrame, quantiser: DataFrame | None, config: IndexConfig, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``cell_id`` and the vector, or in the quantised types its ``code``; one pass, no shuffle."""
    placed = build_ivf(_own(df, config, key, vector), cells, key, vector)
    if config.index_type == "ivf_sq":
        return sq8_encode(placed, quantiser, vector).select(key, "code", "cell_id")
    if config.index_type == "ivf_pq":
        return pq_codes(placed, quantiser, vector).select(key, "code", "cell_id")
    return placed


def search_index(
    queries: DataFrame, index: DataFrame, cells: DataFrame, quantiser: DataFrame | None, config: IndexConfig, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True,
    vectors: DataFrame | None = None, rescore: int = 4,
) -> DataFrame:
    """``qid, did, rk, score`` of the ``k`` best in the probed cells, by the configured metric, read from the codes if there are any.

    With ``vectors`` (``key`` and vector) the ``rescore * k`` best by codes are scored again by their vectors.
    """
    asked = _own(queries, config, key, vector)
    decode = {"ivf_sq": sq8_decoder, "ivf_pq": pq_decoder}[config.index_type](quantiser) if quantiser is not None else None
    again = vectors is not None and decode is not None
    found = ivf_search(asked, index, cells, k * rescore if again else k, config.nprobe, key, vector, exclude_self, config.metric, "code" if decode else None, decode)
    if not again:
        return found
    hits = found.select("qid", "did").join(_own(vectors, config, key, vector).select(F.col(key).alias("did"), F.col(vector).alias("x")), "did")
    hits = hits.join(asked.select(F.col(key).alias("qid"), F.col(vector).alias("q")), "qid")
    near = {"cosine": V.cosine, "dot": V.dot, "l2": V.squared_distance}[config.metric]("q", "x")
    return rank_hits(hits.select("qid", "did", F.round(V.score(near, config.metric), 9).alias("score")), k)


def save_index(index: DataFrame, cells: DataFrame, config: IndexConfig, path: str, quantiser: DataFrame | None = None) -> None:
    """Vectors or codes by cell, centroids, ranges or codebooks, and settings, each as a table under ``path``."""
    spark = index.sparkSession
    index.write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/vectors")
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    if quantiser is not None:
        quantiser.write.mode("overwrite").parquet(f"{path}/quantiser")
    kinds = {int: "long", str: "string"}
    fields = asdict(config)
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in fields.items())
    spark.createDataFrame([tuple(fields.values())], schema).write.mode("overwrite").parquet(f"{path}/meta")


def load_config(spark: SparkSession, path: str) -> IndexConfig:
    """Settings that are missing take their defaults."""
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    known = IndexConfig.__dataclass_fields__
    return IndexConfig(**{k: v for k, v in meta.items() if k in known and (v is not None or k == "embedder_name")})


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, IndexConfig]:
    """Vectors or codes, cells and settings that ``save_index`` wrote."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"), load_config(spark, path)


def load_quantiser(spark: SparkSession, path: str, config: IndexConfig) -> DataFrame | None:
    return spark.read.parquet(f"{path}/quantiser") if config.index_type in ("ivf_sq", "ivf_pq") else None


def recall_at(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row: the share of exact hits that the approximate search found too."""
    same = exact.select("qid", "did").join(approximate.select("qid", "did").withColumn("hit", F.lit(1)), ["qid", "did"], "left")
    return same.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
