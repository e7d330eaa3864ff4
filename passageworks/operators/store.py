"""One interface over the index types: add, train, search, save, load; and named collections."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.vectors import invalid
from passageworks.operators import index as I
from passageworks.operators.ingest import number_rows
from passageworks.session import cut_lineage, new_folder


class VectorStore:
    """Chunks and their vectors in a folder of tables, searched through an index of the configured type.

    Chunks are ``chunk_id, text, metadata map<string,string>, embedding``; each
    gets the next ``vec_id`` in the order of its ``chunk_id``.  Vectors that
    cannot be indexed are left out.  Until the index is trained, added chunks
    wait; training happens by :meth:`train`, of itself once ``train_size``
    vectors wait, or by :meth:`finalize`.  Additions are appended as tables of
    their own, so that nothing that is stored is written again.
    """

    def __init__(self, spark: SparkSession, config: I.IndexConfig, path: str | None = None):
        self.spark, self.config = spark, config
        self.path = path or new_folder(spark, "store")
        self.cells: DataFrame | None = None
        self.quantiser: DataFrame | None = None
        self._waiting: list[str] = []
        self._parts = 0
        self._size = 0

    # ------------------------------------------------------------ contents

    @property
    def is_trained(self) -> bool:
        return self.cells is not None

    @property
    def size(self) -> int:
        """Vectors that are indexed or wait."""
        return self._size

    def __len__(self) -> int:
        return self._size

    def __repr__(self) -> str:
        return f"VectorStore({self.config.index_type}, {self.config.metric}, dimension={self.config.dimension}, size={self._size}, trained={self.is_trained})"

    def chunks(self) -> DataFrame:
        """``vec_id, chunk_id, text, metadata, embedding`` of all that was added."""
        return self.spark.read.parquet(f"{self.path}/chunks")

    def index(self) -> DataFrame:
        self._need_training("searched")
        return self.spark.read.parquet(f"{self.path}/index")

    # ------------------------------------------------------------ building

    def add(self, chunks: DataFrame) -> VectorStore:
        """Appends chunks; indexes them if the index is trained, else they wait."""
        known = {f.name for f in chunks.schema}
        own = chunks.where(~invalid("embedding", self.config.dimension)).select(
            "chunk_id", F.col("text") if "text" in known else F.lit(None).cast("string").alias("text"),
            F.col("metadata") if "metadata" in known else F.lit(None).cast("map<string,string>").alias("metadata"), "embedding",
        )
        numbered = number_rows(own, [F.col("chunk_id"), F.col("text")]).select((F.col("pos") + self._size).alias("vec_id"), "chunk_id", "text", "metadata", "embedding")
        part = f"part={self._parts}"
        numbered.write.mode("overwrite").parquet(f"{self.path}/chunks/{part}")
        self._parts += 1
        self._size += self.spark.read.parquet(f"{self.path}/chunks/{part}").count()
        self._waiting.append(part)
        if self.is_trained:
            self._flush()
        elif self.config.index_type == "flat" or self._size >= self.config.train_size:
            self.train()
        return self

    def train(self, vectors: DataFrame | None = None) -> VectorStore:
        """Fits cells and codes on ``vectors`` (``vec_id, embedding``) or on what waits, and indexes what waits."""
        own = vectors if vectors is not None else self.chunks().select("vec_id", "embedding") if self._size else None
        if own is None or not own.take(1):
            raise ValueError("there is nothing to train on")
        self.cells, self.quantiser = I.train_index(own, self.config)
        self.cells = cut_lineage(self.cells)
        self._flush()
        return self

    def finalize(self) -> VectorStore:
        """Trains on whatever waits, if that has not happened; nothing added is an error."""
        return self if self.is_trained else self.train()

    def set_nprobe(self, nprobe: int) -> None:
        self.config = replace(self.config, nprobe=nprobe)

    def _flush(self) -> None:
        for part in self._waiting:
            rows = self.spark.read.parquet(f"{self.path}/chunks/{part}").select("vec_id", "embedding")
            I.encode_index(rows, self.cells, self.quantiser, self.config).write.mode("overwrite").parquet(f"{self.path}/index/{part}")
        self._waiting = []

    def _need_training(self, what: str) -> None:
        if not self.is_trained:
            raise RuntimeError(f"an index that is not trained cannot be {what}")

    # ----------------------------------------------------------- searching

    def search(self, queries: DataFrame, k: int = 10, exclude_self: bool = False, rescore: int = 4) -> DataFrame:
        """``qid, did, rk, score`` for queries ``vec_id, embedding``; codes are searched first, then vectors score again."""
        again = self.chunks().select("vec_id", "embedding") if self.quantiser is not None and rescore else None
        return I.search_index(queries, self.index(), self.cells, self.quantiser, self.config, k, exclude_self=exclude_self, vectors=again, rescore=max(rescore, 1))

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Hits with their chunk and metadata, which are joined after the cut to ``k``."""
        return self.search(queries, k).join(self.chunks().select(F.col("vec_id").alias("did"), "chunk_id", "text", "metadata"), "did")

    # -------------------------------------------------------------- saving

    def save(self, path: str) -> None:
        """Chunks, index, cells, codes and settings as tables under ``path``; refused while untrained."""
        self._need_training("saved")
        self.chunks().drop("part").write.mode("overwrite").parquet(f"{path}/chunks/part=0")
        I.save_index(self.index().drop("part"), self.cells, self.config, path, self.quantiser)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder_name: str | None = None) -> VectorStore:
        """The store saved at ``path``; fails if it was built with another embedder than the named one.  It may be added to."""
        config = I.load_config(spark, path)
        if embedder_name is not None:
            config.check_embedder(embedder_name)
        store = cls(spark, config)
        store.cells = spark.read.parquet(f"{path}/cells")
        store.quantiser = I.load_quantiser(spark, path, config)
        spark.read.parquet(f"{path}/chunks").drop("part").write.parquet(f"{store.path}/chunks/part=0")
        spark.read.parquet(f"{path}/vectors").write.parquet(f"{store.path}/index/part=0")
        store._parts, store._size = 1, spark.read.parquet(f"{path}/chunks").count()
        return store


def save_pointer(spark: SparkSession, path: str, name: str, folder: str) -> None:
    """A collection's name and the folder it lies in, as a table of one row."""
    spark.createDataFrame([(name, folder)], "collection string, folder string").write.mode("overwrite").json(path)


def open_pointer(spark: SparkSession, path: str, embedder_name: str | None = None) -> VectorStore:
    """The collection that a pointer names."""
    row = spark.read.schema("collection string, folder string").json(path).first()
    if row is None:
        raise ValueError(f"no collection is named at {path}")
    return VectorStore.load(spark, row["folder"], embedder_name)
