"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Folders of this session that are still to be deleted.
_FOLDERS: list[str] = []
#: Largest side, in rows, that an operator may broadcast after counting it; each has another way beyond that.
BROADCAST_ROWS = 200_000


def get_session(app: str = "passageworks", cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a running session wins."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local master, whose executors are this machine, gets a temporary
    one where none is named; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="passageworks-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name beside the checkpoints; :func:`clear_folders` deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def clear_folders(spark: SparkSession) -> None:
    """Deletes what loops and queries of this session have written to the shared folder; results that read it must be used before."""
    while _FOLDERS:
        _delete(spark, _FOLDERS.pop())


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame, old: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path; the table at ``old`` is dropped after that.

    Unlike a checkpoint, what is read back carries the size of its files, not
    an estimate made from the sizes of all plans before it: loops whose joins
    feed the next round need that.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    if old:
        _delete(spark, old)
        _FOLDERS.remove(old)
    return spark.read.schema(df.schema).parquet(path), path


def by_blocks(spark: SparkSession, name: str, count: int, one: Callable[[int], tuple[DataFrame, Broadcast]]) -> DataFrame:
    """The results of ``count`` blocks; ``one(i)`` gives that of a block and the broadcast that it needs.

    One block is worked on when the result is used.  More are worked on one
    after the other, each written to a table in the shared folder, after which
    its broadcast is released, so that the driver never holds more than one.
    """
    if count == 1:
        return one(0)[0]
    path, schema = new_folder(spark, name), None
    for i in range(count):
        part, shared = one(i)
        part.write.mode("append").parquet(path)
        schema = part.schema
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
