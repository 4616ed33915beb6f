"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
#: Shuffle files of a finished query go at once instead of when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster its absence is an error, since executors share no local disk.
    """
    key = "spark.checkpoint.dir"
    root = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set(key, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their own shuffle files when they end."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


@contextlib.contextmanager
def arrow_bytes(spark: SparkSession, most: int = 16 << 20) -> Iterator[None]:
    """Queries that run inside hand Python batches of at most ``most`` bytes, or of one row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: what follows reads the table, so neither a lost executor
    nor a second use runs the plan behind it again.  The shuffle files of the
    write go when it ends, as nothing can ask for them later.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``cut`` returned; nothing may read them any more."""
    for frame in frames:
        path = getattr(frame, "scratch_path", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(frame.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this process; call it when results are stored."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
