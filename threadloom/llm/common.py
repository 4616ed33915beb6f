"""Shared pieces: table access and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.scratch import cut, discard, release, scratch_path  # noqa: F401  (used by the operators)

#: Rows in one Arrow batch, and bytes in what an operator takes at once; one longer row is taken alone.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Batches of a worker between calls that give memory back.
TRIM_EVERY = 16
_BATCHES = itertools.count(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its row groups are its scan's tasks, and no whole row goes through an exchange for it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``; a smaller one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000") or 10000)
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key, None) or "").rstrip("bB")
    if not now or now.isdigit() and int(now) > 4 * BATCH_BYTES:
        spark.conf.set(key, str(4 * BATCH_BYTES))


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``most`` bytes, or of one row, in order."""
    todo = [batch] if batch.num_rows else []
    while todo:
        part = todo.pop()
        if part.num_rows == 1 or part.nbytes <= most:
            yield part
        else:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]


@functools.cache
def _trim():
    """The C library's call that gives free memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """Give a worker's free memory back to the system; at the end of a task's work, as workers are kept."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@contextlib.contextmanager
def paused_collection():
    """No cyclic garbage collection inside: a batch makes many small objects and no cycles.

    Every few times free memory is given back, so that a reused worker doesn't
    hold the largest batch of every stage that it ever ran.
    """
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
        if next(_BATCHES) % TRIM_EVERY == 0:
            _trim()(0)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``function(batch) -> dict of columns`` over Arrow batches of ``df``, at most BATCH_BYTES at once."""
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                with paused_collection():
                    out = function(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)
        _trim()(0)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def unsigned_crc32(column) -> F.Column:
    """crc32 of the UTF-8 bytes of a string column, null as the empty string."""
    return F.crc32(F.coalesce(column, F.lit("")))
