"""Writing stages, and keyed updates as new versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.scratch import cut


def append_stage(df: DataFrame, root: str, stage: str, batch: str | int | None = None) -> None:
    """Append to a stage's table: a folder for each batch, partitioned by forum and page where it has them.

    A batch that is written again takes the place of all that it wrote before, folders that
    it no longer fills included, so a step that is repeated after a failure adds nothing
    twice.  Without a batch each call is one of its own.
    """
    parts = [c for c in ("forum", "page") if c in df.columns]
    name = uuid.uuid4().hex if batch is None else f"b{batch}"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*parts) if parts else writer).parquet(f"{root}/{stage}/batch={name}")


def append_external(documents: DataFrame, root: str, batch: str | int | None = None) -> None:
    """Append outside documents to their three tables."""
    for stage, column in (("raw", "raw_content"), ("refined", "refined_content"), ("pure", "pure_text")):
        append_stage(documents.select("title", "url", column), root, f"{stage}_external", batch)


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``changes`` taken where a change has the key (one change for each key)."""
    columns = [c for c in changes.columns if c != key]
    marked = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__changed"))
    joined = rows.join(marked, key, "left")
    return joined.select(
        *[F.when(F.col("__changed"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    )


def write_version(df: DataFrame, root: str, stage: str, version: int) -> str:
    """Write a table's next version beside the one that is being read; returns its path."""
    path = f"{root}/{stage}_v{version}"
    parts = [c for c in ("forum", "page") if c in df.columns]
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return path


def update_partitions(spark: SparkSession, path: str, changes: DataFrame, key: str, parts: tuple[str, ...] = ("forum", "page")) -> DataFrame:
    """Update a stored table in place: only partitions that hold a changed key are written anew; returns these.

    Copy-on-write: the keys alone are read to find the partitions, whose rows are then read
    by pruned folders, updated, stored aside and put in their place by dynamic overwrite.
    A step that fails before the last leaves the table as it was, and one that is repeated
    gives the same table.
    """
    table = spark.read.parquet(path)
    touched = cut(table.select(key, *parts).join(changes.select(key).distinct(), key, "left_semi").select(*parts).distinct(), "touched")
    same = [table[p].eqNullSafe(touched[p]) for p in parts]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    rows = table.join(F.broadcast(touched), condition, "left_semi")  # a row for each partition
    new = cut(updated(rows, changes, key), "updated")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return touched
