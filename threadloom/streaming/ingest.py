"""Continuous ingest: landed files as a stream, appended stage by stage.

An extension of the batch plan: a file stream of landed pages is deduplicated
by URL within a watermark and each micro-batch goes through ``plans.ingest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.plans.ingest import ingest
from threadloom.scratch import cut

LANDED = "forum string, page int, url string, part int, closed boolean, raw_content string, fetched timestamp"


def landed_stream(spark: SparkSession, path: str, files: int = 100, late: str = "1 hour") -> DataFrame:
    """New landed pages under ``path`` (JSON lines), each (url, part) once within the watermark."""
    rows = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).json(path)
    return rows.withWatermark("fetched", late).dropDuplicatesWithinWatermark(["url", "part"])


def start(stream: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append every micro-batch to the stages under ``root``; one that is replayed replaces what it wrote."""

    def store(rows: DataFrame, number: int) -> None:
        ingest(cut(rows.drop("fetched"), "batch"), root, batch=number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(stream: DataFrame, every: str = "10 minutes") -> DataFrame:
    """Pages landed of each forum in each window of time."""
    return stream.groupBy(F.window("fetched", every).alias("w"), "forum").agg(F.count(F.lit(1)).alias("n_pages"))
