"""Landed tables: one table for each stage, partitioned by forum and listing page."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schemas

STAGES = {
    "raw": schemas.RAW,
    "refined": schemas.REFINED,
    "pure": schemas.PURE,
    "raw_external": schemas.EXTERNAL_RAW,
    "refined_external": schemas.EXTERNAL_REFINED,
    "pure_external": schemas.EXTERNAL_PURE,
}


def between(df: DataFrame, column: str, first, last) -> DataFrame:
    """Rows with first <= column <= last; on a partition column only those folders are read."""
    return df.where(F.col(column).between(first, last))


def read_stage(spark: SparkSession, root: str, stage: str, forum: str | None = None, pages: tuple[int, int] | None = None, fmt: str = "parquet") -> DataFrame:
    """A stage's table with its declared schema; ``pages`` is an inclusive range."""
    rows = spark.read.schema(STAGES[stage]).format(fmt).load(f"{root}/{stage}")
    rows = rows.select(*[c for c in rows.columns if c != "batch"])
    if forum is not None:
        rows = rows.where(F.col("forum") == forum)
    return between(rows, "page", *pages) if pages else rows


def stop_words(spark: SparkSession, language: str = "english") -> DataFrame:
    return spark.createDataFrame([(w,) for w in StopWordsRemover.loadDefaultStopWords(language)], "word string")
