"""Ingest control as tables: attempts, retries, the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.urls import is_media
from threadloom.scratch import cut

#: Retries after the first attempt, for thread pages and for outside pages; forums that differ.
RETRIES, EXTERNAL_RETRIES = 3, 3
EXTERNAL_RETRIES_OF = {"cloudflare": 2}


def listing_urls(spark: SparkSession, pattern: str, first: int, last: int, step: int = 1) -> DataFrame:
    """(page, url) of listing pages first to last - 1; ``pattern`` has one %d, given page * step."""
    return spark.range(first, last).select(
        F.col("id").cast("int").alias("page"), F.format_string(pattern, F.col("id") * step).alias("url")
    )


def frontier(found: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Outside URLs to fetch: no media, each once, none of ``seen``."""
    new = found.where(~is_media(F.col("url"))).select("url").distinct()
    return new.join(seen.select("url"), "url", "left_anti") if seen is not None else new


def attempt_state(attempts: DataFrame, retries: int = RETRIES, external_retries: int = EXTERNAL_RETRIES) -> DataFrame:
    """(url, is_external, attempts, state): ``stored``, ``retry`` or ``failed``.

    An answer with an error status counts as a failed attempt.
    """
    good = F.col("error").isNull() & (F.col("status") < 400)
    most = F.when(F.col("is_external"), F.lit(external_retries)).otherwise(F.lit(retries)) + 1
    state = attempts.groupBy("url", "is_external").agg(
        F.max("attempt").alias("attempts"), F.bool_or(F.coalesce(good, F.lit(False))).alias("good")
    )
    return state.select(
        "url",
        "is_external",
        "attempts",
        F.when(F.col("good"), "stored").when(F.col("attempts") < most, "retry").otherwise("failed").alias("state"),
    )


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """Attempts and failures of each URL."""
    bad = F.col("error").isNotNull() | (F.coalesce("status", F.lit(0)) >= 400)
    return attempts.groupBy("url").agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if(bad).alias("n_failed"))


def closed_and_open(closed: DataFrame, open_: DataFrame) -> DataFrame:
    """Both listings, marked by where a thread was listed."""
    return closed.withColumn("closed", F.lit(True)).unionByName(open_.withColumn("closed", F.lit(False)))


def ingest_inputs(listing: DataFrame, pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Listed threads with their landed page and, where there is one, their notes."""
    return listing.join(pages, "url").join(notes, "url", "left")


def reachable(links: DataFrame, start: DataFrame, most: int = 100) -> DataFrame:
    """(page, round) of the pages that links (a, b) lead to from ``start`` (page), with the round that first meets each.

    Semi-naive rounds: only pages that are new in a round are followed in the next, and
    each round is stored.  ``most`` bounds the depth; it ends with an error, not with less.
    """
    links = cut(links.select("a", "b").where("b IS NOT NULL").distinct(), "links")
    new = cut(start.select("page").distinct().withColumn("round", F.lit(0)), "round")
    seen = new
    for number in range(1, most + 1):
        found = new.join(links, F.col("page") == F.col("a")).select(F.col("b").alias("page")).distinct()
        new = cut(found.join(seen.select("page"), "page", "left_anti").withColumn("round", F.lit(number)), "round")
        if not new.limit(1).count():
            return seen
        seen = seen.union(new)
    raise RuntimeError(f"pages are left after {most} rounds")
