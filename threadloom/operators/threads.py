"""Threads from post rows: one shuffle by thread, the rest on sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLIES = "map<string,array<struct<date:string,reply:string>>>"


def map_key(user: Column) -> Column:
    """User names as map keys: dots become underscores."""
    return F.translate(user, ".", "_")


def assemble(posts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each thread of ``posts`` (user, date, content).

    The first post in ``order`` is the original one; ``user_list`` holds distinct
    users as first seen; replies are grouped by user, in order within a user.  Posts
    are dealt by thread once and grouped by user there, so the work is linear in
    the posts; a user without name counts as the empty name in the replies.
    """
    name = map_key(F.col("user"))
    at = F.struct(*order)
    rows = posts.select(*keys, at.alias("__at"), name.alias("__user"), F.coalesce(name, F.lit("")).alias("__name"), "date", "content")
    said = F.array_sort(F.collect_list(F.struct("__at", "date", "content")))
    by_user = rows.repartition(*keys).groupBy(*keys, "__name").agg(F.min("__user").alias("__user"), said.alias("__said"))
    entry = F.struct(F.get("__said", F.lit(0))["__at"].alias("at"), F.col("__user").alias("user"), F.col("__name").alias("name"), F.col("__said").alias("said"))
    users = by_user.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__users")).withColumn("__first", F.get("__users", F.lit(0)))
    rest = F.transform("__users", lambda u, i: F.struct(u["name"].alias("name"), F.slice(u["said"], F.when(i == 0, 2).otherwise(1), F.size(u["said"])).alias("said")))
    rest = F.array_sort(
        F.transform(
            F.filter(rest, lambda u: F.size(u["said"]) > 0),
            lambda u: F.struct(F.get(u["said"], F.lit(0))["__at"].alias("at"), u["name"].alias("name"), u["said"].alias("said")),
        )
    )
    replies = F.transform(
        rest,
        lambda u: F.struct(u["name"], F.transform(u["said"], lambda r: F.struct(r["date"].alias("date"), r["content"].alias("reply")))),
    )
    original = F.get(F.col("__first.said"), F.lit(0))
    return users.select(
        *keys,
        F.transform("__users", lambda u: u["user"]).alias("user_list"),
        original["content"].alias("original_post"),
        original["date"].alias("created_date"),
        F.col("__first.user").alias("post_creator"),
        F.map_from_entries(replies).alias("replies"),
    )


def reply_counts(threads: DataFrame) -> DataFrame:
    """(user, n) for each user of each thread's reply map."""
    return threads.select(F.explode("replies").alias("user", "rs")).select("user", F.size("rs").alias("n"))
