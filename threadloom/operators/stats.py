"""Corpus and user statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import raw_tokens, sent
from threadloom.scratch import cut


def _counted(texts: DataFrame, key: str, parts: Column, name: str) -> DataFrame:
    """(key, name, n): how often each of an array of strings occurs in all rows of one key; a null array has none.

    Equal parts are counted inside the row: sorted, a part's count is the way to the next other one.
    Only rows whose key comes again are grouped, so what is shuffled is keys, not parts.
    """
    again = cut(texts.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(key).alias("__key")), "repeated-keys")
    rows = texts.select(key, F.coalesce(F.sort_array(parts), F.array().cast("array<string>")).alias("__s"))
    ends = F.array_compact(F.transform("__s", lambda x, i: F.when(~F.get("__s", i + 1).eqNullSafe(x), i + 1)))
    rows = rows.select(key, "__s", ends.alias("__ends"))
    count = lambda end, i: (end - F.coalesce(F.get("__ends", i - 1), F.lit(0))).cast("long")
    each = F.transform("__ends", lambda end, i: F.struct(F.get("__s", end - 1).alias(name), count(end, i).alias("n")))
    each = rows.select(key, F.inline(each))
    if not again.limit(1).count():
        return each
    same = F.col(key).eqNullSafe(F.col("__key"))
    once, more = each.join(sent(again), same, "left_anti"), each.join(sent(again), same, "left_semi")
    return once.unionByName(more.groupBy(key, name).agg(F.sum("n").alias("n")))


def token_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of the tokens of each text, made inside the row."""
    return _counted(texts, key, raw_tokens(F.col(text)), "token")


def bigram_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of adjacent tokens of each text, made inside the row."""
    tokens = F.col("__t")
    pairs = F.transform(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit(" "), F.get(tokens, i + 1))
    )
    return _counted(texts.select(key, raw_tokens(F.col(text)).alias("__t")), key, pairs, "bigram")


def user_replies(counts: DataFrame) -> DataFrame:
    """(user, n_replies) from per-thread counts (user, n)."""
    return counts.groupBy("user").agg(F.sum("n").cast("long").alias("n_replies"))


def user_summary(counts: DataFrame) -> DataFrame:
    """One row: users, replies, replies for each user (null without users)."""
    users = user_replies(counts)
    return users.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.coalesce(F.sum("n_replies"), F.lit(0)).alias("n_replies"),
        F.try_divide(F.sum("n_replies").cast("double"), F.count(F.lit(1))).alias("replies_per_user"),
    )


def user_ranking(counts: DataFrame, top: int | None = None, seen: str | None = None) -> DataFrame:
    """Users by replies, most first; ties in order of ``seen`` (a column that tells when a row came), then of name."""
    if seen is None:
        ranked = user_replies(counts).orderBy(F.desc("n_replies"), "user")
    else:
        first = counts.groupBy("user").agg(F.sum("n").cast("long").alias("n_replies"), F.min(seen).alias("__seen"))
        ranked = first.orderBy(F.desc("n_replies"), "__seen", "user").drop("__seen")
    return ranked.limit(top) if top else ranked


def first_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def vocabulary(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, df, cf): documents and occurrences of every token."""
    return (
        tokens.groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    )


def label_posts_with(posts: DataFrame, label: str, labels: str = "labels") -> DataFrame:
    return posts.where(F.array_contains(labels, label))
