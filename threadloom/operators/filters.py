"""Predicates on posts and tokens, as columns; null counts as false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import is_ascii, is_plain_word, lemmatize, raw_tokens, sent, year_of

# Labels of posts that are left out or not yet labelled (fixed values).
OTHER_LANGUAGES = "Other Languages"
GENERAL = "General DNS & Network Issues"


def held(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def relevant_post(years: tuple[str, ...] = ("2020", "2021")) -> Column:
    """Related posts in English of the given years."""
    return (
        held(F.col("DNS_Related"))
        & ~held(F.array_contains("labels", OTHER_LANGUAGES))
        & held(year_of(F.col("created_date")).isin(*years))
        & ~held(F.col("Non_English"))
    )


def unclassified(labels: Column) -> Column:
    return held(F.array_contains(labels, "Others") | (labels == F.array(F.lit(GENERAL))))


def about_dns(tokens: Column, raw_tag: Column) -> Column:
    """The token ``dns``, or a tag that tells so."""
    tags = F.array_join(raw_tag, "\n")
    return held(F.array_contains(tokens, "dns")) | held(tags.contains("DNS & Network")) | held(tags.contains("1.1.1.1"))


def foreign_text(tokens: Column, limit: int = 3) -> Column:
    """At least ``limit`` distinct tokens outside of ASCII."""
    return F.size(F.filter(F.array_distinct(tokens), lambda t: ~is_ascii(t))) >= limit


def clean_tokens(df: DataFrame, text: str, stop_words: DataFrame | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """(all columns but ``text``, pos, token): lemmas without stop words and of a to z only, empty ones dropped."""
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(raw_tokens(F.col(text))).alias("pos", "token"))
    if lemmas is not None:
        rows = lemmatize(rows, "token", lemmas)
    rows = rows.where(is_plain_word(F.col("token")) & (F.col("token") != ""))
    if stop_words is not None:
        rows = rows.join(sent(stop_words.select(F.col("word").alias("token"))), "token", "left_anti")
    return rows
