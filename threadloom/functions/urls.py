"""Column functions on URLs."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def slug_and_id(url: Column) -> Column:
    """The last two path segments as a struct (id, slug)."""
    parts = F.split(url, "/")
    return F.struct(F.try_element_at(parts, F.lit(-1)).alias("id"), F.try_element_at(parts, F.lit(-2)).alias("slug"))


def page_number(url: Column) -> Column:
    """Text after the last ``=``."""
    return F.substring_index(url, "=", -1)


def is_media(url: Column) -> Column:
    """Whether an image or document ending occurs anywhere in the URL."""
    return url.rlike("png|jpg|pdf|jpeg")


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` resolved against ``base``; null when either is null."""
    return pd.Series([urljoin(b, h) if b is not None and h is not None else None for b, h in zip(base, href)], dtype=object)


def allowed(url: Column, disallowed: list[str]) -> Column:
    """Whether the URL starts with ``http`` and holds none of the strings."""
    kept = url.startswith("http")
    for part in disallowed:
        kept = kept & ~url.contains(part)
    return F.coalesce(kept, F.lit(False))


def allowed_links(links: Column, disallowed: list[str]) -> Column:
    return F.filter(links, lambda u: allowed(u, disallowed))
