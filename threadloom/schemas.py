"""Declared schemas of the pipeline's tables, as DDL; every column is nullable."""

from __future__ import annotations

_REPLIES = "MAP<STRING, ARRAY<STRUCT<date: STRING, reply: STRING>>>"
_THREAD = (
    "forum STRING, page INT, title STRING, url STRING, closed BOOLEAN, user_list ARRAY<STRING>, original_post STRING, "
    f"created_date STRING, post_creator STRING, replies {_REPLIES}"
)

RAW = "forum STRING, page INT, title STRING, url STRING, closed BOOLEAN, raw_content STRING"
REFINED = (f"{_THREAD}, external_urls ARRAY<STRING>")
PURE = (
    f"_id STRING, {_THREAD}, DNS_Related BOOLEAN, Non_English BOOLEAN, labels ARRAY<STRING>, raw_tag ARRAY<STRING>, "
    "labels_v2 ARRAY<STRING>, updated BOOLEAN"
)
EXTERNAL_RAW = "title STRING, url STRING, raw_content STRING"
EXTERNAL_REFINED = "title STRING, url STRING, refined_content STRING"
EXTERNAL_PURE = "title STRING, url STRING, pure_text STRING"
RULES = "label STRING, ord INT, tier INT, kind STRING, keyword STRING, n INT, threshold INT"
LEMMAS = "form STRING, lemma STRING"

#: JSON inputs.
LISTING = "topic_list STRUCT<topics: ARRAY<STRUCT<id: BIGINT, slug: STRING>>>"
NOTES = (
    "ARRAY<STRUCT<notes: ARRAY<STRUCT<author: STRUCT<name: STRING>, updated_at: STRING, created_at: STRING, "
    "note: STRING, note_html: STRING>>>>"
)
