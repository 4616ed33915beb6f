"""The ingest plan: landed pages to raw, refined and pure threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadloom.functions import dom
from threadloom.operators import extract, threads
from threadloom.operators.crawl import EXTERNAL_RETRIES, EXTERNAL_RETRIES_OF, attempt_state, frontier
from threadloom.scratch import cut
from threadloom.sources import sinks
from threadloom.sources.http import fetch_frame, landed

KEYS = ["forum", "page", "url"]


@F.pandas_udf(StringType())
def _pure(text):
    return text.map(lambda t: dom.pure_text(t) if t is not None else None)


def raw_documents(pages: DataFrame) -> DataFrame:
    """One raw document for each thread: its first landed page."""
    first = pages.where(F.coalesce("part", F.lit(1)) == 1)
    return first.select(*KEYS, extract.page_title(F.col("raw_content")).alias("title"), "closed", "raw_content")


def refined_threads(pages: DataFrame, notes: DataFrame | None = None, slugs: DataFrame | None = None) -> DataFrame:
    """Threads assembled from landed pages (forum, page, url, part, closed, raw_content).

    ``notes`` holds discussion JSON (forum, page, url, body) that continues some
    threads; ``slugs`` (url, id, slug) names threads that are titled by them.
    A page without posts gives no thread.  Posts are stored, so that each page is
    parsed once.
    """
    posts = cut(extract.kept_links(extract.extract_posts(pages)), "posts")
    rows = posts.select(*KEYS, "part", "pos", "user", "date", "content")
    about = posts.groupBy(*KEYS).agg(
        F.min_by("title", F.struct("part", "pos")).alias("title"),
        F.max_by("closed", F.struct("part", "pos")).alias("closed"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "links"))), lambda x: x["links"])).alias("links"),
    )
    if notes is not None:
        said = extract.note_posts(notes)
        kept = extract.kept_links(said)
        rows = rows.unionByName(said.select(*KEYS, F.lit(1 << 20).alias("part"), "pos", "user", "date", "content"))
        more = kept.groupBy(*KEYS).agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "links"))), lambda x: x["links"])).alias("noted")
        )
        about = about.join(more, KEYS, "left").withColumn("links", F.concat(F.coalesce("noted", F.array().cast("array<string>")), "links"))
    if slugs is not None:
        named = slugs.select("url", F.concat_ws("_", "slug", "id").alias("__title"))
        about = about.join(named, "url", "left").withColumn("title", F.coalesce("__title", "title"))
    found = threads.assemble(rows, KEYS, ["part", "pos"])
    return found.join(about.select(*KEYS, "title", "closed", F.col("links").alias("external_urls")), KEYS)


def pure_threads(refined: DataFrame) -> DataFrame:
    """Threads with markup removed from posts and replies."""
    kept = refined.drop("external_urls").withColumn("original_post", _pure("original_post"))
    # replies are cleaned as rows, since a vectorised function can't run inside a higher-order one
    rows = kept.select(*KEYS, F.posexplode_outer(F.map_entries("replies")).alias("i", "e"))
    rows = rows.select(*KEYS, "i", F.col("e.key").alias("user"), F.posexplode_outer("e.value").alias("k", "r"))
    rows = rows.select(*KEYS, "i", "user", "k", F.col("r.date").alias("date"), _pure("r.reply").alias("reply"))
    one = rows.where("user IS NOT NULL").groupBy(*KEYS, "i", "user").agg(F.array_sort(F.collect_list(F.struct("k", "date", "reply"))).alias("rs"))
    one = one.select(*KEYS, F.struct("i", "user", F.transform("rs", lambda r: F.struct(r["date"].alias("date"), r["reply"].alias("reply"))).alias("rs")).alias("u"))
    maps = one.groupBy(*KEYS).agg(F.array_sort(F.collect_list("u")).alias("us"))
    maps = maps.select(*KEYS, F.map_from_entries(F.transform("us", lambda u: F.struct(u["user"], u["rs"]))).alias("__replies"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<struct<date:string,reply:string>>>"))
    joined = kept.join(maps, KEYS, "left")
    return joined.withColumn("replies", F.coalesce("__replies", empty)).drop("__replies")


def ingest(pages: DataFrame, root: str, notes: DataFrame | None = None, slugs: DataFrame | None = None, batch: str | int | None = None) -> DataFrame:
    """Append the three stages of landed pages to their tables; returns the stored refined threads.

    With a batch, doing it again after a failure replaces what was written.
    """
    sinks.append_stage(raw_documents(pages), root, "raw", batch)
    refined = cut(refined_threads(pages, notes, slugs), "refined")
    sinks.append_stage(refined, root, "refined", batch)
    sinks.append_stage(pure_threads(refined), root, "pure", batch)
    return refined


def crawl_listing(
    spark: SparkSession,
    forum: str,
    page: int,
    listing_url: str,
    root: str,
    closed: bool | None = None,
    external: bool = False,
    seen: DataFrame | None = None,
    batch: str | int | None = None,
    most_rounds: int = 1000,
    **options,
) -> DataFrame:
    """Fetch a listing page, its threads and what they point to, and ingest all; returns the attempts' states.

    Threads are fetched in rounds: the first pages, then the continuation pages
    that those name, until no new one is named.  Forums with notes have them
    fetched beside the threads.  With ``external``, outside pages that the threads
    link to are fetched and stored as well, but those of ``seen`` (url).  URLs stay
    in tables, each round is stored, and every URL is fetched once.  A pager that names new
    pages without end is an error after ``most_rounds``.
    """
    layout = extract.LAYOUTS[forum]
    tag = [F.lit(forum).alias("forum"), F.lit(page).cast("int").alias("page"), F.lit(closed).cast("boolean").alias("closed")]
    attempts = cut(fetch_frame(spark.createDataFrame([(listing_url,)], "url string"), **options), "listing")
    body = landed(attempts)
    slugs = None
    if layout.listing is None:
        listing = extract.listing_from_json(body.select(tag[1], F.col("raw_content").alias("body")), layout.listing_base)
        slugs = listing.select("url", "id", "slug")
    else:
        listing = extract.listing_from_html(body.select(*tag, "raw_content"))
    todo = cut(listing.select("url").distinct().select("url", F.col("url").alias("thread"), F.lit(1).alias("part")), "frontier")
    pages, fetched, rounds = None, todo.select("url"), 0
    while todo.limit(1).count():
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError(f"{listing_url}: threads name new pages after {most_rounds} rounds")
        tried = cut(fetch_frame(todo, **options), "attempts")
        attempts = attempts.union(tried)
        got = landed(tried).join(todo, "url").select(*tag[:2], F.col("thread").alias("url"), "part", tag[2], "raw_content")
        got = cut(got, "landed")
        pages = got if pages is None else pages.union(got)
        more = extract.continuations(got).select(F.col("next_url").alias("url"), F.col("url").alias("thread"), "part")
        more = more.join(fetched, "url", "left_anti").groupBy("url", "thread").agg(F.min("part").alias("part"))
        todo = cut(more, "frontier")
        fetched = fetched.union(todo.select("url"))
    if pages is None:
        return attempt_state(attempts)
    notes = None
    if layout.notes_suffix:
        asked = pages.where("part = 1").select(F.col("url").alias("thread"), F.concat("url", F.lit(layout.notes_suffix)).alias("url"))
        tried = cut(fetch_frame(asked, **options), "notes")
        attempts = attempts.union(tried)
        notes = landed(tried).join(asked, "url").select(*tag[:2], F.col("thread").alias("url"), F.col("raw_content").alias("body"))
    refined = ingest(pages, root, notes, slugs, batch)
    if external:
        found = frontier(refined.select(F.explode("external_urls").alias("url")), seen)
        retries = EXTERNAL_RETRIES_OF.get(forum, EXTERNAL_RETRIES)
        tried = cut(fetch_frame(found, **(options | {"external": True, "retries": options.get("retries", retries)})), "external")
        attempts = attempts.union(tried)
        sinks.append_external(cut(extract.external_documents(landed(tried), layout.outside_text), "documents"), root, batch)
    return attempt_state(attempts, external_retries=EXTERNAL_RETRIES_OF.get(forum, EXTERNAL_RETRIES))
