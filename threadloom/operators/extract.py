"""Posts, titles, flags and links from landed forum pages.

What differs between forums is data: a ``Layout`` names the elements that hold
posts, authors, dates and bodies.  One function applies a layout to a page;
pages are parsed in Arrow batches, and everything after that is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import dom
from threadloom.functions.urls import allowed_links
from threadloom.schemas import LISTING, NOTES

Selector = tuple[str, dict]
#: Name of a user whose account is gone (fixed value).
DELETED = "Permanently-Deleted-User"


@dataclass(frozen=True)
class Layout:
    """Where a forum's pages hold what.

    ``post``, and inside of it ``user``, ``date``, ``body``; ``head_*`` for an
    original post that is marked up in another way; ``parallel`` when users, dates
    and bodies are three lists of the whole page; ``closed`` is the element whose
    last occurrence tells the thread's state, by the word ``closed_word``;
    ``outside_text`` the elements whose text is that of an outside page.
    """

    post: Selector | None = None
    user: Selector | None = None
    date: Selector | None = None
    body: Selector | None = None
    head: dict[str, Selector] = field(default_factory=dict)
    parallel: bool = False
    drop_last_with: str | None = None
    missing_user: str | None = None
    stripped: bool = True
    closed: Selector | None = None
    closed_word: str = "closed"
    links: Selector | None = None
    disallowed: tuple[str, ...] = ()
    join_links: bool = False
    distinct_links: bool = False
    listing: Selector | None = None
    listing_must: str = ""
    listing_never: str = "\0"
    listing_base: str = ""
    listing_key: str | None = None
    notes_suffix: str | None = None
    outside_text: str = "div"


# Selectors and link rules of the supported forums (fixed values).
LAYOUTS = {
    "cloudflare": Layout(
        post=("div", {"class": "topic-body crawler-post"}),
        user=("span", {"class": "creator"}),
        date=("time", {"class": "post-time"}),
        body=("div", {"class": "post"}),
        drop_last_with="role",
        closed=("span", {"class": "creator", "itemprop": "author"}),
        links=("div", {"class": "post"}),
        disallowed=(
            "/admin/", "/auth/", "/email/", "/session", "/user-api-key", "/badges", "/u/", "/my", "/search", "/g", ".rss",
        ),
        join_links=True,
        distinct_links=True,
        listing_base="https://community.cloudflare.com/t/",
        outside_text="p",
    ),
    "opendns": Layout(
        post=("div", {"class": "comment-info"}),
        user=("a", {}),
        date=("time", {}),
        body=("section", {"class": "comment-body"}),
        head={
            "user": ("div.a", {"class": "post-meta"}),
            "date": ("div.time", {"class": "post-meta"}),
            "body": ("div", {"class": "post-content"}),
        },
        missing_user=DELETED,
        stripped=False,
        closed=("p", {"class": "comment-callout"}),
        listing=("span", {"class": "striped-list-info"}),
        listing_base="https://support.opendns.com",
    ),
    "spiceworks": Layout(
        post=("div", {"class": "post-content"}),
        user=("a", {}),
        date=("span", {"data-js-postprocess": "timestamp"}),
        body=("div", {"class": "post-body"}),
        head={
            "user": ("script", {"data-config": "topicData"}),
            "date": ("span", {"data-js-postprocess": "timestamp"}),
            "body": ("div", {"class": "sui-opt-in root-post post"}),
        },
        missing_user=DELETED,
        closed=("div", {"class": "sui-alert_text"}),
        closed_word="locked",
        listing=("div", {"class": "listing__info"}),
        listing_base="https://community.spiceworks.com",
    ),
    "comodo": Layout(
        post=("div", {"class": ["windowbg", "windowbg2"]}),
        user=("a", {}),
        date=("div", {"class": "smalltext"}),
        body=("div", {"class": "post"}),
        stripped=False,
        listing=("td", {"class": "subject"}),
    ),
    "github": Layout(
        parallel=True,
        user=("a", {"class": "d-inline-block d-md-none"}),
        date=("a", {"class": "Link--secondary js-timestamp"}),
        body=("td", {"class": "d-block comment-body markdown-body js-comment-body"}),
        links=("div", {"class": "js-quote-selection-container"}),
        disallowed=(
            "/pulse", "/tree/", "/wiki", "/gist/", "/forks", "/stars", "/download", "/revisions", "/issues/new",
            "/issues/search", "/commits/", "/branches", "/tags", "/contributors", "/comments", "/stargazers", "/archive/",
            "/blame/", "/watchers", "/network", "/graphs", "/raw/", "/compare/", "/cache/", "/.git/", "/search/advanced",
        ),
        listing=("a", {}),
        listing_must="/PowerDNS/pdns/issues/",
        listing_never="?",
        listing_base="https://github.com/PowerDNS/pdns/issues/",
        listing_key="url",
    ),
    "gitlab": Layout(
        head={
            "user": ("span", {"class": "author"}),
            "date": ("time@title", {"class": "js-timeago"}),
            "body": ("div", {"class": "description"}),
        },
        stripped=False,
        links=("div", {"class": "description"}),
        disallowed=(
            "/autocomplete/users", "/autocomplete/projects", "/search", "/admin", "/profile", "/dashboard", "/users",
            "/help", "/s/", "/-/profile", "/-/ide/", "/new", "/edit", "/raw", "/realtime_changes",
        ),
        listing=("span", {"class": "issue-title-text js-onboarding-issue-item"}),
        listing_must="/isc-projects/bind9/-/issues/",
        listing_base="https://gitlab.isc.org/",
        listing_key="id",
        notes_suffix="/discussions.json",
    ),
}
# A second project on the same site: same pages, another listing (fixed values).
LAYOUTS["github_unbound"] = replace(
    LAYOUTS["github"], listing_must="NLnetLabs/unbound/issues/", listing_base="https://github.com/NLnetLabs/unbound/issues"
)


def _find(node: dom.Node, selector: Selector) -> dom.Node | None:
    """First match; ``a.b`` in the tag looks for b inside the first a."""
    outer, _, inner = selector[0].partition("@")[0].partition(".")
    found = next((n for n in node.walk() if n.matches(outer, selector[1])), None)
    return found.find(inner) if found and inner else found


def _all(root: dom.Node, selector: Selector) -> list[dom.Node]:
    return [n for n in root.walk() if n.matches(*selector)]


def _value(node: dom.Node | None, selector: Selector, stripped: bool) -> str | None:
    if node is None:
        return None
    text = node.attrs.get(selector[0].partition("@")[2]) if "@" in selector[0] else node.text
    return text.strip() if text is not None and stripped else text


def posts_of(root: dom.Node, layout: Layout, first_part: bool = True) -> list[tuple]:
    """(user, date, content) in page order."""
    rows = []
    if layout.head and first_part:
        head = {k: _value(_find(root, s), s, layout.stripped or k != "body") for k, s in layout.head.items()}
        if layout.head["user"][0] == "script" and head["user"]:
            head["user"] = json.loads(head["user"]).get("author_name")
        if head["body"] is not None:
            rows.append((head["user"], head["date"], head["body"]))
    if layout.parallel:
        lists = [_all(root, s) for s in (layout.user, layout.date, layout.body)]
        if len({len(x) for x in lists}) == 1:
            rows += [(u.attrs.get("href", "")[1:].strip(), d.text.strip(), b.text.strip()) for u, d, b in zip(*lists)]
    elif layout.post:
        nodes = _all(root, layout.post)
        if nodes and layout.drop_last_with and layout.drop_last_with in nodes[-1].attrs:
            nodes = nodes[:-1]
        for node in nodes:
            user, date, body = (_value(_find(node, s), s, True) for s in (layout.user, layout.date, layout.body))
            if not layout.stripped:
                body = _value(_find(node, layout.body), layout.body, False)
            rows.append((user if user is not None else layout.missing_user, date, body))
    return rows


def links_of(root: dom.Node, layout: Layout) -> list[str]:
    if not layout.links:
        return []
    found = [a.attrs["href"] for box in _all(root, layout.links) for a in box.find_all("a") if a.attrs.get("href")]
    return found


PAGE = "forum string, page int, url string, part int, title string, closed boolean, links array<string>"
POSTS = f"{PAGE}, pos int, user string, date string, content string"


def extract_posts(pages: DataFrame) -> DataFrame:
    """One row for each post of ``pages`` (forum, page, url, part, closed, raw_content).

    ``part`` numbers the continuation pages of a thread from 1.  A page of an
    unknown forum, or without posts, gives no row.  ``closed`` as given stays
    unless the forum's pages tell it.
    """
    from urllib.parse import urljoin

    names = [x.split()[0] for x in POSTS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for row in batch.to_pylist():
                layout = LAYOUTS.get(row["forum"])
                if not layout:
                    continue
                root = dom.parse(row["raw_content"])
                links = links_of(root, layout)
                if layout.join_links:
                    links = [urljoin(row["url"] or "", u) for u in links]
                closed = row["closed"]
                if layout.closed and (flags := _all(root, layout.closed)):
                    closed = layout.closed_word in flags[-1].text
                for pos, (user, date, content) in enumerate(posts_of(root, layout, (row["part"] or 1) == 1)):
                    values = (row["forum"], row["page"], row["url"], row["part"], dom.title_of(root), closed, links if pos == 0 else [], pos, user, date, content)
                    for name, value in zip(names, values):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_schema())

    return pages.select("forum", "page", "url", "part", "closed", "raw_content").mapInArrow(run, POSTS)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in POSTS.split(", ")])


def kept_links(posts: DataFrame) -> DataFrame:
    """``posts`` with ``links`` held to each forum's rules."""
    kept = F.array().cast("array<string>")
    for forum, layout in LAYOUTS.items():
        if layout.links:
            own = allowed_links(F.col("links"), list(layout.disallowed))
            own = F.array_distinct(own) if layout.distinct_links else own
            kept = F.when(F.col("forum") == forum, own).otherwise(kept)
    return posts.withColumn("links", kept)


def note_posts(discussions: DataFrame) -> DataFrame:
    """Posts from discussion JSON (forum, page, url, body): the first note of each discussion.

    The date is the update time, or the creation time when that is empty.
    """
    note = F.get(F.col("d.notes"), F.lit(0))
    rows = discussions.select("*", F.posexplode(F.from_json("body", NOTES)).alias("pos", "d"))
    return rows.select(
        "forum",
        "page",
        "url",
        (F.col("pos") + 1).alias("pos"),
        note["author"]["name"].alias("user"),
        F.coalesce(F.nullif(note["updated_at"], F.lit("")), note["created_at"]).alias("date"),
        note["note"].alias("content"),
        hrefs(note["note_html"]).alias("links"),
    )


# Parts of pages that regular markup allows to read without a tree


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))


def page_title(html: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("")), F.lit("Title: Unknown"))


# Listings


def listing_from_json(listings: DataFrame, base: str) -> DataFrame:
    """(url, id, slug) of the topics in listing JSON (page, body)."""
    rows = listings.select("page", F.explode(F.from_json("body", LISTING)["topic_list"]["topics"]).alias("t"))
    url = F.concat(F.lit(base), F.col("t.slug"), F.lit("/"), F.col("t.id").cast("string"))
    return rows.select("page", url.alias("url"), F.col("t.id").cast("string").alias("id"), F.col("t.slug").alias("slug"))


def listing_from_html(listings: DataFrame) -> DataFrame:
    """(forum, page, closed, url, id) of thread links in listing pages (forum, page, closed, raw_content).

    Anchors without target are skipped; forums that name a key are held to one
    row for each key in a page of listings.
    """
    from urllib.parse import urljoin

    schema = "forum string, page int, closed boolean, pos int, url string, id string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                layout = LAYOUTS[row["forum"]]
                seen = set()
                for pos, node in enumerate(_all(dom.parse(row["raw_content"]), layout.listing)):
                    anchor = node if node.tag == "a" else node.find("a")
                    href = anchor.attrs.get("href") if anchor else None
                    if not href or layout.listing_must not in href or layout.listing_never in href:
                        continue
                    last = href.rsplit("/", 1)[-1]
                    key = {"url": href, "id": last}.get(layout.listing_key)
                    if key is not None and key in seen:
                        continue
                    seen.add(key)
                    out.append((row["forum"], row["page"], row["closed"], pos, urljoin(layout.listing_base, href), last))
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return listings.select("forum", "page", "closed", "raw_content").mapInArrow(run, schema)


def external_documents(pages: DataFrame, pure_of: str = "p") -> DataFrame:
    """(title, url, raw_content, refined_content, pure_text) of fetched outside pages (url, raw_content).

    Refined content is the text of the paragraphs inside a ``div``; ``pure_of`` names the elements
    whose text is the pure text, ``p`` or ``div``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("title", "url", "raw_content", "refined_content", "pure_text")
        for batch in batches:
            out = {n: [] for n in names}
            for url, html in zip(batch.column("url").to_pylist(), batch.column("raw_content").to_pylist()):
                root = dom.parse(html)
                boxes = root.find_all(pure_of)
                inner = {id(n) for b in boxes for n in b.walk()}
                pure = " ".join(" ".join(b.text for b in boxes if id(b) not in inner).split())
                inside = {id(n) for box in root.find_all("div") for n in box.walk()}
                paragraphs = "\n".join(p.text.strip() for p in root.find_all("p") if id(p) in inside)
                for name, value in zip(names, (dom.title_of(root), url, html, paragraphs, pure)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.string()) for n in names]))

    return pages.select("url", "raw_content").mapInArrow(run, "title string, url string, raw_content string, refined_content string, pure_text string")


# Continuation pages

# Where a forum's thread pages name further ones (fixed values): an element, and what to do with it.
PAGERS: dict[str, tuple[str, Selector]] = {
    "cloudflare": ("count", ("div", {"role": "navigation"})),
    "opendns": ("link", ("li", {"class": "pagination-last"})),
    "spiceworks": ("link", ("nav", {"class": "sui-pagination"})),
    "comodo": ("links", ("div", {"class": "pagelinks floatleft"})),
}


def continuations(pages: DataFrame) -> DataFrame:
    """(forum, page, url, part, next_url) of pages that thread pages point to, for the next round of fetching.

    A counted pager names part + 1 while it says ``next``; a linking one names its
    first link; a list of links names them all, from the first part only.  Rounds
    end when no new URL is found, so a pager that points back can't loop.
    """
    from urllib.parse import urljoin

    schema = "forum string, page int, url string, part int, next_url string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["forum"] not in PAGERS:
                    continue
                how, selector = PAGERS[row["forum"]]
                part, root = row["part"] or 1, dom.parse(row["raw_content"])
                box = _find(root, selector)
                if box is None:
                    continue
                if how == "count":
                    found = [(part + 1, f"{row['url']}?page={part + 1}")] if "next" in box.text else []
                else:
                    anchors = box.find_all("a", class_="navPages") if how == "links" else box.find_all("a")[:1]
                    hrefs_ = [a.attrs["href"] for a in anchors if a.attrs.get("href")]
                    hrefs_ = [] if how == "links" and part > 1 else list(dict.fromkeys(hrefs_))
                    found = [(part + i, urljoin(row["url"] or "", h)) for i, h in enumerate(hrefs_, 1)]
                out += [(row["forum"], row["page"], row["url"], p, u) for p, u in found]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return pages.select("forum", "page", "url", "part", "raw_content").mapInArrow(run, schema)
