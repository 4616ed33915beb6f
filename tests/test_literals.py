"""Literal pages and posts: every forum layout, listings, notes, pagers, sinks, the real label rules, and a crawl of a local site."""

from __future__ import annotations

import http.server
import json
import threading

import pytest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import extract, labels
from threadloom.plans import ingest
from threadloom.plans.queries import _labels_sql, values
from threadloom.scratch import cut, scratch_path
from threadloom.sources import landed, sinks

CASES: dict = {}


def query(sql):
    def add(function):
        CASES[function.__name__] = (function, sql)
        return function

    return add


CLOUDFLARE = """<html><head><title>T</title></head><body>
<div class="topic-body crawler-post"><span class="creator" itemprop="author">a.b</span><time class="post-time">d0</time>
<div class="post">first <a href="/t/x">l</a><a href="http://o/y">m</a><a href="http://o/y">n</a><a href="/u/z">u</a></div></div>
<div class="topic-body crawler-post"><span class="creator" itemprop="author">c</span><time class="post-time">d1</time><div class="post">two</div></div>
<div class="topic-body crawler-post" role="x"><span class="creator" itemprop="author">system closed</span><time class="post-time">d2</time><div class="post">no</div></div>
<div role="navigation">next page</div></body></html>"""
OPENDNS = """<title>O</title><div class="post-meta"><a>ann</a><time>d0</time></div><div class="post-content">body</div>
<div class="comment-info"><a>bob</a><time>d1</time><section class="comment-body">hi</section></div>
<div class="comment-info"><time>d2</time><section class="comment-body">gone</section></div><p class="comment-callout">is closed</p>
<li class="pagination-last"><a href="/b?page=2">last</a></li>"""
SPICEWORKS = """<title>S</title><script data-config="topicData">{"author_name": "joe"}</script><div class="sui-opt-in root-post post">main</div>
<span data-js-postprocess="timestamp">d0</span><div class="post-content"><a>kim</a><span data-js-postprocess="timestamp">d1</span><div class="post-body">re</div></div>
<div class="sui-alert_text">locked</div>"""
COMODO = """<title>C</title><div class="windowbg"><a>u1</a><div class="smalltext">d0</div><div class="post">p0</div></div>
<div class="windowbg2"><a>u2</a><div class="smalltext">d1</div><div class="post">p1</div></div>
<div class="pagelinks floatleft"><a class="navPages" href="/2">2</a><a class="navPages" href="/3">3</a></div>"""
GITHUB = """<title>G</title><div class="js-quote-selection-container"><a href="http://o/1">x</a><a href="http://o/wiki">w</a><a href="/r">r</a></div>
<a class="d-inline-block d-md-none" href="/me"></a><a class="Link--secondary js-timestamp">d0</a>
<table><tr><td class="d-block comment-body markdown-body js-comment-body">text</td></tr></table>"""
GITLAB = """<title>L</title><div class="description">desc <a href="http://o/g">g</a></div><span class="author">x.y</span><time class="js-timeago" title="d0">ago</time>"""
UNEQUAL = GITHUB + '<a class="Link--secondary js-timestamp">d1</a>'
NOTES = json.dumps(
    [
        {"notes": [{"author": {"name": "z"}, "updated_at": "", "created_at": "c1", "note": "n1", "note_html": '<a href="http://o/n">q</a>'}]},
        {"notes": [{"author": {"name": "w"}, "updated_at": "u2", "created_at": "c2", "note": "n2", "note_html": ""}]},
    ]
)
PAGES = [
    ("cloudflare", 1, "http://f/t/a", 1, None, CLOUDFLARE), ("opendns", 1, "http://o/a", 1, None, OPENDNS), ("spiceworks", 1, "s", 1, None, SPICEWORKS),
    ("comodo", 2, "http://c/a", 1, False, COMODO), ("comodo", 2, "http://c/a", 2, False, COMODO), ("github", 1, "g", 1, True, GITHUB),
    ("github_unbound", 1, "n", 1, False, GITHUB), ("gitlab", 1, "l", 1, False, GITLAB), ("github", 1, "unequal", 1, True, UNEQUAL), ("elsewhere", 1, "u", 1, None, "x"),
]


def _pages(spark) -> DataFrame:
    return spark.createDataFrame(PAGES, "forum string, page int, url string, part int, closed boolean, raw_content string")


def _notes(spark) -> DataFrame:
    return spark.createDataFrame([("gitlab", 1, "l", NOTES)], "forum string, page int, url string, body string")


def rows(data: list[tuple], names: str) -> str:
    """Rows as SQL; None is null, and whole numbers are 32 bits."""
    say = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::INTEGER" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in data)}) v({names})"


POSTS = [
    ("cloudflare", "http://f/t/a", 1, 0, "a.b", "d0", "first lmnu", True), ("cloudflare", "http://f/t/a", 1, 1, "c", "d1", "two", True),
    ("opendns", "http://o/a", 1, 0, "ann", "d0", "body", True), ("opendns", "http://o/a", 1, 1, "bob", "d1", "hi", True),
    ("opendns", "http://o/a", 1, 2, "Permanently-Deleted-User", "d2", "gone", True),
    ("spiceworks", "s", 1, 0, "joe", "d0", "main", True), ("spiceworks", "s", 1, 1, "kim", "d1", "re", True),
    ("comodo", "http://c/a", 1, 0, "u1", "d0", "p0", False), ("comodo", "http://c/a", 1, 1, "u2", "d1", "p1", False),
    ("comodo", "http://c/a", 2, 0, "u1", "d0", "p0", False), ("comodo", "http://c/a", 2, 1, "u2", "d1", "p1", False),
    ("github", "g", 1, 0, "me", "d0", "text", True), ("github_unbound", "n", 1, 0, "me", "d0", "text", False),
    ("gitlab", "l", 1, 0, "x.y", "d0", "desc g", False),
]


@query(rows(POSTS, "forum, url, part, pos, user, date, content, closed"))
def layout_posts(spark, sf_dir):
    """Users, dates, texts and states of every layout; unequal lists and unknown forums give no row."""
    return extract.extract_posts(_pages(spark)).select("forum", "url", "part", "pos", "user", "date", "content", "closed")


@query(rows([("http://f/t/a", "T", "http://f/t/x|http://o/y"), ("g", "G", "http://o/1"), ("n", "G", "http://o/1"), ("l", "L", "http://o/g")], "url, title, links"))
def layout_links(spark, sf_dir):
    """Titles, and the outside links that each forum's rules keep."""
    kept = extract.kept_links(extract.extract_posts(_pages(spark))).where(F.size("links") > 0)
    return kept.select("url", "title", F.array_join("links", "|").alias("links"))


THREADS = [
    ("http://f/t/a", "slug_7", "a_b|c", "a_b", "d0", "first lmnu", "c:d1=two", True, "http://f/t/x|http://o/y"),
    ("http://o/a", "O", "ann|bob|Permanently-Deleted-User", "ann", "d0", "body", "Permanently-Deleted-User:d2=gone|bob:d1=hi", True, ""),
    ("s", "S", "joe|kim", "joe", "d0", "main", "kim:d1=re", True, ""),
    ("http://c/a", "C", "u1|u2", "u1", "d0", "p0", "u1:d0=p0|u2:d1=p1,d1=p1", False, ""),
    ("g", "G", "me", "me", "d0", "text", "", True, "http://o/1"), ("n", "G", "me", "me", "d0", "text", "", False, "http://o/1"),
    ("l", "L", "x_y|z|w", "x_y", "d0", "desc g", "w:u2=n2|z:c1=n1", False, "http://o/n|http://o/g"),
]


def _spelt(replies) -> F.Column:
    """A reply map as one string, users in order."""
    said = lambda rs: F.array_join(F.transform(rs, lambda r: F.concat_ws("=", r["date"], r["reply"])), ",")
    return F.array_join(F.array_sort(F.transform(F.map_entries(replies), lambda e: F.concat_ws(":", e["key"], said(e["value"])))), "|")


def _told(found: DataFrame) -> DataFrame:
    return found.select("url", "title", F.array_join("user_list", "|").alias("users"), "post_creator", "created_date", "original_post", _spelt("replies").alias("replies"), "closed")


@query(rows(THREADS, "url, title, users, post_creator, created_date, original_post, replies, closed, external"))
def layout_threads(spark, sf_dir):
    """Threads of all layouts with continuation pages, notes and titles from slugs."""
    slugs = spark.createDataFrame([("http://f/t/a", "7", "slug")], "url string, id string, slug string")
    found = ingest.refined_threads(_pages(spark), _notes(spark), slugs)
    return _told(found.withColumn("x", F.lit(1))).join(found.select("url", F.array_join("external_urls", "|").alias("external")), "url")


@query(rows([(stage, *t[:8]) for stage in ("pure", "refined") for t in THREADS], "stage, url, title, users, post_creator, created_date, original_post, replies, closed"))
def stored_stages(spark, sf_dir):
    """What the stages hold after ingest, written twice as one batch, read back with partition pruning."""
    root = scratch_path(spark, "stages")
    slugs = spark.createDataFrame([("http://f/t/a", "7", "slug")], "url string, id string, slug string")
    for _ in range(2):
        ingest.ingest(_pages(spark), root, _notes(spark), slugs, batch=1)
    found = [landed.read_stage(spark, root, stage, pages=(1, 2)) for stage in ("pure", "refined")]
    return _told(found[0]).withColumn("stage", F.lit("pure")).unionByName(_told(found[1]).withColumn("stage", F.lit("refined")))


@query(rows([("comodo", 2, 1), ("github", 1, 2), ("github_unbound", 1, 1), ("gitlab", 1, 1), ("cloudflare", 1, 1), ("opendns", 1, 1), ("spiceworks", 1, 1), ("elsewhere", 1, 1)], "forum, page, n").replace("SELECT *", "SELECT forum, page, n::BIGINT AS n"))
def stored_raw(spark, sf_dir):
    """Raw documents by partition."""
    root = scratch_path(spark, "raw")
    sinks.append_stage(ingest.raw_documents(_pages(spark)), root, "raw")
    return landed.read_stage(spark, root, "raw").groupBy("forum", "page").agg(F.count(F.lit(1)).alias("n"))


@query(rows([("l", 1, "z", "c1", "n1", "http://o/n"), ("l", 2, "w", "u2", "n2", "")], "url, pos, user, date, content, links"))
def discussion_notes(spark, sf_dir):
    """First notes of discussions; the creation date where there is no later one."""
    found = extract.note_posts(_notes(spark))
    return found.select("url", "pos", "user", "date", "content", F.array_join("links", "|").alias("links"))


@query(rows([("http://f/t/a", 2, "http://f/t/a?page=2"), ("http://o/a", 2, "http://o/b?page=2"), ("http://c/a", 2, "http://c/2"), ("http://c/a", 3, "http://c/3")], "url, part, next_url"))
def continuation_pages(spark, sf_dir):
    """Pages that thread pages name as their continuation."""
    return extract.continuations(_pages(spark)).select("url", "part", "next_url")


OWN = "/PowerDNS/pdns/issues"
LISTINGS = [
    ("github", 3, True, f'<a href="{OWN}/1">a</a><a href="{OWN}/1">b</a><a>x</a><a href="{OWN}/2?q=1">c</a><a href="/other/repo/issues/5">d</a>'),
    ("github_unbound", 1, False, f'<a href="/NLnetLabs/unbound/issues/9">a</a><a href="{OWN}/1">b</a>'),
    ("gitlab", 1, False, '<span class="issue-title-text js-onboarding-issue-item"><a href="/isc-projects/bind9/-/issues/4">a</a></span>' * 2),
    ("opendns", 2, None, '<span class="striped-list-info"><a href="/hc/1">a</a></span><span class="striped-list-info">none</span>'),
    ("spiceworks", 1, None, '<div class="listing__info"><a href="/topic/1">a</a></div>'),
    ("comodo", 1, False, '<td class="subject"><a href="http://c/1">x</a><a href="http://c/n">y</a></td>'),
]
LISTED = [
    ("github", 3, True, "https://github.com/PowerDNS/pdns/issues/1", "1"), ("github_unbound", 1, False, "https://github.com/NLnetLabs/unbound/issues/9", "9"),
    ("gitlab", 1, False, "https://gitlab.isc.org/isc-projects/bind9/-/issues/4", "4"), ("opendns", 2, None, "https://support.opendns.com/hc/1", "1"),
    ("spiceworks", 1, None, "https://community.spiceworks.com/topic/1", "1"), ("comodo", 1, False, "http://c/1", "1"),
    ("cloudflare", 5, None, "https://community.cloudflare.com/t/s/5", "5"),
]


@query(rows(LISTED, "forum, page, closed, url, id"))
def listed_threads(spark, sf_dir):
    """Threads named by listing pages of every forum, HTML and JSON."""
    found = extract.listing_from_html(spark.createDataFrame(LISTINGS, "forum string, page int, closed boolean, raw_content string"))
    body = spark.createDataFrame([(5, '{"topic_list": {"topics": [{"id": 5, "slug": "s"}]}}')], "page int, body string")
    more = extract.listing_from_json(body, extract.LAYOUTS["cloudflare"].listing_base)
    more = more.select(F.lit("cloudflare").alias("forum"), "page", F.lit(None).cast("boolean").alias("closed"), "url", "id")
    return found.select("forum", "page", "closed", "url", "id").unionByName(more)


OUTSIDE = [("u", "<title>E</title><div><p>one</p><div>x</div></div><p>two</p>"), ("v", "<p>only</p>"), ("w", None)]


@query(rows([("u", "E", "one", "one two"), ("v", "Title: Unknown", "", "only"), ("w", "Title: Unknown", "", "")], "url, title, refined_content, pure_text"))
def outside_documents(spark, sf_dir):
    """Outside pages: title, paragraphs inside a div, text; stored in three tables and joined again."""
    root = scratch_path(spark, "outside")
    pages = spark.createDataFrame(OUTSIDE, "url string, raw_content string")
    sinks.append_external(cut(extract.external_documents(pages), "outside"), root)
    refined, pure = (landed.read_stage(spark, root, s) for s in ("refined_external", "pure_external"))
    return landed.read_stage(spark, root, "raw_external").select("url", "title").join(refined.drop("title"), "url").join(pure.drop("title"), "url")


# The real rules, tier by tier: below and at each threshold, a word listed twice, bigrams, inflected forms.
REAL = [
    "slow", "slow packet", "slow slow slow", "network", "warps", "time out", "packet loss", "rate limit exceeded", "refused connection", "timeouts",
    "whois", "go daddy", "name server", "name  server", "nameservers", "registered accounts", "https", "https cert", "https tunnel", "tunnel proxy",
    "tunnel proxy filter", "firewall", "ssl tls", "phishing attacks", "ip", "ip browser", "redirect", "redirects", "website", "pages", "www",
    "resolver", "resolved", "resolving names", "mail", "emails", "email resolver whois", "the cache is cold", "", "blocked traffic and filters",
    "blocked blocked blocked", "certificate intercepted by a proxy", "loading the display", "SLOW Packet\tx", "mail.", "ns",
]
REAL_WORDS = [
    *((w, "noun") for w in ("packet", "warp", "timeout", "account", "nameserver", "attack", "redirect", "page", "email", "name", "filter", "site", "certificate", "resolver", "ns")),
    *((w, "verb") for w in ("refuse", "register", "resolve", "block", "load", "intercept", "redirect", "fail")),
    ("slow", "adjective"),
]


def _real_lemmas() -> list[tuple]:
    """(form, lemma) by the rule of the lemma table, in plain Python for the SQL side."""
    found: dict[str, str] = {}
    nouns = {w for w, part in REAL_WORDS if part == "noun"}
    for part, endings in T.DETACH.items():
        for word in sorted(w for w, kind in REAL_WORDS if kind == part):
            for ending, base in endings:
                form = word[: len(word) - len(base)] + ending if word.endswith(base) else word
                if form != word and (part == "noun" or form not in nouns):
                    found.setdefault(form, word)
    return sorted((f, w) for f, w in found.items() if f not in T.SAFE)


@query(
    f"""WITH posts AS {values(list(enumerate(REAL)), "id, text")},
{_labels_sql("posts", labels.rule_rows(), "id", lemma_rows=_real_lemmas())}
SELECT p.id, coalesce(string_agg(label, '|' ORDER BY ord), 'Unclassified') AS labels FROM posts p LEFT JOIN lab USING (id) GROUP BY p.id"""
)
def real_rules(spark, sf_dir):
    """Labels of literal posts by the real keyword rules."""
    posts = spark.createDataFrame(list(enumerate(REAL)), "id int, text string")
    found = labels.label(posts, ["id"], "text", labels.rule_table(spark), T.lemma_table(spark, REAL_WORDS))
    return found.select("id", F.array_join(labels.or_unclassified(F.col("labels")), "|").alias("labels"))


PLACED = [
    (1, "root isp firewall dns", ""), (2, "server stub resolver", "x 1.1.1.1 y"), (3, "firewall", "other"), (4, "é ü ö firewall dns", ""), (5, "é é ü firewall dns", ""),
    (6, "the tld registry and the registrar", "a DNS & Network b"), (7, "egress", "DNS & Network"), (8, "nothing here dns", ""), (9, "gateway iana ICANN", "1.1.1.1"),
]


@query(
    f"""WITH p AS {values(PLACED, "id, text, tag")},
tokens AS (SELECT id, lower(unnest(string_split(text, ' '))) AS t FROM p),
posts AS (SELECT id, text FROM p WHERE (id IN (SELECT id FROM tokens WHERE t = 'dns') OR contains(tag, 'DNS & Network') OR contains(tag, '1.1.1.1'))
  AND id NOT IN (SELECT id FROM tokens WHERE regexp_matches(t, '[^\\x00-\\x7F]') GROUP BY id HAVING count(DISTINCT t) >= 3)),
{_labels_sql("posts", labels.rule_rows(labels.location_rules()), "id", lemmas=False)}
SELECT id, string_agg(label, '|' ORDER BY label) AS locations FROM lab GROUP BY id"""
)
def tagged_locations(spark, sf_dir):
    """Resolver locations of posts that their words or their tags tell to be about DNS."""
    posts = spark.createDataFrame([(i, t, [tag]) for i, t, tag in PLACED], "id int, text string, raw_tag array<string>")
    return labels.locations(posts, "id", "text", "raw_tag").select("id", F.array_join("labels", "|").alias("locations"))


class Site:
    """A small web site on the driver: path -> list of (status, body), the last one repeated; BASE stands for its address."""

    def __init__(self, answers: dict[str, list[tuple[int, str]]], host: str = "127.0.0.1"):
        seen = self.seen = {}

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                n = seen[self.path] = seen.get(self.path, 0) + 1
                some = answers.get(self.path, [(404, "")])
                status, body = some[min(n, len(some)) - 1]
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body.replace("BASE", f"http://{host}:{self.server.server_port}").encode())

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer((host, 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://{host}:{self.server.server_port}"

    def __enter__(self) -> Site:
        return self

    def __exit__(self, *_) -> None:
        self.server.shutdown()
        self.server.server_close()


BOARD = "".join(f'<td class="subject"><a href="BASE/{x}">t</a></td>' for x in ("a", "b", "gone", "a"))
ISSUE = '<span class="issue-title-text js-onboarding-issue-item"><a href="BASE/{}">t</a></span>'
OWN_ISSUE = "isc-projects/bind9/-/issues/7"
ANSWERS = {
    "/board": [(500, ""), (200, BOARD)],
    "/a": [(500, ""), (200, COMODO.replace("/2", "/a2").replace("/3", "/a3"))],
    "/a2": [(200, COMODO.replace("/2", "/a2").replace("/3", "/a3"))],
    "/a3": [(200, COMODO.replace("/2", "/a2").replace("/3", "/a3"))],
    "/b": [(200, COMODO.partition('<div class="pagelinks')[0])],
    "/issues": [(200, ISSUE.format(OWN_ISSUE) * 2 + ISSUE.format("other/repo/-/issues/8"))],
    f"/{OWN_ISSUE}": [(200, GITLAB.replace("http://o/g", "BASE/out"))],
    f"/{OWN_ISSUE}/discussions.json": [(200, NOTES.replace("http://o/n", "BASE/photo.png"))],
    "/out": [(503, ""), (200, "<title>E</title><div><p>one</p></div><p>two</p>")],
}
CRAWLED = [
    ("attempt", "board", "2 stored"), ("attempt", "a", "2 stored"), ("attempt", "a2", "1 stored"), ("attempt", "a3", "1 stored"), ("attempt", "b", "1 stored"),
    ("attempt", "gone", "2 retry"), ("attempt", "issues", "1 stored"), ("attempt", OWN_ISSUE, "1 stored"), ("attempt", f"{OWN_ISSUE}/discussions.json", "1 stored"),
    ("attempt", "out", "2 stored"), ("thread", "a", "u1|u2 5 C"), ("thread", "b", "u1|u2 1 C"), ("thread", OWN_ISSUE, "x_y|z|w 2 L"), ("outside", "out", "E one one"),
]


@query(rows(CRAWLED, "kind, path, value"))
def crawled_site(spark, sf_dir):
    """Two listings of a local site: retries, rounds of continuation pages, notes, an outside page, stages written twice."""
    root, found = scratch_path(spark, "crawl"), None
    local = spark.sparkContext.master.startswith("local")
    with Site(ANSWERS, "127.0.0.1" if local else spark.conf.get("spark.driver.host")) as site:
        path = F.substring_index(F.col("url"), site.base + "/", -1).alias("path")
        for forum, page, address in (("comodo", 4, "board"), ("gitlab", 1, "issues")):
            states = ingest.crawl_listing(
                spark, forum, page, f"{site.base}/{address}", root, False, external=True, batch=forum, delay=0, retries=1, partitions=2, stagger=0.01
            )
            states = cut(states.select(F.lit("attempt").alias("kind"), path, F.concat_ws(" ", "attempts", "state").alias("value")), "states")
            found = states if found is None else found.union(states)
    threads = landed.read_stage(spark, root, "refined")
    n = F.aggregate(F.map_values("replies"), F.lit(0), lambda total, rs: total + F.size(rs))
    threads = threads.select(F.lit("thread"), path, F.concat_ws(" ", F.array_join("user_list", "|"), n.cast("string"), "title"))
    refined, pure = (landed.read_stage(spark, root, x) for x in ("refined_external", "pure_external"))
    outside = refined.join(pure.drop("title"), "url").select(F.lit("outside"), path, F.concat_ws(" ", "title", "refined_content", "pure_text"))
    return found.union(threads).union(outside)


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal_case(spark, name):
    duckdb = pytest.importorskip("duckdb")
    function, sql = CASES[name]
    found = function(spark, None)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    want = duckdb.connect().execute(f"SELECT {columns} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
