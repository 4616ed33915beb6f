"""Small hand-written pages for every forum layout."""

import json

from pyspark.sql import functions as F
from test_literals import Site

from threadloom.functions import dom
from threadloom.operators import extract
from threadloom.plans import ingest
from threadloom.sources import landed

CF = """<html><head><title>T</title></head><body>
<div class="topic-body crawler-post"><span class="creator" itemprop="author">a.b</span><time class="post-time">d0</time>
<div class="post"> first <a href="/t/x">l</a><a href="http://o/y">m</a><a href="http://o/y">n</a><a href="/u/z">u</a></div></div>
<div class="topic-body crawler-post"><span class="creator" itemprop="author">c</span><time class="post-time">d1</time><div class="post">two</div></div>
<div class="topic-body crawler-post" role="x"><span class="creator" itemprop="author">system closed</span><time class="post-time">d2</time><div class="post">no</div></div>
</body></html>"""
OD = """<title>O</title><div class="post-meta"><a> ann </a><time>d0</time></div><div class="post-content"> body </div>
<div class="comment-info"><a>bob</a><time>d1</time><section class="comment-body"> hi </section></div>
<div class="comment-info"><time>d2</time><section class="comment-body">gone</section></div><p class="comment-callout">x</p><p class="comment-callout">is closed</p>"""
SW = """<title>S</title><script data-config="topicData">{"author_name": "joe"}</script><div class="sui-opt-in root-post post"> main </div>
<span data-js-postprocess="timestamp">d0</span><div class="post-content"><a>kim</a><span data-js-postprocess="timestamp">d1</span><div class="post-body"> re </div></div>
<div class="sui-alert_text">locked</div>"""
CO = """<title>C</title><div class="windowbg"><a>u1</a><div class="smalltext">d0</div><div class="post"> p0 </div></div>
<div class="windowbg2"><a>u2</a><div class="smalltext">d1</div><div class="post">p1</div></div>"""
GH = """<title>G</title><div class="js-quote-selection-container"><a href="http://o/1">x</a><a href="http://o/wiki">w</a><a href="/r">r</a><a href="http://o/1">x</a><a>none</a></div>
<a class="d-inline-block d-md-none" href="/me"></a><a class="Link--secondary js-timestamp">d0</a>
<table><tr><td class="d-block comment-body markdown-body js-comment-body"> text </td></tr></table>"""
GL = """<title>L</title><div class="description">desc <a href="http://o/g">g</a></div><span class="author">x.y</span><time class="js-timeago" title="d0">ago</time>"""
NOTES = json.dumps(
    [
        {"notes": [{"author": {"name": "z"}, "updated_at": "", "created_at": "c1", "note": "n1", "note_html": '<a href="http://o/n">q</a>'}]},
        {"notes": [{"author": {"name": "w"}, "updated_at": "u2", "created_at": "c2", "note": "n2", "note_html": ""}]},
    ]
)


def pages(spark):
    rows = [
        ("cloudflare", 1, "http://f/t/a", 1, None, CF), ("opendns", 1, "o", 1, None, OD), ("spiceworks", 1, "s", 1, None, SW),
        ("comodo", 1, "c", 1, False, CO), ("comodo", 1, "c", 2, False, CO), ("github", 1, "g", 1, True, GH), ("gitlab", 1, "l", 1, False, GL),
        ("github", 1, "bad", 1, True, GH + '<a class="Link--secondary js-timestamp">d1</a>'), ("comodo", 1, "none", 1, False, None), ("zzz", 1, "u", 1, None, "x"),
    ]
    return spark.createDataFrame(rows, "forum string, page int, url string, part int, closed boolean, raw_content string")


def test_posts_of_every_layout(spark):
    found = extract.kept_links(extract.extract_posts(pages(spark))).orderBy("url", "part", "pos").collect()
    by = {}
    for r in found:
        by.setdefault((r["forum"], r["url"]), []).append((r["user"], r["date"], r["content"]))
    assert by[("cloudflare", "http://f/t/a")] == [("a.b", "d0", "first lmnu"), ("c", "d1", "two")]
    assert by[("opendns", "o")] == [("ann", "d0", " body "), ("bob", "d1", " hi "), ("Permanently-Deleted-User", "d2", "gone")]
    assert by[("spiceworks", "s")] == [("joe", "d0", "main"), ("kim", "d1", "re")]
    assert by[("comodo", "c")] == [("u1", "d0", " p0 "), ("u2", "d1", "p1")] * 2
    assert by[("github", "g")] == [("me", "d0", "text")]
    assert by[("gitlab", "l")] == [("x.y", "d0", "desc g")]
    assert ("github", "bad") not in by and ("zzz", "u") not in by
    first = {r["url"]: r for r in found if r["pos"] == 0 and r["part"] == 1}
    assert first["http://f/t/a"]["links"] == ["http://f/t/x", "http://o/y"] and first["http://f/t/a"]["closed"]
    assert first["o"]["closed"] and first["s"]["closed"] and first["o"]["links"] == []
    assert first["g"]["links"] == ["http://o/1", "http://o/1"]


def test_refined_and_pure(spark, tmp_path):
    notes = spark.createDataFrame([("gitlab", 1, "l", NOTES)], "forum string, page int, url string, body string")
    slugs = spark.createDataFrame([("http://f/t/a", "7", "slug")], "url string, id string, slug string")
    ingest.ingest(pages(spark), str(tmp_path), notes, slugs)
    refined = {r["url"]: r for r in landed.read_stage(spark, str(tmp_path), "refined").collect()}
    assert refined["http://f/t/a"]["title"] == "slug_7" and refined["http://f/t/a"]["user_list"] == ["a_b", "c"]
    g = refined["l"]
    assert g["user_list"] == ["x_y", "z", "w"] and g["external_urls"] == ["http://o/n", "http://o/g"]
    assert {k: [tuple(x) for x in v] for k, v in g["replies"].items()} == {"z": [("c1", "n1")], "w": [("u2", "n2")]}
    assert len(refined["c"]["replies"]["u2"]) == 2 and len(refined["c"]["replies"]["u1"]) == 1
    pure = {r["url"]: r for r in landed.read_stage(spark, str(tmp_path), "pure", "comodo", (1, 1)).collect()}
    assert pure["c"]["original_post"] == "p0" and pure["c"]["replies"]["u2"][0]["reply"] == "p1"
    assert landed.read_stage(spark, str(tmp_path), "raw").count() == 9


def test_listings(spark):
    mine = "/PowerDNS/pdns/issues"
    html = f'<a href="{mine}/1">a</a><a href="{mine}/1">b</a><a>x</a><a href="{mine}/2?q=1">c</a><a href="/other/repo/issues/5">d</a><a href="/NLnetLabs/unbound/issues/9">e</a>'
    td = '<td class="subject"><a href="http://c/1">x</a><a href="http://c/n">y</a></td><td class="subject"><a href="http://c/1">x</a></td>'
    rows = spark.createDataFrame([("github", 3, True, html), ("github_unbound", 1, True, html), ("comodo", 1, False, td)], "forum string, page int, closed boolean, raw_content string")
    found = sorted((r["forum"], r["url"], r["id"]) for r in extract.listing_from_html(rows).collect())
    assert found == [("comodo", "http://c/1", "1"), ("comodo", "http://c/1", "1"), ("github", "https://github.com/PowerDNS/pdns/issues/1", "1"), ("github_unbound", "https://github.com/NLnetLabs/unbound/issues/9", "9")]
    body = '{"topic_list": {"topics": [{"id": 5, "slug": "s"}]}}'
    got = extract.listing_from_json(spark.createDataFrame([(1, body)], "page int, body string"), "http://f/t/").collect()
    assert [tuple(r) for r in got] == [(1, "http://f/t/s/5", "5", "s")]


def test_external_documents(spark):
    html = "<title>E</title><div><p>one</p><div>x</div></div><p>two</p>"
    rows = spark.createDataFrame([("u", html), ("n", None)], "url string, raw_content string")
    found = {r["url"]: r for r in extract.external_documents(rows).collect()}
    assert found["u"]["refined_content"] == "one" and found["u"]["pure_text"] == "one two" and found["n"]["title"] == "Title: Unknown"
    assert {r["pure_text"] for r in extract.external_documents(rows, "div").collect()} == {"onex", ""}


def test_dom_classes():
    root = dom.parse('<div class="b a">1</div><div class="a b">2</div>')
    assert [n.text for n in root.find_all("div", class_="a")] == ["1", "2"] and root.find("div", class_="a b").text == "2"
    assert dom.pure_text("<p>a&amp;b<script>x</script> <b>c</b>") == "a&b c"


def test_fetching(spark):
    from threadloom.operators.crawl import attempt_state
    from threadloom.scratch import cut
    from threadloom.sources.http import fetch_frame, fetch_pages

    with Site({"/ok": [(200, CO)], "/late": [(500, ""), (200, CO)], "/never": [(500, "")]}) as site:
        urls = [f"{site.base}/{p}" for p in ("ok", "late", "never")]
        for tried in (
            fetch_pages(spark, urls, delay=0, retries=1, partitions=2),
            fetch_frame(spark.createDataFrame([(u,) for u in [*urls, urls[0]]], "url string"), delay=0, retries=1, partitions=2, stagger=0.01),
        ):
            site.seen.clear()
            states = attempt_state(cut(tried, "attempts")).collect()
            assert {r["url"].rsplit("/", 1)[1]: (r["attempts"], r["state"]) for r in states} == {"ok": (1, "stored"), "late": (2, "stored"), "never": (2, "retry")}
            assert site.seen == {"/ok": 1, "/late": 2, "/never": 2}


def test_crawling_a_listing_in_rounds(spark, tmp_path):
    """Two rounds of thread pages, a retry, a failed thread, outside pages once; a repeated batch adds nothing."""
    listing = '<td class="subject"><a href="BASE/a">x</a></td><td class="subject"><a href="BASE/b">y</a></td><td class="subject"><a href="BASE/gone">z</a></td>'
    more = '<div class="pagelinks floatleft"><a class="navPages" href="/a2">2</a><a class="navPages" href="/a3">3</a></div>'
    site = Site({"/list": [(200, listing)], "/a": [(500, ""), (200, CO + more)], "/a2": [(200, CO)], "/a3": [(200, CO + more)], "/b": [(200, CO)]})
    with site:
        for _ in range(2):
            site.seen.clear()
            states = ingest.crawl_listing(spark, "comodo", 4, f"{site.base}/list", str(tmp_path), False, batch=7, delay=0, retries=1).collect()
    assert site.seen == {"/list": 1, "/a": 2, "/a2": 1, "/a3": 1, "/b": 1, "/gone": 2}
    state = {r["url"].rsplit("/", 1)[1]: r["state"] for r in states}
    assert state == {"list": "stored", "a": "stored", "a2": "stored", "a3": "stored", "b": "stored", "gone": "retry"}
    pure = {r["url"].rsplit("/", 1)[1]: r for r in landed.read_stage(spark, str(tmp_path), "pure", "comodo", (4, 4)).collect()}
    assert set(pure) == {"a", "b"} and len(pure["a"]["replies"]["u2"]) == 3 and len(pure["b"]["replies"]["u2"]) == 1
    assert landed.read_stage(spark, str(tmp_path), "raw").count() == 2 and landed.read_stage(spark, str(tmp_path), "refined").count() == 2


def test_crawling_notes_and_outside_pages(spark, tmp_path):
    item = '<span class="issue-title-text js-onboarding-issue-item"><a href="BASE/{}">t</a></span>'
    listing = item.format("isc-projects/bind9/-/issues/7") * 2 + item.format("other/repo/-/issues/8")
    page = GL.replace("http://o/g", "BASE/out")
    said = NOTES.replace("http://o/n", "BASE/photo.png")
    site = Site({
        "/l": [(200, listing)], "/isc-projects/bind9/-/issues/7": [(200, page)], "/isc-projects/bind9/-/issues/7/discussions.json": [(200, said)],
        "/out": [(503, ""), (503, ""), (200, "<title>E</title><div><p>one</p></div><p>two</p>")],
    })
    with site:
        states = ingest.crawl_listing(spark, "gitlab", 1, f"{site.base}/l", str(tmp_path), True, external=True, delay=0).collect()
    assert {r["state"] for r in states} == {"stored"} and site.seen["/out"] == 3 and "/photo.png" not in site.seen and len(site.seen) == 4
    thread = landed.read_stage(spark, str(tmp_path), "refined").first()
    assert thread["user_list"] == ["x_y", "z", "w"] and thread["closed"] and len(thread["external_urls"]) == 2
    for stage, text in (("raw_external", "raw_content"), ("refined_external", "refined_content"), ("pure_external", "pure_text")):
        (row,) = landed.read_stage(spark, str(tmp_path), stage).collect()
        assert row["title"] == "E" and row["url"].endswith("/out") and "one" in row[text]
        assert stage != "pure_external" or row[text] == "one"  # the text of div elements


def test_streaming(spark, tmp_path):
    from threadloom.streaming import ingest as streaming

    rows = pages(spark).where("forum = 'comodo' AND raw_content IS NOT NULL").withColumn("fetched", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.union(rows).coalesce(1).write.json(str(tmp_path / "in"))
    stream = streaming.landed_stream(spark, str(tmp_path / "in"))
    streaming.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert landed.read_stage(spark, str(tmp_path / "out"), "pure").count() == 1
    ingest.ingest(rows.drop("fetched"), str(tmp_path / "out"), batch=0)  # the batch is replayed
    assert landed.read_stage(spark, str(tmp_path / "out"), "pure").count() == 1
    assert len(landed.read_stage(spark, str(tmp_path / "out"), "refined").first()["replies"]["u2"]) == 2


def test_continuations(spark):
    rows = [
        ("cloudflare", 1, "http://f/t", 1, '<div role="navigation">next page</div>'), ("cloudflare", 1, "http://f/e", 3, '<div role="navigation">prev</div>'),
        ("opendns", 1, "http://o/a", 1, '<li class="pagination-last"><a href="/b?page=2">last</a></li>'),
        ("comodo", 1, "http://c/a", 1, '<div class="pagelinks floatleft"><a class="navPages" href="/2">2</a><a class="navPages" href="/3">3</a></div>'),
        ("comodo", 1, "http://c/a", 2, '<div class="pagelinks floatleft"><a class="navPages" href="/3">3</a></div>'), ("github", 1, "g", 1, "x"),
    ]
    df = spark.createDataFrame(rows, "forum string, page int, url string, part int, raw_content string")
    found = sorted((r["part"], r["next_url"]) for r in extract.continuations(df).collect())
    assert found == [(2, "http://c/2"), (2, "http://f/t?page=2"), (2, "http://o/b?page=2"), (3, "http://c/3")]
