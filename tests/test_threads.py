from threadloom.functions.text import is_plain_word, strip, year_of
from threadloom.functions.urls import allowed, page_number, resolve, slug_and_id
from threadloom.operators import crawl, filters, stats, threads
from threadloom.sources.sinks import updated
from pyspark.sql import functions as F


def test_assembly(spark):
    posts = spark.createDataFrame(
        [("t", 0, "a.b", "d0", "p0"), ("t", 1, "c", "d1", "r1"), ("t", 2, "a.b", "d2", "r2"), ("u", 0, "x", "d", "only")],
        "url string, pos int, user string, date string, content string",
    )
    found = {r["url"]: r for r in threads.assemble(posts, ["url"], ["pos"]).collect()}
    t = found["t"]
    assert t["user_list"] == ["a_b", "c"] and t["post_creator"] == "a_b" and t["original_post"] == "p0" and t["created_date"] == "d0"
    assert {k: [tuple(x) for x in v] for k, v in t["replies"].items()} == {"c": [("d1", "r1")], "a_b": [("d2", "r2")]}
    assert found["u"]["replies"] == {}


def test_user_statistics(spark):
    counts = spark.createDataFrame([("u1", 2), ("u2", 1), ("u1", 1)], "user string, n int")
    assert tuple(stats.user_summary(counts).first()) == (2, 4, 2.0)
    assert [tuple(r) for r in stats.user_ranking(counts).collect()] == [("u1", 3), ("u2", 1)]
    assert tuple(stats.user_summary(counts.limit(0)).first()) == (0, 0, None)
    seen = spark.createDataFrame([("b", 1, 0), ("a", 1, 1), ("c", 2, 2)], "user string, n int, at int")
    assert [r["user"] for r in stats.user_ranking(seen, seen="at").collect()] == ["c", "b", "a"]


def test_scalars(spark):
    rows = spark.createDataFrame([("January 5, 2021, 3:04pm",), ("2021-01-05",), (None,)], "d string")
    assert [r[0] for r in rows.select(year_of(F.col("d"))).collect()] == ["2021", None, None]
    words = spark.createDataFrame([(w,) for w in ("12a", "ab1", "", "été", "dns", "a\n")], "w string")
    assert [r[0] for r in words.where(is_plain_word(F.col("w"))).collect()] == ["", "dns"]
    assert spark.range(1).select(strip(F.lit(" \t x y \n"))).first()[0] == "x y"
    url = F.lit("http://f/t/slug-here/42?page=3")
    assert spark.range(1).select(page_number(url)).first()[0] == "3"
    assert tuple(spark.range(1).select(slug_and_id(F.lit("http://f/t/s/42"))).first()[0]) == ("42", "s")


def test_links(spark):
    rows = spark.createDataFrame([("http://x/", h) for h in ("http://x/a", "/t/b", "http://x/u/c", "http://x/a", "mailto:q", None)], "base string, href string")
    urls = rows.select(resolve("base", "href").alias("u"))
    kept = urls.where(allowed(F.col("u"), ["/u/"])).collect()
    assert [r[0] for r in kept] == ["http://x/a", "http://x/t/b", "http://x/a"]


def test_filters(spark):
    rows = spark.createDataFrame(
        [(1, True, [], "Jan 1, 2021, x", False), (2, True, ["Other Languages"], "Jan 1, 2021, x", False), (3, None, [], "Jan 1, 2020, x", None), (4, True, None, "Jan 1, 2020, x", None), (5, True, [], "x", None)],
        "id int, DNS_Related boolean, labels array<string>, created_date string, Non_English boolean",
    )
    assert [r[0] for r in rows.where(filters.relevant_post()).select("id").collect()] == [1, 4]
    tags = spark.createDataFrame([(1, ["Others", "x"]), (2, [filters.GENERAL]), (3, [filters.GENERAL, "x"]), (4, None)], "id int, t array<string>")
    assert [r[0] for r in tags.where(filters.unclassified(F.col("t"))).select("id").collect()] == [1, 2]


def test_keyed_update_keeps_other_rows(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "b", False)], "id int, v string, updated boolean")
    changes = spark.createDataFrame([(2, None, True)], "id int, v string, updated boolean")
    assert sorted(map(tuple, updated(rows, changes, "id").collect())) == [(1, "a", False), (2, None, True)]


def test_attempts(spark):
    rows = spark.createDataFrame(
        [("a", 1, False, 200, None), ("b", 1, False, 404, None), ("b", 2, False, None, "timeout"), ("c", 4, False, 500, None), ("d", 3, True, 500, None)],
        "url string, attempt int, is_external boolean, status int, error string",
    )
    state = {r["url"]: r["state"] for r in crawl.attempt_state(rows, external_retries=2).collect()}
    assert state == {"a": "stored", "b": "retry", "c": "failed", "d": "failed"}
    assert {tuple(r) for r in crawl.attempt_counts(rows).collect()} == {("a", 1, 0), ("b", 2, 2), ("c", 1, 1), ("d", 1, 1)}
