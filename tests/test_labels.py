"""Hand-made cases for the rules: tokens are given as they are after lemmatising."""

import pytest

from threadloom.functions.text import lemma_table
from threadloom.operators import filters, labels


def labelled(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = labels.label(rows, ["id"], "text", labels.rule_table(spark)).collect()
    return [x for _, x in sorted((r["id"], r["labels"]) for r in found)]


def test_rules(spark):
    cases = {
        "https cert": ["Security", "Website"],
        "https": ["Website"],
        "tunnel proxy filter": ["Security"],
        "slow": [],
        "slow packet": ["Network Connectivity"],
        "packet loss": ["Network Connectivity"],
        "ip browser": ["Website"],
        "ip": [],
        "redirect": ["Website"],
        "ssl tls": ["Security"],
        "cert proxy": ["Website"],
        "email resolver whois": ["Management", "DNS Resolve Related", "Email Related"],
        "slow slow slow": [],
        "name  server": [],
        "": [],
    }
    assert labelled(spark, list(cases)) == list(cases.values())


def test_body_and_title(spark):
    rows = spark.createDataFrame([(1, "site mail", "whois_page"), (2, "slow", "packet"), (3, None, "mail"), (4, "mail", None)], "id int, body string, title string")
    found = {r["id"]: r["labels"] for r in labels.label_posts(rows, "id", "body", "title", labels.rule_table(spark)).collect()}
    assert found == {1: ["Website", "Email Related", "Management"], 2: [], 3: ["Email Related"], 4: ["Email Related"]}


def test_histograms_and_default(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["a"])], "id int, labels array<string>")
    assert {tuple(r) for r in labels.label_histogram(rows).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in labels.label_count_histogram(rows).collect()} == {(0, 1), (1, 1), (2, 1)}
    assert [r[0] for r in rows.orderBy("id").select(labels.or_unclassified(rows["labels"])).collect()][1] == ["Unclassified"]


def test_locations(spark):
    rows = spark.createDataFrame(
        [(1, "root isp firewall dns", []), (2, "server stub resolver", ["x 1.1.1.1 y"]), (3, "firewall", []), (4, "é ü ö firewall dns", []), (5, "é é ü firewall dns", [])],
        "id int, text string, raw_tag array<string>",
    )
    found = {r["id"]: r["labels"] for r in labels.locations(rows, "id", "text", "raw_tag").collect()}
    assert found == {1: ["firewall", "isp resolver", "root server"], 2: ["stub resolver"], 5: ["firewall"]}


def test_lemmas(spark):
    table = lemma_table(spark, [("site", "noun"), ("fail", "verb"), ("page", "noun"), ("ns", "noun"), ("fast", "adjective"), ("proxy", "noun")], [("was", "be")])
    found = dict(map(tuple, table.collect()))
    assert found["sites"] == "site" and found["failed"] == "fail" and found["failing"] == "fail" and found["proxies"] == "proxy"
    assert found["fastest"] == "fast" and found["was"] == "be" and "https" not in found
    rows = spark.createDataFrame([(1, "sites failing was x1"), (2, "")], "id int, text string")
    assert [r["token"] for r in filters.clean_tokens(rows, "text", None, table).orderBy("pos").collect()] == ["site", "fail", "be"]
    got = labels.features(rows, ["id"], "text").collect()
    assert {(r["id"], r["kind"], r["feature"]) for r in got if r["kind"] == "bigram"} == {(1, "bigram", "sites failing"), (1, "bigram", "failing was"), (1, "bigram", "was x1")}
    some = labels.features(rows, ["id"], "text", ["sites", "failing was", "no"]).collect()
    assert {(r["id"], r["feature"]) for r in some} == {(1, "sites"), (1, "failing was"), (2, None)}


@pytest.mark.parametrize("order", [1, -1])
def test_row_order_does_not_matter(spark, order):
    texts = ["https cert", "mail", "slow packet"][::order]
    assert labelled(spark, texts) == [["Security", "Website"], ["Email Related"], ["Network Connectivity"]][::order]
