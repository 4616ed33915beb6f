"""Forum pages rendered from the tables, and what the extractors read back from them.

The generated tables hold no forum pages, so Spark writes them: a conversation is a thread,
its turns are posts, and the markup is that of one of the forums.  The extractors read the
pages, and SQL over the same tables states what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import extract, filters, labels, stats
from threadloom.plans import ingest
from threadloom.plans.queries import _labels_sql, query, table, values
from threadloom.scratch import cut, scratch_path
from threadloom.sources import landed, sinks

FORUMS = ["cloudflare", "opendns", "spiceworks", "comodo", "github", "gitlab", "github_unbound"]
#: Forums whose pages tell a thread's state; others are told by the listing.
TELL = ["cloudflare", "opendns", "spiceworks"]
#: Forums that keep white space around a post's text.
RAW = ["opendns", "comodo"]


def _escaped(text: Column) -> Column:
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _threads(spark, sf_dir) -> DataFrame:
    """(conv_id, posts, forum, url, closed): a conversation's turns in order, and where they are posted."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.struct("turn", F.col("role"), _escaped(F.col("text")).alias("text"), F.col("text").alias("raw")).alias("p")
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("posts"))
    forum = F.element_at(F.array(*[F.lit(f) for f in FORUMS]), (F.col("conv_id") % len(FORUMS) + 1).cast("int"))
    return grouped.select("conv_id", "posts", forum.alias("forum"), _say("http://f/", F.col("conv_id").cast("string")).alias("url"), (F.col("conv_id") % 2 == 0).alias("closed"))


def _each(render, first: int = 0) -> Column:
    """The posts from number ``first`` on, rendered one after the other."""
    posts = F.slice("posts", first + 1, F.greatest(F.size("posts") - first, F.lit(0)))
    return F.array_join(F.transform(posts, lambda p, i: render(p, i + first)), "")


def _when(p) -> Column:
    return _say("d", p["turn"].cast("string"))


def _html() -> dict[str, Column]:
    """A thread's page in each forum's markup."""
    conv, head = F.col("conv_id").cast("string"), F.get("posts", F.lit(0))
    shut = lambda html: F.when(F.col("closed"), html).otherwise("")
    title = _say("<title>Thread ", conv, "</title>")
    cloudflare = lambda p, i: _say(
        '<div class="topic-body crawler-post"><span class="creator" itemprop="author">', p["role"], '</span><time class="post-time">', _when(p),
        '</time><div class="post">', p["text"], '<a href="/t/', conv, '"></a><a href="http://o/', conv, '"></a><a href="/u/x"></a></div></div>',
    )
    opendns = lambda p, i: _say(
        '<div class="comment-info">', F.when(i % 5 == 3, "").otherwise(_say("<a>", p["role"], "</a>")), "<time>", _when(p),
        '</time><section class="comment-body">', p["text"], "</section></div>",
    )
    stamp = lambda p: _say('<span data-js-postprocess="timestamp">', _when(p), "</span>")
    spiceworks = lambda p, i: _say('<div class="post-content"><a>', p["role"], "</a>", stamp(p), '<div class="post-body">', p["text"], "</div></div>")
    comodo = lambda p, i: _say(
        '<div class="windowbg', F.when(i % 2 == 1, "2").otherwise(""), '"><a>', p["role"], '</a><div class="smalltext">', _when(p), '</div><div class="post">', p["text"], "</div></div>"
    )
    github = lambda p, i: _say(
        '<a class="d-inline-block d-md-none" href="/', p["role"], '"></a><a class="Link--secondary js-timestamp">', _when(p),
        '</a><table><tr><td class="d-block comment-body markdown-body js-comment-body">', p["text"], "</td></tr></table>",
    )
    issue = _say(
        title, '<div class="js-quote-selection-container"><a href="http://o/', conv, '"></a><a href="http://o/wiki"></a><a href="/r"></a></div>', _each(github),
        F.when(F.col("conv_id") % 10 == 9, '<a class="Link--secondary js-timestamp">more</a>').otherwise(""),  # lists of unequal length
    )
    pager = lambda html: F.when(F.size("posts") > 4, html).otherwise("")
    return {
        "cloudflare": _say(
            title, _each(cloudflare), shut(F.lit('<div class="topic-body crawler-post" role="x"><span class="creator" itemprop="author">closed</span></div>')),
            pager(F.lit('<div role="navigation">next page</div>')),
        ),
        "opendns": _say(
            title, '<div class="post-meta"><a>', head["role"], "</a><time>", _when(head), '</time></div><div class="post-content">', head["text"], "</div>",
            _each(opendns, 1), shut(F.lit('<p class="comment-callout">is closed</p>')), '<p class="comment-callout">', shut(F.lit("closed")), "</p>",
            pager(_say('<li class="pagination-last"><a href="/', conv, '?page=2">last</a></li>')),
        ),
        "spiceworks": _say(
            title, '<script data-config="topicData">', F.to_json(F.struct(head["role"].alias("author_name"))), '</script><div class="sui-opt-in root-post post">',
            head["text"], "</div>", stamp(head), _each(spiceworks, 1), '<div class="sui-alert_text">', shut(F.lit("locked")), "</div>",
            pager(_say('<nav class="sui-pagination"><a href="/', conv, '/2">2</a></nav>')),
        ),
        "comodo": _say(
            title, _each(comodo),
            pager(_say('<div class="pagelinks floatleft"><a class="navPages" href="/', conv, '.2">2</a><a class="navPages" href="/', conv, '.3">3</a></div>')),
        ),
        "github": issue,
        "github_unbound": issue,
        "gitlab": _say(
            title, '<div class="description">', head["text"], '<a href="http://o/', conv, '"></a></div><span class="author">', head["role"],
            '</span><time class="js-timeago" title="', _when(head), '">ago</time>',
        ),
    }


def _pages(spark, sf_dir) -> DataFrame:
    """The threads as landed pages."""
    html = F.lit(None).cast("string")
    for forum, body in _html().items():
        html = F.when(F.col("forum") == forum, body).otherwise(html)
    page = (F.col("conv_id") % 10).cast("int").alias("page")
    return _threads(spark, sf_dir).select("forum", page, "url", F.lit(1).alias("part"), "closed", html.alias("raw_content"))


def _notes(spark, sf_dir) -> DataFrame:
    """Discussions of the threads that keep their replies as notes: every second one without a later date."""
    posts = F.slice("posts", 2, F.greatest(F.size("posts") - 1, F.lit(0)))
    note = F.transform(
        posts,
        lambda p, i: F.struct(
            F.array(
                F.struct(
                    F.struct(p["role"].alias("name")).alias("author"), F.when(i % 2 == 0, "").otherwise(_say("u", p["turn"].cast("string"))).alias("updated_at"),
                    _when(p).alias("created_at"), p["raw"].alias("note"), _say('<a href="http://n/', i.cast("string"), '">x</a>').alias("note_html"),
                )
            ).alias("notes")
        ),
    )
    rows = _threads(spark, sf_dir).where("forum = 'gitlab'")
    return rows.select("forum", (F.col("conv_id") % 10).cast("int").alias("page"), "url", F.to_json(note).alias("body"))


#: (conv_id, forum, url, pos, user, date, content, closed) of every post that the pages hold.
POSTS = rf"""t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, {FORUMS}[conv_id % {len(FORUMS)} + 1] AS forum FROM conversations),
post AS (SELECT conv_id, forum, 'http://f/' || conv_id AS url, pos::INTEGER AS pos,
    CASE WHEN forum = 'opendns' AND pos % 5 = 3 THEN 'Permanently-Deleted-User' ELSE role END AS user, 'd' || turn AS date,
    CASE WHEN forum IN ('opendns', 'comodo', 'gitlab') THEN text ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS content, conv_id % 2 = 0 AS closed
  FROM t WHERE NOT (forum IN ('github', 'github_unbound') AND conv_id % 10 = 9) AND NOT (forum = 'gitlab' AND pos > 0)),
note AS (SELECT conv_id, forum, 'http://f/' || conv_id AS url, pos::INTEGER AS pos, role AS user, CASE WHEN pos % 2 = 1 THEN 'd' ELSE 'u' END || turn AS date, text AS content,
    'http://n/' || (pos - 1) AS links FROM t WHERE forum = 'gitlab' AND pos > 0)"""


@query(f"WITH {POSTS} SELECT forum, url, pos, user, date, content, closed FROM post")
def rendered_posts(spark, sf_dir):
    """Users, dates, texts and states of threads in every forum's markup; lists of unequal length give no row."""
    return extract.extract_posts(_pages(spark, sf_dir)).select("forum", "url", "pos", "user", "date", "content", "closed")


@query(
    f"""WITH {POSTS} SELECT url, 'Thread ' || conv_id AS title, CASE forum WHEN 'cloudflare' THEN 'http://f/t/' || conv_id || '|' ELSE '' END || 'http://o/' || conv_id AS links
FROM post WHERE pos = 0 AND forum IN ('cloudflare', 'github', 'github_unbound', 'gitlab')"""
)
def rendered_links(spark, sf_dir):
    """Titles, and the outside links that each forum's rules keep."""
    kept = extract.kept_links(extract.extract_posts(_pages(spark, sf_dir))).where(F.size("links") > 0)
    return kept.select("url", "title", F.array_join(F.array_distinct("links"), "|").alias("links"))


@query(f"WITH {POSTS} SELECT url, pos, user, date, content, links FROM note")
def rendered_notes(spark, sf_dir):
    """First notes of discussions; the creation date where there is no later one."""
    found = extract.note_posts(_notes(spark, sf_dir))
    return found.select("url", "pos", "user", "date", "content", F.array_join("links", "|").alias("links"))


#: Threads: titles, users in order of their first post, creator, first date and text, replies and outside links.
THREADS = f"""{POSTS}, whole AS (SELECT conv_id, forum, url, pos, user, date, content, closed FROM post
  UNION ALL SELECT conv_id, forum, url, pos, user, date, content, conv_id % 2 = 0 FROM note),
u AS (SELECT conv_id, user, min(pos) AS p, sum((pos > 0)::INT) AS n FROM whole GROUP BY 1, 2),
thread AS (SELECT w.conv_id, any_value(url) AS url, 'Thread ' || w.conv_id AS title,
    (SELECT string_agg(u.user, '|' ORDER BY u.p) FROM u WHERE u.conv_id = w.conv_id) AS users, arg_min(user, pos) AS creator, arg_min(date, pos) AS created_date,
    arg_min(content, pos) AS original_post, any_value(closed) AS closed,
    (SELECT string_agg(u.user || '=' || u.n, '|' ORDER BY u.user) FROM u WHERE u.conv_id = w.conv_id AND u.n > 0) AS replies
  FROM whole w GROUP BY w.conv_id)"""


def _told(found: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("replies"), lambda e: F.concat_ws("=", e["key"], F.size(e["value"]).cast("string")))
    return found.select(
        "url", "title", F.array_join("user_list", "|").alias("users"), F.col("post_creator").alias("creator"), "created_date", "original_post", "closed",
        F.nullif(F.array_join(F.array_sort(entries), "|"), F.lit("")).alias("replies"),
    )


@query(f"WITH {THREADS} SELECT url, title, users, creator, created_date, original_post, closed, replies FROM thread")
def rendered_threads(spark, sf_dir):
    """Threads of all layouts with their notes."""
    return _told(ingest.refined_threads(_pages(spark, sf_dir), _notes(spark, sf_dir), None))


@query(
    rf"""WITH {THREADS} SELECT stage, url, title, users, creator, created_date, closed, replies,
  CASE stage WHEN 'pure' THEN trim(regexp_replace(original_post, '\s+', ' ', 'g')) ELSE original_post END AS original_post
FROM thread, (SELECT unnest(['refined', 'pure']) AS stage)"""
)
def rendered_stages(spark, sf_dir):
    """What the stages hold after ingest, written twice as one batch, and read back by range of pages."""
    root, pages = scratch_path(spark, "stages"), cut(_pages(spark, sf_dir), "pages")
    for _ in range(2):
        ingest.ingest(pages, root, _notes(spark, sf_dir), None, batch=1)
    found = [_told(landed.read_stage(spark, root, stage, pages=(0, 9))).withColumn("stage", F.lit(stage)) for stage in ("pure", "refined")]
    return found[0].unionByName(found[1])


@query(f"SELECT {FORUMS}[conv_id % {len(FORUMS)} + 1] AS forum, (conv_id % 10)::INTEGER AS page, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1, 2")
def rendered_raw(spark, sf_dir):
    """Raw documents by partition, appended once."""
    root = scratch_path(spark, "raw")
    sinks.append_stage(ingest.raw_documents(_pages(spark, sf_dir)), root, "raw")
    return landed.read_stage(spark, root, "raw").groupBy("forum", "page").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH n AS (SELECT conv_id, {FORUMS}[conv_id % {len(FORUMS)} + 1] AS forum FROM conversations GROUP BY conv_id HAVING count(*) > 4)
SELECT 'http://f/' || conv_id AS url, 2 AS part, CASE forum WHEN 'cloudflare' THEN 'http://f/' || conv_id || '?page=2' WHEN 'opendns' THEN 'http://f/' || conv_id || '?page=2'
  WHEN 'spiceworks' THEN 'http://f/' || conv_id || '/2' ELSE 'http://f/' || conv_id || '.2' END AS next_url
FROM n WHERE forum IN ('cloudflare', 'opendns', 'spiceworks', 'comodo')
UNION ALL SELECT 'http://f/' || conv_id, 3, 'http://f/' || conv_id || '.3' FROM n WHERE forum = 'comodo'"""
)
def rendered_continuations(spark, sf_dir):
    """Pages that thread pages name as their continuation."""
    return extract.continuations(_pages(spark, sf_dir)).select("url", "part", "next_url")


#: How each forum's listings name a thread: markup around the link, and the link's address before the number (fixed values).
LISTED = {
    "github": ('<a href="%s">t</a>', "/PowerDNS/pdns/issues/", "https://github.com/PowerDNS/pdns/issues/"),
    "github_unbound": ('<a href="%s">t</a>', "/NLnetLabs/unbound/issues/", "https://github.com/NLnetLabs/unbound/issues/"),
    "gitlab": ('<span class="issue-title-text js-onboarding-issue-item"><a href="%s">t</a></span>', "/isc-projects/bind9/-/issues/", "https://gitlab.isc.org/isc-projects/bind9/-/issues/"),
    "opendns": ('<span class="striped-list-info"><a href="%s">t</a></span>', "/hc/", "https://support.opendns.com/hc/"),
    "spiceworks": ('<div class="listing__info"><a href="%s">t</a></div>', "/topic/", "https://community.spiceworks.com/topic/"),
    "comodo": ('<td class="subject"><a href="%s">t</a></td>', "http://c/", "http://c/"),
}


def _around(before: str, after: str):
    return lambda n: _say(before, n.cast("string"), after)


KEYED = ("github", "github_unbound", "gitlab")
#: Threads of a listing document, on average.
LISTED_ROWS = 1000


@query(
    "WITH o AS (SELECT (o_orderkey % 40)::INTEGER AS page, o_custkey AS n FROM orders) "
    + " UNION ALL ".join(
        f"SELECT {'DISTINCT ' if f in KEYED else ''}'{f}' AS forum, page, page % 2 = 0 AS closed, '{to}' || n AS url, n::VARCHAR AS id FROM o" for f, (_, _, to) in LISTED.items()
    )
    + " UNION ALL SELECT 'cloudflare', page, NULL, 'https://community.cloudflare.com/t/s/' || n, n::VARCHAR FROM o"
)
def rendered_listings(spark, sf_dir):
    """Threads named by listings of every forum, HTML and JSON; forums with a key name each thread of a page once."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).cast("int").alias("page"), F.col("o_custkey").alias("n"))
    # a page of listings goes on in as many documents as it needs, so none grows with the table
    parts = max(1, -(-orders.count() // (40 * LISTED_ROWS)))
    dealt = orders.withColumn("part", F.pmod(F.xxhash64("n"), F.lit(parts)))
    grouped = cut(dealt.groupBy("page", "part").agg(F.collect_list("n").alias("ns")), "listings")
    found = None
    for forum, (markup, path, _) in LISTED.items():
        before, after = markup.split("%s")
        anchors = F.array_join(F.transform("ns", _around(before + path, after)), "")
        odd = _say('<a href="/else/1">x</a><a>none</a>', '<a href="/PowerDNS/pdns/issues/1?q=1">q</a>', anchors)
        page = grouped.select(F.lit(forum).alias("forum"), "page", (F.col("page") % 2 == 0).alias("closed"), odd.alias("raw_content"))
        found = page if found is None else found.unionByName(page)
    html = extract.listing_from_html(found).select("forum", "page", "closed", "url", "id")
    topics = F.transform("ns", lambda n: F.struct(n.alias("id"), F.lit("s").alias("slug")))
    body = grouped.select("page", F.to_json(F.struct(F.struct(topics.alias("topics")).alias("topic_list"))).alias("body"))
    more = extract.listing_from_json(body, extract.LAYOUTS["cloudflare"].listing_base)
    return html.unionByName(more.select(F.lit("cloudflare").alias("forum"), "page", F.lit(None).cast("boolean").alias("closed"), "url", "id"))


@query(
    r"""SELECT 'http://e/' || conv_id || '/' || turn AS url, CASE WHEN turn % 3 = 0 THEN 'Title: Unknown' ELSE 'T' || turn END AS title,
  regexp_replace(text, '^\s+|\s+$', '', 'g') AS refined_content, trim(regexp_replace(text || ' ' || role, '\s+', ' ', 'g')) AS pure_text FROM conversations"""
)
def rendered_outside(spark, sf_dir):
    """Outside pages: title, paragraphs inside a div, text; stored in three tables and joined again."""
    root, turn = scratch_path(spark, "outside"), F.col("turn").cast("string")
    html = _say(
        F.when(F.col("turn") % 3 == 0, "").otherwise(_say("<title>T", turn, "</title>")), "<div><p>", _escaped(F.col("text")), "</p><div>aside</div></div><p>", F.col("role"), "</p>"
    )
    pages = table(spark, sf_dir, "conversations").select(_say("http://e/", F.col("conv_id").cast("string"), "/", turn).alias("url"), html.alias("raw_content"))
    sinks.append_external(cut(extract.external_documents(pages), "outside"), root)
    refined, pure = (landed.read_stage(spark, root, s) for s in ("refined_external", "pure_external"))
    return landed.read_stage(spark, root, "raw_external").select("url", "title").join(refined.drop("title"), "url").join(pure.drop("title"), "url")


# Words of the real rules, tier by tier: below and at each threshold, a word listed twice, bigrams, inflected forms.
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


#: Texts of three parts, chosen by an order's keys.
TOLD = f"""SELECT o_orderkey AS id, w[o_orderkey % {len(REAL)} + 1] || ' ' || w[o_custkey % {len(REAL)} + 1] || ' ' || w[o_orderkey // 7 % {len(REAL)} + 1] AS text
  FROM orders, (SELECT {REAL} AS w)"""


def _told_orders(spark, sf_dir) -> DataFrame:
    words, key = F.array(*[F.lit(w) for w in REAL]), F.col("o_orderkey")
    chosen = [F.get(words, (x % len(REAL)).cast("int")) for x in (key, F.col("o_custkey"), F.floor(key / 7))]
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.concat_ws(" ", *chosen).alias("text"))


@query(
    f"""WITH posts AS ({TOLD}),
{_labels_sql("posts", labels.rule_rows(), "id", lemma_rows=_real_lemmas())}
SELECT p.id, coalesce(string_agg(label, '|' ORDER BY ord), 'Unclassified') AS labels FROM posts p LEFT JOIN lab USING (id) GROUP BY p.id"""
)
def real_rules(spark, sf_dir):
    """Labels by the real keyword rules, of posts made of their words."""
    found = labels.label(_told_orders(spark, sf_dir), ["id"], "text", labels.rule_table(spark), T.lemma_table(spark, REAL_WORDS))
    return found.select("id", F.array_join(labels.or_unclassified(F.col("labels")), "|").alias("labels"))


PLACED = [
    "root isp firewall dns", "server stub resolver", "firewall", "é ü ö firewall dns", "é é ü firewall dns", "the tld registry and the registrar", "egress", "nothing here dns",
    "gateway iana ICANN", "dns", "",
]
TAGS = ["", "x 1.1.1.1 y", "other", "a DNS & Network b", "DNS & Network", "1.1.1.1", "Getting started"]


@query(
    f"""WITH p AS (SELECT o_orderkey AS id, w[o_orderkey % {len(PLACED)} + 1] || ' ' || w[o_custkey % {len(PLACED)} + 1] AS text, t[o_custkey % {len(TAGS)} + 1] AS tag
  FROM orders, (SELECT {PLACED} AS w, {TAGS} AS t)),
tokens AS (SELECT id, lower(unnest(string_split(text, ' '))) AS t FROM p),
posts AS (SELECT id, text FROM p WHERE (id IN (SELECT id FROM tokens WHERE t = 'dns') OR contains(tag, 'DNS & Network') OR contains(tag, '1.1.1.1'))
  AND id NOT IN (SELECT id FROM tokens WHERE regexp_matches(t, '[^\\x00-\\x7F]') GROUP BY id HAVING count(DISTINCT t) >= 3)),
{_labels_sql("posts", labels.rule_rows(labels.location_rules()), "id", lemmas=False)}
SELECT id, string_agg(label, '|' ORDER BY label) AS locations FROM lab GROUP BY id"""
)
def tagged_locations(spark, sf_dir):
    """Resolver locations of posts that their words or their tags tell to be about DNS."""
    pick = lambda words, x: F.get(F.array(*[F.lit(w) for w in words]), (x % len(words)).cast("int"))
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    posts = table(spark, sf_dir, "orders").select(key.alias("id"), F.concat_ws(" ", pick(PLACED, key), pick(PLACED, other)).alias("text"), F.array(pick(TAGS, other)).alias("raw_tag"))
    return labels.locations(posts, "id", "text", "raw_tag").select("id", F.array_join("labels", "|").alias("locations"))


@query(
    """SELECT user_id::VARCHAR AS user, count(*) AS n_replies FROM events GROUP BY 1
ORDER BY count(*) DESC, min(event_id), 1 LIMIT 20"""
)
def first_seen_ranking(spark, sf_dir):
    """Users by number of rows, ties by who came first."""
    counts = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.lit(1).alias("n"), F.col("event_id").alias("at"))
    return stats.user_ranking(counts, 20, "at")


@query(
    """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)
WHERE coalesce(quality, 0) = 1 AND lang <> 'de' AND NOT coalesce(toxic = 1, false)"""
)
def related_posts(spark, sf_dir):
    """The relevance filter with its language flag set on some rows and null on others."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    posts = docs.select(
        "doc_id", (F.col("quality") == 1).alias("DNS_Related"), (F.col("toxic") == 1).alias("Non_English"), F.lit("May 1, 2021, x").alias("created_date"),
        F.when(F.col("lang") == "de", F.array(F.lit(filters.OTHER_LANGUAGES))).otherwise(F.array().cast("array<string>")).alias("labels"),
    )
    return posts.where(filters.relevant_post()).select("doc_id")
