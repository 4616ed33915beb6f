"""Named queries over the star-schema and corpus tables, with equivalent SQL.

The tables stand in for forum data: documents for posts, conversations for
threads, pages for landed pages, embeddings for document vectors.  The corpora
hold invented words, so rule queries take a substitute rule table; the real one
is tested by hand-made cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import urls as U
from threadloom.operators import clustering, crawl, density, extract, features, filters, labels, sparse, stats, threads
from threadloom.scratch import cut, discard, scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], names: str) -> str:
    """Rows as an SQL table."""
    say = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) v({names}))"


# Substitute rules over frequent words of the corpora: thresholds, a word listed twice, bigrams, a rule that never holds.
RULES = {
    "Alpha": [(1, "unigram", 3, ["thing", "er", "re", "thing", "th", "an"]), (2, "unigram", 1, ["orre", "not here"])],
    "Beta": [(1, "unigram", 2, ["de", "la", "que"]), (3, "bigram", 1, ["of the", "in the"])],
    "Gamma": [(2, "unigram", 1, ["und", "und der"]), (3, "bigram", 1, ["in der"])],
    "Delta": [(2, "unigram", 1, ["zzzz"])],
    "Epsilon": [(1, "unigram", 4, ["thatin", "inoran", "ononst", "hehely", "orantion"])],
}
LEMMAS = [("thing", "noun"), ("er", "verb"), ("re", "noun"), ("an", "verb"), ("ha", "verb"), ("ou", "adjective")]
EXCEPTIONS = [("die", "der"), ("was", "be"), ("is", "be")]
PLACES = ["the server", "of stub", "und", "hehely", "zz registry"]
STOP = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "be", "as", "by", "are", "this", "at", "an", "from"]

TOKENS = r"""tok AS (
  SELECT doc_id, i, lower(regexp_replace(w, '^\s+|\s+$', '', 'g')) AS token
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
)"""


def _lemma_rows() -> list[tuple]:
    """The rows of the lemma table, made by the same rule in plain Python for the SQL side."""
    found = dict(EXCEPTIONS)
    nouns = {w for w, part in LEMMAS if part == "noun"}
    for part, endings in T.DETACH.items():
        for word in sorted(w for w, kind in LEMMAS if kind == part):
            for ending, base in endings:
                form = word[: len(word) - len(base)] + ending if word.endswith(base) else word
                if form != word and (part == "noun" or form not in nouns):
                    found.setdefault(form, word)
    return sorted(found.items())


def _labels_sql(source: str, rules: list[tuple], keys: str = "doc_id", lemmas: bool = True, lemma_rows: list[tuple] | None = None) -> str:
    """CTEs ending in ``lab`` (keys, label, ord) for texts of ``source`` (keys, text)."""
    join = "LEFT JOIN lem ON tok.token = lem.form" if lemmas else ""
    token = "coalesce(lem.lemma, token)" if lemmas else "token"
    return rf"""rules AS {values(rules, "label, ord, tier, kind, keyword, n, threshold")},
lem AS {values(lemma_rows or _lemma_rows(), "form, lemma")},
tok AS (
  SELECT {keys}, i, lower(regexp_replace(w, '^\s+|\s+$', '', 'g')) AS token
  FROM (SELECT {keys}, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM {source})
),
lemmed AS (SELECT {keys}, i, {token} AS token FROM tok {join}),
pair AS (SELECT {keys}, token, lead(token) OVER (PARTITION BY {keys} ORDER BY i) AS next FROM lemmed),
feat AS (
  SELECT {keys}, 'unigram' AS kind, token AS feature FROM pair
  UNION ALL SELECT {keys}, 'bigram', token || ' ' || next FROM pair WHERE next IS NOT NULL
),
hit AS (SELECT DISTINCT {keys}, label, ord, tier, threshold, keyword, n FROM feat JOIN rules ON feature = keyword AND feat.kind = rules.kind),
lab AS (
  SELECT DISTINCT {keys}, label, ord FROM
    (SELECT {keys}, label, ord, tier FROM hit GROUP BY {keys}, label, ord, tier HAVING sum(n) >= max(threshold))
)"""


def _rules(spark: SparkSession) -> DataFrame:
    return labels.rule_table(spark, RULES)


def _lemmas(spark: SparkSession) -> DataFrame:
    return T.lemma_table(spark, LEMMAS, EXCEPTIONS)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return labels.label(docs, ["doc_id"], "text", _rules(spark), _lemmas(spark))


# labels


@query(f"WITH {_labels_sql('documents', labels.rule_rows(RULES))} SELECT label, count(*) AS n_posts FROM lab GROUP BY label")
def label_histogram(spark, sf_dir):
    return labels.label_histogram(_labelled(spark, sf_dir))


@query(
    f"""WITH {_labels_sql('documents', labels.rule_rows(RULES))},
per AS (SELECT d.doc_id, count(label) AS k FROM documents d LEFT JOIN lab USING (doc_id) GROUP BY d.doc_id)
SELECT k::INTEGER AS n_labels, count(*) AS n_posts FROM per GROUP BY k"""
)
def tag_count_histogram(spark, sf_dir):
    return labels.label_count_histogram(_labelled(spark, sf_dir))


@query(
    f"""WITH {_labels_sql('documents', labels.rule_rows(RULES))}
SELECT d.doc_id, coalesce(string_agg(label, '|' ORDER BY ord), 'Unclassified') AS labels
FROM documents d LEFT JOIN lab USING (doc_id) GROUP BY d.doc_id"""
)
def post_labels(spark, sf_dir):
    found = _labelled(spark, sf_dir)
    return found.select("doc_id", F.array_join(labels.or_unclassified(F.col("labels")), "|").alias("labels"))


@query(
    f"""WITH texts AS (
  SELECT doc_id, 'body' AS part, text FROM documents
  UNION ALL SELECT doc_id, 'title', translate(concat_ws('_', lang, source, 'und', 'la-que'), '-_', '  ') FROM documents),
{_labels_sql('texts', labels.rule_rows(RULES), 'doc_id, part')},
first AS (SELECT doc_id, label, min(CASE part WHEN 'body' THEN ord ELSE 100 + ord END) AS o FROM lab GROUP BY doc_id, label)
SELECT d.doc_id, coalesce(string_agg(label, '|' ORDER BY o), '') AS labels
FROM documents d LEFT JOIN first USING (doc_id) GROUP BY d.doc_id"""
)
def title_body_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("_", "lang", "source", F.lit("und"), F.lit("la-que")).alias("title"))
    found = labels.label_posts(docs, "doc_id", "text", "title", _rules(spark), _lemmas(spark))
    return found.select("doc_id", F.array_join("labels", "|").alias("labels"))


@query(
    f"""WITH foreign_docs AS (
  SELECT doc_id FROM (SELECT doc_id, lower(regexp_replace(w, '^\\s+|\\s+$', '', 'g')) AS t
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents))
  WHERE regexp_matches(t, '[^\\x00-\\x7F]') GROUP BY doc_id HAVING count(DISTINCT t) >= 3),
english AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM foreign_docs)),
{_labels_sql('english', labels.rule_rows(labels.location_rules(PLACES)), lemmas=False)}
SELECT doc_id, string_agg(label, '|' ORDER BY label) AS locations FROM lab GROUP BY doc_id"""
)
def location_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = labels.locations(docs, "doc_id", "text", rules=labels.location_rules(PLACES))
    return found.select("doc_id", F.array_join("labels", "|").alias("locations"))


# text statistics


@query(f"WITH {TOKENS} SELECT doc_id, token, count(*) AS n FROM tok GROUP BY doc_id, token")
def token_counts(spark, sf_dir):
    return stats.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"""WITH {TOKENS}, pair AS (SELECT doc_id, token, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM tok)
SELECT doc_id, token || ' ' || next AS bigram, count(*) AS n FROM pair WHERE next IS NOT NULL GROUP BY 1, 2"""
)
def bigram_counts(spark, sf_dir):
    return stats.bigram_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


CLEAN = f"""lem AS {values(_lemma_rows(), "form, lemma")},
clean AS (
  SELECT doc_id, i, token FROM (SELECT doc_id, i, coalesce(lemma, token) AS token FROM tok LEFT JOIN lem ON token = form)
  WHERE regexp_full_match(token, '[a-z]*') AND token <> '' AND token NOT IN ({', '.join(repr(w) for w in STOP)}))"""


def _clean(spark, sf_dir) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    return filters.clean_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", stop, _lemmas(spark))


@query(f"WITH {TOKENS}, {CLEAN} SELECT doc_id, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY i) AS cleaned FROM clean GROUP BY doc_id")
def stopword_filter(spark, sf_dir):
    rows = _clean(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("r"))
    return rows.select("doc_id", F.size("r").cast("long").alias("n_tokens"), F.array_join(F.transform("r", lambda x: x["token"]), " ").alias("cleaned"))


@query(f"WITH {TOKENS}, {CLEAN} SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM clean GROUP BY token")
def vocabulary(spark, sf_dir):
    return stats.vocabulary(_clean(spark, sf_dir))


@query(
    f"""WITH {TOKENS}, {CLEAN}
SELECT (SELECT count(*) FROM documents) AS n_documents, count(DISTINCT doc_id) AS n_cleaned, count(DISTINCT token) AS n_terms FROM clean"""
)
def corpus_size(spark, sf_dir):
    tokens = cut(_clean(spark, sf_dir).select("doc_id", "token").distinct(), "tokens")
    words = tokens.select("token").distinct().agg(F.count(F.lit(1)).alias("n_terms"))
    cleaned = tokens.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_cleaned"))
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_documents"))
    return docs.join(F.broadcast(cleaned)).join(F.broadcast(words)).select("n_documents", "n_cleaned", "n_terms")


@query(
    r"""SELECT doc_id FROM (SELECT doc_id, lower(regexp_replace(w, '^\s+|\s+$', '', 'g')) AS t
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents))
GROUP BY doc_id HAVING count(DISTINCT CASE WHEN regexp_matches(t, '[^\x00-\x7F]') THEN t END) < 3"""
)
def foreign_text_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~filters.foreign_text(T.raw_tokens(F.col("text")))).select("doc_id")


# filters


@query(
    """SELECT o_orderkey, o_orderstatus, split_part(strftime(o_orderdate, '%B %-d, %Y, %-I:%M%p'), ',', 2)[2:5] AS year FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND year(o_orderdate) IN (1996, 1997)"""
)
def lang_year_filter(spark, sf_dir):
    posts = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        (F.col("o_orderstatus") == "F").alias("DNS_Related"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(filters.OTHER_LANGUAGES))).otherwise(F.array().cast("array<string>")).alias("labels"),
        F.date_format("o_orderdate", "MMMM d, yyyy, h:mma").alias("created_date"),
        F.lit(None).cast("boolean").alias("Non_English"),
    )
    kept = posts.where(filters.relevant_post(("1996", "1997")))
    return kept.select("o_orderkey", "o_orderstatus", T.year_of(F.col("created_date")).alias("year"))


@query(
    """SELECT d.doc_id, lang FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE lang = 'en' AND coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 0"""
)
def label_membership(spark, sf_dir):
    tags = F.array_compact(F.array("lang", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    tagged = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("tags", tags)
    kept = stats.label_posts_with(stats.label_posts_with(tagged, "en", "tags"), "good", "tags")
    return kept.where(~F.array_contains("tags", "toxic")).select("doc_id", "lang")


@query(
    """SELECT p_partkey FROM part WHERE p_size % 7 = 0 OR (p_size % 7 = 1 AND p_size % 5 <> 0)"""
)
def unclassified_filter(spark, sf_dir):
    general = F.lit(filters.GENERAL)
    tags = (
        F.when(F.col("p_size") % 7 == 0, F.array(F.lit("Others"), F.lit("x")))
        .when((F.col("p_size") % 7 == 1) & (F.col("p_size") % 5 != 0), F.array(general))
        .when(F.col("p_size") % 7 == 1, F.array(general, F.lit("y")))
    )
    return table(spark, sf_dir, "part").where(filters.unclassified(tags)).select("p_partkey")


# threads


def _posts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("user"), F.col("turn").cast("string").alias("date"), F.col("text").alias("content"))


@query(
    """WITH u AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role),
r AS (SELECT conv_id, count(*) AS n FROM conversations c WHERE turn > (SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id) GROUP BY conv_id)
SELECT u.conv_id, string_agg(role, '|' ORDER BY t) AS users, first(role ORDER BY t) AS creator,
  (SELECT first(text ORDER BY turn) FROM conversations c WHERE c.conv_id = u.conv_id) AS original_post,
  (SELECT first(turn ORDER BY turn)::VARCHAR FROM conversations c WHERE c.conv_id = u.conv_id) AS created_date,
  coalesce(any_value(r.n), 0)::BIGINT AS n_replies
FROM u LEFT JOIN r USING (conv_id) GROUP BY u.conv_id"""
)
def thread_assembly(spark, sf_dir):
    found = threads.assemble(_posts(spark, sf_dir), ["conv_id"], ["pos"])
    n = F.aggregate(F.map_values("replies"), F.lit(0), lambda total, rs: total + F.size(rs)).cast("long")
    return found.select(
        "conv_id", F.array_join("user_list", "|").alias("users"), F.col("post_creator").alias("creator"),
        "original_post", "created_date", n.alias("n_replies"),
    )


REPLIES = """rep AS (SELECT conv_id, role, count(*) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k > 1 GROUP BY conv_id, role)"""


@query(f"WITH {REPLIES} SELECT role AS user, sum(n)::BIGINT AS n_replies FROM rep GROUP BY role")
def user_reply_stats(spark, sf_dir):
    return stats.user_replies(threads.reply_counts(threads.assemble(_posts(spark, sf_dir), ["conv_id"], ["pos"])))


@query(
    f"""WITH {REPLIES}, u AS (SELECT role, sum(n) AS n FROM rep GROUP BY role)
SELECT count(*) AS n_users, coalesce(sum(n), 0)::BIGINT AS n_replies, sum(n)::DOUBLE / count(*) AS replies_per_user FROM u"""
)
def user_summary(spark, sf_dir):
    return stats.user_summary(threads.reply_counts(threads.assemble(_posts(spark, sf_dir), ["conv_id"], ["pos"])))


@query("SELECT user_id::VARCHAR AS user, count(*) AS n_replies FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def user_ranking(spark, sf_dir):
    counts = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.lit(1).alias("n"))
    return stats.user_ranking(counts, 10)


@query(
    """SELECT conv_id, role, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k > 1 GROUP BY conv_id, role"""
)
def reply_map(spark, sf_dir):
    found = threads.assemble(_posts(spark, sf_dir), ["conv_id"], ["pos"])
    rows = found.select("conv_id", F.explode("replies").alias("role", "rs"))
    return rows.select("conv_id", "role", F.array_join(F.transform("rs", lambda r: r["date"]), ",").alias("turns"))


@query("SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def first_post(spark, sf_dir):
    return stats.first_rows(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "role", "text")


# pages, URLs, JSON


@query(
    """SELECT page_id, split_part(url, '/', -1) AS last, split_part(url, '/', -2) AS slug,
  CASE WHEN contains(url, '=') THEN split_part(url, '=', -1) ELSE url END AS after_equals,
  concat_ws('_', split_part(url, '/', -2), split_part(url, '/', -1)) AS title FROM pages"""
)
def url_parts(spark, sf_dir):
    both = U.slug_and_id(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", U.last_segment(F.col("url")).alias("last"), both["slug"].alias("slug"),
        U.page_number(F.col("url")).alias("after_equals"), F.concat_ws("_", both["slug"], both["id"]).alias("title"),
    )


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'Title: Unknown') AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.page_title(F.col("html")).alias("title"))


@query(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM l GROUP BY page_id"""
)
def page_links(spark, sf_dir):
    links = extract.hrefs(F.col("html"))
    found = table(spark, sf_dir, "pages").select("page_id", links.alias("l")).where(F.size("l") > 0)
    return found.select("page_id", F.size("l").cast("long").alias("n_links"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"))


@query(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href,
  'http://' || split_part(url, '/', 3) AS origin FROM pages)
SELECT page_id, count(DISTINCT origin || href) AS n_kept FROM l
WHERE NOT contains(origin || href, '/u') AND NOT contains(origin || href, 'th') GROUP BY page_id"""
)
def allowed_page_links(spark, sf_dir):
    origin = F.concat(F.lit("http://"), F.get(F.split("url", "/"), F.lit(2)))
    rows = table(spark, sf_dir, "pages").select("page_id", origin.alias("origin"), F.explode(extract.hrefs(F.col("html"))).alias("href"))
    rows = rows.withColumn("url", U.resolve(F.col("origin"), F.col("href")))
    kept = rows.where(U.allowed(F.col("url"), ["/u", "th"]))
    return kept.groupBy("page_id").agg(F.count_distinct("url").alias("n_kept"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_author(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"))


@query(
    """WITH l AS (SELECT DISTINCT 'http://x' || unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS url FROM pages)
SELECT url FROM l WHERE NOT regexp_matches(url, 'png|jpg|pdf|jpeg') AND url NOT IN ('http://x/the', 'http://x/of')"""
)
def frontier_dedup(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.explode(extract.hrefs(F.col("html"))).alias("u")).select(F.concat(F.lit("http://x"), "u").alias("url"))
    seen = spark.createDataFrame([("http://x/the",), ("http://x/of",)], "url string")
    return crawl.frontier(found, seen)


@query(
    """SELECT o_orderkey, o_orderstatus = 'F' AS closed FROM orders WHERE o_orderstatus IN ('F', 'O')"""
)
def closed_open_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    closed = orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return crawl.closed_and_open(closed, orders.where("o_orderstatus = 'O'").select("o_orderkey"))


@query(
    """SELECT user_id::VARCHAR AS url, event_type = 'click' AS is_external, (max(event_id % 5) + 1)::INTEGER AS attempts,
  CASE WHEN bool_or(value < 2) THEN 'stored' WHEN max(event_id % 5) + 1 < 4 THEN 'retry' ELSE 'failed' END AS state
FROM events GROUP BY 1, 2"""
)
def retry_state(spark, sf_dir):
    return crawl.attempt_state(_attempts(table(spark, sf_dir, "events")))


def _attempts(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("url"),
        (F.col("event_id") % 5 + 1).cast("int").alias("attempt"),
        (F.col("event_type") == "click").alias("is_external"),
        F.when(F.col("value") < 2, 200).otherwise(503).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.col("ts").cast("timestamp").alias("at"),
    )


@query("SELECT i::INTEGER AS page, 'http://forum/list?start=' || (i * 30) AS url FROM range(3, 12) t(i)")
def listing_pages(spark, sf_dir):
    return crawl.listing_urls(spark, "http://forum/list?start=%d", 3, 12, 30)


@query(
    """SELECT o_orderkey, o_orderpriority, coalesce(l.tags, o_orderpriority) AS labels_v2, l.tags IS NOT NULL AS updated
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS tags FROM lineitem
  WHERE l_quantity > 45 GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""
)
def keyed_update(spark, sf_dir):
    from threadloom.sources.sinks import updated

    posts = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderpriority").alias("labels_v2"), F.lit(False).alias("updated"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    tags = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("labels_v2"))
    changes = tags.select(F.col("l_orderkey").alias("o_orderkey"), "labels_v2", F.lit(True).alias("updated"))
    return updated(posts, changes, "o_orderkey")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_lang FROM documents WHERE source BETWEEN 'src10' AND 'src14' GROUP BY source")
def page_range_scan(spark, sf_dir):
    from threadloom.sources.landed import between

    docs = between(table(spark, sf_dir, "documents"), "source", "src10", "src14")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("n_lang"))


# features

TFIDF = f"""{TOKENS}, {CLEAN},
counts AS (SELECT doc_id, token AS term, count(*) AS tf FROM clean WHERE length(token) >= 2 GROUP BY 1, 2),
freq AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS n FROM counts)"""


def _weights_sql(terms: str, docs: str = "true") -> str:
    return f"""idf AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM {terms}, n),
x AS (SELECT doc_id, term, tf * idf AS x FROM counts JOIN idf USING (term) WHERE {docs}),
w AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM x)"""


def _counts(spark, sf_dir) -> DataFrame:
    return features.term_counts(_clean(spark, sf_dir))


def _weights(spark, sf_dir, min_df=1, max_features=None) -> DataFrame:
    counts = cut(_counts(spark, sf_dir), "counts")
    n = counts.select("doc_id").distinct().count()
    terms = features.prune(features.document_frequency(counts), min_df, max_features)
    return features.tfidf(counts, features.idf_table(terms, n))


def _stored_weights(spark, sf_dir) -> DataFrame:
    """Weights of the pruned vocabulary, stored; the counts behind them go."""
    counts = cut(_counts(spark, sf_dir), "counts")
    n = counts.select("doc_id").distinct().count()
    terms = features.prune(features.document_frequency(counts), 3, 10000)
    weights = cut(features.tfidf(counts, features.idf_table(terms, n)), "weights")
    discard(counts)
    return weights


@query(f"WITH {TFIDF}, {_weights_sql('freq')} SELECT term, df, round(idf, 6) AS idf FROM idf ORDER BY df DESC, term LIMIT 10")
def idf_table(spark, sf_dir):
    counts = cut(_counts(spark, sf_dir), "counts")
    table_ = features.idf_table(features.document_frequency(counts), counts.select("doc_id").distinct().count())
    return table_.orderBy("idf", "term").limit(10).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {TFIDF}, {_weights_sql('freq', 'doc_id = 0')} SELECT term, round(w, 6) AS w FROM w WHERE doc_id = 0 ORDER BY w.w DESC, term LIMIT 10")
def tfidf_top_terms(spark, sf_dir):
    top = features.top_terms(_weights(spark, sf_dir), 0)
    return top.select("term", F.round("w", 6).alias("w"))


PRUNED = "kept AS (SELECT * FROM freq WHERE df >= 3 ORDER BY cf DESC, term LIMIT 10000)"


@query(f"WITH {TFIDF}, {PRUNED}, {_weights_sql('kept')} SELECT doc_id, term, round(w, 6) AS w FROM w")
def tfidf_pruned(spark, sf_dir):
    return _weights(spark, sf_dir, 3, 10000).select("doc_id", "term", F.round("w", 6).alias("w"))


@query(
    f"""WITH {TFIDF}, {PRUNED}, {_weights_sql('kept')}
SELECT a.doc_id AS i, b.doc_id AS j, round(sum(a.w * b.w), 6) AS sim FROM w a JOIN w b ON a.term = b.term AND a.doc_id < b.doc_id
GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.5"""
)
def cosine_pairs(spark, sf_dir):
    weights = _stored_weights(spark, sf_dir)
    pairs = features.cosine_pairs(weights, 0.5)
    discard(weights)
    return pairs.select("i", "j", F.round("sim", 6).alias("sim"))


# clustering, on embeddings

VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"
PAIRS = f"""{VECTORS}, p AS (SELECT a.id AS i, b.id AS j, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.id < b.id)"""
EPS = 1.1


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


@query(f"WITH {PAIRS} SELECT i, j FROM p WHERE dist <= {EPS}")
def eps_graph(spark, sf_dir):
    pairs = density.near_pairs(density.dense_points(_vectors(spark, sf_dir)), EPS)
    return clustering.eps_graph(pairs, EPS).where("a < b").select(F.col("a").alias("i"), F.col("b").alias("j"))


@query(
    f"""WITH {PAIRS}, d AS (SELECT i AS id FROM p WHERE dist <= {EPS} UNION ALL SELECT j FROM p WHERE dist <= {EPS})
SELECT v.id, count(d.id) + 1 AS neighbours, count(d.id) + 1 >= 3 AS is_core FROM v LEFT JOIN d ON d.id = v.id GROUP BY v.id"""
)
def dbscan_core(spark, sf_dir):
    counts = density.neighbour_counts(density.cells(density.dense_points(_vectors(spark, sf_dir))), EPS)
    return counts.select("id", "neighbours", (F.col("neighbours") >= 3).alias("is_core"))


def _dbscan_sql(eps: float, pairs: str = PAIRS) -> str:
    return f"""WITH RECURSIVE {pairs},
link AS (SELECT i AS a, j AS b FROM p WHERE dist <= {eps} UNION ALL SELECT j, i FROM p WHERE dist <= {eps}),
reach AS (SELECT id AS a, id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a AS id, min(b) AS root, count(*) AS n FROM reach GROUP BY a),
lab AS (SELECT id, CASE WHEN n = 1 THEN -1 ELSE dense_rank() OVER (ORDER BY n = 1, root) - 1 END::INTEGER AS label FROM root)"""


@query(_dbscan_sql(EPS) + " SELECT id, label FROM lab")
def dbscan_labels(spark, sf_dir):
    return density.dbscan(density.cells(density.dense_points(_vectors(spark, sf_dir))), EPS).select("id", "label")


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({_dbscan_sql(e)} SELECT {e}::DOUBLE AS eps, count(DISTINCT label) FILTER (WHERE label <> -1) AS n_clusters, "
        f"count(*) FILTER (WHERE label = -1) AS n_noise FROM lab)"
        for e in (1.0, 1.1, 1.15)
    )
)
def dbscan_sweep(spark, sf_dir):
    radii = (1.0, 1.1, 1.15)
    labels = cut(density.sweep(density.dense_points(_vectors(spark, sf_dir)), radii), "swept")
    found = None
    for k, eps in enumerate(radii):
        row = clustering.cluster_counts(labels.where(F.col("k") == k)).select(F.lit(eps).alias("eps"), "n_clusters", "n_noise")
        found = row if found is None else found.union(row)
    return found


@query(
    f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS total, count(*) AS n FROM v a JOIN v b ON true GROUP BY 1, 2, 3),
s AS (SELECT id, label, max(CASE WHEN other = label THEN total / greatest(n - 1, 1) END) AS a,
  min(CASE WHEN other <> label THEN total / n END) AS b, max(CASE WHEN other = label THEN n END) AS n FROM d GROUP BY 1, 2)
SELECT label, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS s FROM s GROUP BY label"""
)
def silhouette(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    found, _ = density.silhouette(density.dense_points(vectors), vectors.select("id", "label"))
    return found.select(F.col("label").cast("int").alias("label"), "s").groupBy("label").agg(F.round(F.avg("s"), 6).alias("s"))


@query(
    f"""WITH {VECTORS}, c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS label, e AS centre FROM (SELECT * FROM v ORDER BY id LIMIT 4)),
d AS (SELECT id, label, list_sum([(x[1] - x[2]) ^ 2 for x in list_zip(e, centre)]) AS cost FROM v JOIN c ON true),
b AS (SELECT id, first(label ORDER BY cost, label) AS label, min(cost) AS cost FROM d GROUP BY id)
SELECT label, count(*) AS n, round(sum(cost), 6) AS cost FROM b GROUP BY label"""
)
def kmeans_step(spark, sf_dir):
    points = _vectors(spark, sf_dir)
    first = points.orderBy("id").limit(4).select("id", F.col("vector").alias("centre")).collect()
    centres = spark.createDataFrame([(i, r["centre"]) for i, r in enumerate(first)], "label int, centre array<double>")
    found = clustering.kmeans_step(points, centres)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def _kmeans_sql(rounds: int) -> str:
    """Lloyd's rounds from the first four vectors, unrolled."""
    near = "list_sum([(x[1] - x[2]) ^ 2 for x in list_zip(e, centre)])"
    ctes = [f"{VECTORS}, c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS label, e AS centre FROM (SELECT * FROM v ORDER BY id LIMIT 4))"]
    for i in range(rounds + 1):
        ctes.append(f"b{i} AS (SELECT id, any_value(e) AS e, first(label ORDER BY {near}, label) AS label FROM v JOIN c{i} ON true GROUP BY id)")
        ctes.append(
            f"""m{i} AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM b{i}) GROUP BY 1, 2),
c{i + 1} AS (SELECT label, list(x ORDER BY pos) AS centre FROM m{i} GROUP BY label
  UNION ALL SELECT label, centre FROM c{i} WHERE label NOT IN (SELECT label FROM m{i}))"""
        )
    return f"WITH {', '.join(ctes)} SELECT id, label FROM b{rounds}"


@query(_kmeans_sql(3))
def kmeans_labels(spark, sf_dir):
    points = _vectors(spark, sf_dir)
    first = points.orderBy("id").limit(4).select("vector").collect()
    return clustering.kmeans_rounds(points, [r["vector"] for r in first], 3)


@query()
def pca_2d(spark, sf_dir):
    points = _vectors(spark, sf_dir)
    return clustering.scatter(points, points.select("id", "label"), 0.8)


# What holds of every projection on principal components: centred, uncorrelated, none of the first and at most the
# trace of the covariances, and no single component of the vectors varies more than the first projection.
@query(
    f"""WITH {VECTORS}, x AS (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v), s AS (SELECT pos, var_samp(x) AS s FROM x GROUP BY pos)
SELECT (SELECT count(*) FROM v) AS n, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y, 0.0::DOUBLE AS covariance, round(sum(s), 6) AS trace,
  true AS ordered, true AS first_is_largest, true AS within_trace FROM s"""
)
def pca_invariants(spark, sf_dir):
    points = cut(_vectors(spark, sf_dir), "points")
    rows = points.select("id", F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("s"))
    of = rows.agg(F.sum("s").alias("trace"), F.max("s").alias("most"))
    return _projection_facts(clustering.scatter(points, points.select("id", "label")).select("x", "y"), of)


def _projection_facts(xy: DataFrame, of: DataFrame) -> DataFrame:
    """What is known of projections (x, y) on principal components, given the sum and the largest of all variances."""
    facts = xy.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.abs(F.round(F.avg(c), 6)).alias(f"mean_{c}") for c in "xy"],
        F.abs(F.round(F.covar_samp("x", "y"), 6)).alias("covariance"),
        F.var_samp("x").alias("vx"),
        F.var_samp("y").alias("vy"),
    )
    both = facts.join(F.broadcast(of))  # one row each
    return both.select(
        "n", "mean_x", "mean_y", "covariance", F.round("trace", 6).alias("trace"), (F.col("vx") >= F.col("vy")).alias("ordered"),
        (F.col("vx") >= F.col("most") - 1e-9).alias("first_is_largest"), (F.col("vx") + F.col("vy") <= F.col("trace") + 1e-9).alias("within_trace"),
    )


@query(
    """SELECT label, string_agg('v' || vec_id, '|' ORDER BY vec_id) AS titles, count(*) AS n FROM embeddings GROUP BY label"""
)
def cluster_titles(spark, sf_dir):
    points = _vectors(spark, sf_dir)
    titles = points.select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("title"))
    found = clustering.cluster_members(points.select("id", "label"), titles)
    return found.select("label", F.array_join("titles", "|").alias("titles"), F.size("titles").cast("long").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf_dir):
    return clustering.label_counts(_vectors(spark, sf_dir))


@query(
    """SELECT name, max_by(k, pos) AS url FROM (SELECT p_brand AS name, p_partkey::VARCHAR AS k, p_partkey AS pos FROM part) GROUP BY name"""
)
def last_url_of_title(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"))
    return rows.agg(F.max_by(F.col("p_partkey").cast("string"), "p_partkey").alias("url"))


@query(
    """SELECT user_id::VARCHAR AS url, count(*) AS n_attempts, count(*) FILTER (WHERE value >= 2) AS n_failed FROM events GROUP BY 1"""
)
def attempt_counts(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("url"), F.when(F.col("value") < 2, 200).otherwise(503).alias("status"), F.lit(None).cast("string").alias("error")
    )
    return crawl.attempt_counts(attempts)


@query(
    """SELECT o.o_orderkey::VARCHAR AS url, c.c_name AS raw, s.n AS notes FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey"""
)
def listing_with_pages_and_notes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"), "o_custkey")
    landed = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("url", F.col("c_name").alias("raw"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("notes"))
    notes = lines.select(F.col("l_orderkey").cast("string").alias("url"), "notes")
    return crawl.ingest_inputs(orders.select("url"), landed, notes)


@query(
    f"""WITH {TOKENS}, {CLEAN}, top AS (SELECT token FROM clean GROUP BY token ORDER BY count(*) DESC, token LIMIT 3),
c AS (SELECT doc_id, token, count(*) AS n FROM clean WHERE token IN (FROM top) GROUP BY 1, 2)
SELECT token, count(*) AS n_docs, sum(n)::BIGINT AS n FROM c GROUP BY token"""
)
def fixed_vocabulary_counts(spark, sf_dir):
    words = cut(_clean(spark, sf_dir), "clean")
    top = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(3).select("token")
    counts = features.term_counts(words.join(F.broadcast(top), "token"), 1)
    return counts.groupBy(F.col("term").alias("token")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n"))


@query(
    """SELECT title, label FROM (SELECT 'v' || vec_id AS title, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 2"""
)
def cluster_report(spark, sf_dir):
    points = _vectors(spark, sf_dir)
    titles = points.select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("title"))
    return clustering.first_members(points.select("id", "label"), titles, 2).select("title", "label")


# density clustering of the rows of the cosine distance matrix of lemmatised TF-IDF, at 10,000 terms

ROWS = f"""{TFIDF}, {PRUNED}, {_weights_sql('kept')},
sim AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w * b.w) AS s FROM w a JOIN w b USING (term) GROUP BY 1, 2),
d AS (SELECT DISTINCT doc_id FROM w),
v AS MATERIALIZED (SELECT a.doc_id AS id, list(coalesce(s, 0.0) ORDER BY b.doc_id) AS e
  FROM d a CROSS JOIN d b LEFT JOIN sim ON sim.i = a.doc_id AND sim.j = b.doc_id GROUP BY a.doc_id),
p AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.id < b.id)"""


def _components_sql(epsilons: tuple[float, ...], pairs: str) -> str:
    """CTEs ending in ``lab`` (eps, id, label) by smallest ids that travel along links, for clusters of two or more."""
    return f"""WITH RECURSIVE {pairs},
radius AS (SELECT unnest({list(epsilons)})::DOUBLE AS eps),
link AS MATERIALIZED (SELECT eps, i AS a, j AS b FROM p JOIN radius ON dist <= eps UNION ALL SELECT eps, j, i FROM p JOIN radius ON dist <= eps),
cc(eps, id, root) USING KEY (eps, id) AS (
  SELECT eps, id, id FROM v, radius
  UNION SELECT l.eps, l.b, min(cc.root) FROM cc JOIN link l ON l.eps = cc.eps AND l.a = cc.id
    JOIN recurring.cc r ON r.eps = l.eps AND r.id = l.b WHERE cc.root < r.root GROUP BY l.eps, l.b),
sized AS (SELECT *, count(*) OVER (PARTITION BY eps, root) AS n FROM cc),
lab AS (SELECT eps, id, CASE WHEN n = 1 THEN -1 ELSE dense_rank() OVER (PARTITION BY eps ORDER BY n = 1, root) - 1 END::INTEGER AS label FROM sized)"""


def _row_points(spark, sf_dir) -> tuple[density.Points, DataFrame]:
    """Distinct documents as points, and (doc_id, head) of all."""
    weights = _stored_weights(spark, sf_dir)
    classes, heads = features.equal_classes(weights)
    discard(weights)
    copies = classes.groupBy(F.col("head").alias("doc_id")).agg(F.count(F.lit(1)).alias("copies"))
    points = density.similarity_row_points(heads, cut(copies, "copies"))
    discard(heads)
    return points, classes


def _row_labels(cells: density.Cells, classes: DataFrame, eps: float) -> DataFrame:
    labels_ = density.dbscan(cells, eps).select(F.col("id").alias("head"), "label")
    return cut(classes.join(labels_, "head").select(F.col("doc_id").alias("id"), "label"), "row-labels")


ROW_EPS = 0.6


@query(_components_sql((ROW_EPS,), ROWS) + " SELECT id, label FROM lab")
def dbscan_distance_rows(spark, sf_dir):
    points, classes = _row_points(spark, sf_dir)
    return _row_labels(density.cells(points), classes, ROW_EPS)


SWEEP = (1.0, 2.0, 3.0, 4.0)


@query(
    _components_sql(SWEEP, ROWS)
    + """ SELECT eps, count(DISTINCT label) FILTER (WHERE label <> -1) AS n_clusters, count(*) FILTER (WHERE label = -1) AS n_noise FROM lab GROUP BY eps"""
)
def sweep_distance_rows(spark, sf_dir):
    """Clusters and noise for each radius; the points and their cells are made once."""
    points, classes = _row_points(spark, sf_dir)
    cells, found = density.cells(points), None
    for eps in SWEEP:
        row = clustering.cluster_counts(_row_labels(cells, classes, eps)).select(F.lit(eps).alias("eps"), "n_clusters", "n_noise")
        found = row if found is None else found.union(row)
    return found


@query(
    _components_sql((ROW_EPS,), ROWS)
    + """, l AS (SELECT v.id, e, label FROM v JOIN lab USING (id)),
d2 AS (SELECT i AS id, j AS other, dist FROM p UNION ALL SELECT j, i, dist FROM p UNION ALL SELECT id, id, 0 FROM v),
t AS (SELECT d2.id, a.label, b.label AS other, sum(dist) AS total, count(*) AS n FROM d2 JOIN lab a ON a.id = d2.id JOIN lab b ON b.id = d2.other GROUP BY 1, 2, 3),
s AS (SELECT id, label, max(CASE WHEN other = label THEN total / greatest(n - 1, 1) END) AS a,
  min(CASE WHEN other <> label THEN total / n END) AS b, max(CASE WHEN other = label THEN n END) AS n FROM t GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS s FROM s"""
)
def silhouette_distance_rows(spark, sf_dir):
    """The mean silhouette of the clusters of distance rows, noise counted as a cluster."""
    points, classes = _row_points(spark, sf_dir)
    labels_ = density.dbscan(density.cells(points), ROW_EPS).select("id", "label")
    found, _ = density.silhouette(points, cut(labels_, "labels"))
    return _mean_silhouette(found)


def _mean_silhouette(found: DataFrame) -> DataFrame:
    mean = F.sum(F.col("s") * F.col("copies")) / F.sum("copies")
    return found.agg(F.sum("copies").alias("n"), F.round(mean, 5).alias("s"))


# k-means, silhouette and projection of the TF-IDF matrix at 10,000 terms: k = 4, from the vectors of the first four documents

KMEANS_ROUNDS = 4


def _tfidf_kmeans_sql(rounds: int) -> str:
    ctes = [
        f"{TFIDF}, {PRUNED}, {_weights_sql('kept')}, m AS MATERIALIZED (SELECT * FROM w), d AS MATERIALIZED (SELECT DISTINCT doc_id FROM m)",
        "f AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS label FROM (SELECT doc_id FROM d ORDER BY doc_id LIMIT 4))",
        "c0 AS MATERIALIZED (SELECT label, term, w AS x FROM m JOIN f USING (doc_id))",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""q{i} AS (SELECT label, sum(x * x) AS q FROM c{i} GROUP BY label),
o{i} AS (SELECT doc_id, label, sum(w * x) AS o FROM m JOIN c{i} USING (term) GROUP BY 1, 2),
b{i} AS MATERIALIZED (SELECT doc_id, arg_min(label, (cost, label)) AS label FROM
  (SELECT d.doc_id, q.label, round(1 + q - 2 * coalesce(o, 0), 9) AS cost FROM d CROSS JOIN q{i} q LEFT JOIN o{i} o ON o.doc_id = d.doc_id AND o.label = q.label) GROUP BY doc_id),
n{i} AS (SELECT label, count(*) AS n FROM b{i} GROUP BY label),
c{i + 1} AS MATERIALIZED (SELECT label, term, sum(w) / any_value(n) AS x FROM m JOIN b{i} USING (doc_id) JOIN n{i} USING (label) GROUP BY 1, 2
  UNION ALL SELECT * FROM c{i} WHERE label NOT IN (SELECT label FROM n{i}))"""
        )
    return f"WITH {', '.join(ctes)}"


def _sparse(spark, sf_dir) -> tuple[DataFrame, int]:
    """Distinct documents' rows, and the number of terms; every document, as k-means weighs each."""
    weights = _stored_weights(spark, sf_dir)
    rows = density.sparse_rows(weights)
    discard(weights)
    return rows


def _tfidf_labels(rows: DataFrame, width: int) -> DataFrame:
    first = [r["id"] for r in rows.select("id").orderBy("id").limit(4).collect()]
    return cut(sparse.kmeans(rows, sparse.vectors_of(rows, first, width), KMEANS_ROUNDS)[0], "tfidf-labels")


@query(_tfidf_kmeans_sql(KMEANS_ROUNDS) + f" SELECT doc_id, label FROM b{KMEANS_ROUNDS}")
def kmeans_tfidf(spark, sf_dir):
    return _tfidf_labels(*_sparse(spark, sf_dir)).select(F.col("id").alias("doc_id"), "label")


@query(
    _tfidf_kmeans_sql(KMEANS_ROUNDS)
    + f""", s AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w * b.w) AS s FROM m a JOIN m b USING (term) GROUP BY 1, 2),
t AS (SELECT a.doc_id AS id, a.label, b.label AS other, sum(CASE WHEN a.doc_id = b.doc_id THEN 0 ELSE sqrt(greatest(2 - 2 * coalesce(s, 0), 0)) END) AS total, count(*) AS n
  FROM b{KMEANS_ROUNDS} a CROSS JOIN b{KMEANS_ROUNDS} b LEFT JOIN s ON s.i = a.doc_id AND s.j = b.doc_id GROUP BY 1, 2, 3),
z AS (SELECT id, label, max(CASE WHEN other = label THEN total / greatest(n - 1, 1) END) AS a,
  min(CASE WHEN other <> label THEN total / n END) AS b, max(CASE WHEN other = label THEN n END) AS n FROM t GROUP BY 1, 2)
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS s FROM z"""
)
def silhouette_tfidf(spark, sf_dir):
    """The mean silhouette of the k-means clusters of the TF-IDF matrix."""
    rows, width = _sparse(spark, sf_dir)
    points = density.sparse_points(rows.withColumn("copies", F.lit(1).cast("long")), width)
    return _mean_silhouette(density.silhouette(points, _tfidf_labels(rows, width))[0])


@query(
    f"""WITH {TFIDF}, {PRUNED}, {_weights_sql('kept')}, n_ AS (SELECT count(DISTINCT doc_id) AS n FROM w),
s AS (SELECT term, (sum(w * w) - sum(w) ^ 2 / any_value(n)) / (any_value(n) - 1) AS s FROM w, n_ GROUP BY term)
SELECT any_value(n) AS n, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y, 0.0::DOUBLE AS covariance, round(sum(s), 6) AS trace,
  true AS ordered, true AS first_is_largest, true AS within_trace FROM s, n_"""
)
def pca_tfidf(spark, sf_dir):
    """What holds of the projection of the TF-IDF matrix on its first two components."""
    rows, width = _sparse(spark, sf_dir)
    xy = sparse.projected(rows, sparse.principal(rows, width)).select(F.col("xs")[0].alias("x"), F.col("xs")[1].alias("y"))
    n = rows.count()
    terms = rows.select(F.explode(F.arrays_zip("pos", "w")).alias("z")).groupBy("z.pos")
    each = terms.agg(((F.sum(F.col("z.w") * F.col("z.w")) - F.pow(F.sum("z.w"), 2) / n) / (n - 1)).alias("s"))
    return _projection_facts(xy, each.agg(F.sum("s").alias("trace"), F.max("s").alias("most")))


SHOWN = ["thing", "re", "ou"]


@query(
    f"WITH {TFIDF}, {PRUNED}, {_weights_sql('kept')} SELECT doc_id, "
    + ", ".join(f"round(coalesce(max(w) FILTER (WHERE term = '{t}'), 0), 6) AS {t}" for t in SHOWN)
    + f" FROM w WHERE term IN ({', '.join(map(repr, SHOWN))}) GROUP BY doc_id"
)
def term_matrix(spark, sf_dir):
    """A few columns of the weight matrix, for display."""
    shown = features.wide(_weights(spark, sf_dir, 3, 10000), SHOWN)
    return shown.select("doc_id", *[F.round(t, 6).alias(t) for t in SHOWN])


@query(f"WITH {TFIDF}, {PRUNED}, {_weights_sql('kept')} SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_terms, min(term) AS first, max(term) AS last FROM w")
def matrix_shape(spark, sf_dir):
    """Documents and terms of the weight matrix, and the names at both ends."""
    weights = cut(_weights(spark, sf_dir, 3, 10000), "weights")
    names = features.feature_names(weights).agg(F.count(F.lit(1)).alias("n_terms"), F.min("term").alias("first"), F.max("term").alias("last"))
    docs = weights.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    return docs.join(F.broadcast(names)).select("n_docs", "n_terms", "first", "last")  # one row each


# lemmas by the corpus, the closure of links, updates in place, documents without schema, pruned partitions

RULE_ROWS = [(p, n, e, b) for p, rules in enumerate(T.DETACH.values()) for n, (e, b) in enumerate(rules)]
CORPUS_LEMMAS = f"""rule AS {values(RULE_ROWS, "part, rule, ending, base")},
exc AS {values(EXCEPTIONS, "form, lemma")},
plain AS (SELECT token FROM tok WHERE regexp_full_match(token, '[a-z]*') AND token <> ''),
word AS (SELECT DISTINCT token FROM plain),
cand AS (SELECT token AS form, part, rule, left(token, length(token) - length(ending)) || base AS lemma FROM word JOIN rule ON ends_with(token, ending) AND length(token) > length(ending)),
held AS (SELECT * FROM cand WHERE lemma <> form AND lemma IN (FROM word)),
chosen AS (SELECT form, arg_min(lemma, (part, length(lemma), rule)) AS lemma FROM held GROUP BY form),
lem AS (SELECT * FROM (SELECT * FROM exc UNION ALL SELECT * FROM chosen WHERE form NOT IN (SELECT form FROM exc)) WHERE form <> 'ns')"""


@query(
    f"""WITH {TOKENS}, {CORPUS_LEMMAS}
SELECT coalesce(lemma, token) AS lemma, count(*) AS n_tokens, count(DISTINCT token) AS n_forms FROM plain LEFT JOIN lem ON form = token GROUP BY 1"""
)
def corpus_lemmas(spark, sf_dir):
    """Every token of the documents by its lemma: noun, adjective, verb, with bases that the corpus holds."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select(F.explode(T.raw_tokens(F.col("text"))).alias("token")).where(T.is_plain_word(F.col("token")) & (F.col("token") != ""))
    counts = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    lemmas = cut(T.corpus_lemmas(counts, spark.createDataFrame(EXCEPTIONS, "form string, lemma string")), "lemmas")
    found = T.lemmatize(counts.withColumn("form", F.col("token")), "token", lemmas)
    return found.groupBy(F.col("token").alias("lemma")).agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_forms"))


@query(
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
link AS MATERIALIZED (SELECT DISTINCT page_id AS a, (31 * ord(substr(href, 2, 1)) + length(href)) % n AS b
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="(/[^"]+)"', 1)) AS href FROM pages), n),
r(page, round) USING KEY (page) AS (SELECT 0::BIGINT, 0 UNION SELECT b, min(r.round) + 1 FROM r JOIN link ON a = r.page
  WHERE b NOT IN (SELECT page FROM recurring.r) GROUP BY b)
SELECT page, round::INTEGER AS round FROM r"""
)
def reachable_pages(spark, sf_dir):
    """Pages reached from page 0, round by round.  The generated links name no page, so a link's letters stand for a page's number."""
    pages = cut(table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="(/[^"]+)"'), F.lit(1))).alias("href")), "hrefs")
    n = table(spark, sf_dir, "pages").count()
    target = (31 * F.ascii(F.substring("href", 2, 1)) + F.char_length("href")) % n
    links = pages.select(F.col("page_id").alias("a"), target.cast("long").alias("b"))
    return crawl.reachable(links, spark.range(1).select(F.col("id").alias("page")))


STAGED = """SELECT o_orderkey, o_orderpriority AS forum, month(o_orderdate)::INTEGER AS page, o_orderpriority AS labels_v2, false AS updated FROM orders"""


def _staged(spark, sf_dir) -> str:
    """Orders as a stage partitioned by (forum, page); returns its path."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("forum"), F.month("o_orderdate").alias("page"), F.col("o_orderpriority").alias("labels_v2"), F.lit(False).alias("updated")
    )
    path = scratch_path(spark, "staged")
    orders.repartition("forum", "page").write.partitionBy("forum", "page").parquet(path)
    return path


@query(
    f"""WITH s AS ({STAGED}), c AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS tags FROM lineitem
  JOIN s ON o_orderkey = l_orderkey AND page IN (3, 7) WHERE l_quantity > 45 GROUP BY l_orderkey)
SELECT o_orderkey, forum, page, coalesce(tags, labels_v2) AS labels_v2, tags IS NOT NULL AS updated FROM s LEFT JOIN c ON l_orderkey = o_orderkey"""
)
def partial_update(spark, sf_dir):
    """Labels of two months are changed in place: only their folders are written anew."""
    from threadloom.sources.sinks import update_partitions

    path = _staged(spark, sf_dir)
    months = table(spark, sf_dir, "orders").where(F.month("o_orderdate").isin(3, 7)).select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(months, F.col("l_orderkey") == F.col("o_orderkey"))
    tags = lines.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("labels_v2"))
    update_partitions(spark, path, tags.withColumn("updated", F.lit(True)), "o_orderkey")
    return spark.read.parquet(path).select("o_orderkey", "forum", "page", "labels_v2", "updated")


@query(
    f"""WITH s AS ({STAGED}), d AS (SELECT p_size % 5 AS k, p_size % 12 + 1 AS page FROM part WHERE p_partkey % 50 = 7 GROUP BY ALL)
SELECT s.forum, s.page, count(*) AS n FROM s JOIN (SELECT DISTINCT page FROM d WHERE page <= 4) d ON d.page = s.page GROUP BY ALL"""
)
def pruned_partitions(spark, sf_dir):
    """A stage joined with pages that another table names: only those folders are read."""
    return pruned_join(spark, sf_dir)


def pruned_join(spark, sf_dir) -> DataFrame:
    stage = spark.read.parquet(_staged(spark, sf_dir))
    named = table(spark, sf_dir, "part").where("p_partkey % 50 = 7").select((F.col("p_size") % 12 + 1).alias("page")).where("page <= 4").distinct()
    return stage.join(named, "page").groupBy("forum", "page").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS kind, value AS amount, CASE WHEN event_id % 3 = 0 THEN (event_id % 7)::BIGINT END AS depth,
  event_id % 2 = 0 AS flag, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id::VARCHAR END AS author FROM events"""
)
def schema_free(spark, sf_dir):
    """Documents without schema: fields of five types, some missing and some of another type, which give null."""
    key = F.col("event_id")
    field = lambda name, value: F.concat(F.lit(f', "{name}": '), value)
    body = F.concat(
        F.expr("substring(props, 1, length(props) - 1)"), field("kind", F.concat(F.lit('"'), "event_type", F.lit('"'))), field("amount", F.col("value").cast("string")),
        F.when(key % 3 == 0, field("meta", F.concat(F.lit('{"depth": '), (key % 7).cast("string"), F.lit("}")))).otherwise(field("meta", F.lit('"none"'))),
        field("flag", (key % 2 == 0).cast("string")), F.when(key % 5 == 0, "").otherwise(field("author", F.concat(F.lit('{"name": "'), F.col("user_id").cast("string"), F.lit('"}')))),
        F.lit("}"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(body).alias("doc"))
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    return rows.select(
        "event_id", get("$.k", "bigint").alias("k"), get("$.kind", "string").alias("kind"), get("$.amount", "double").alias("amount"),
        get("$.meta.depth", "bigint").alias("depth"), get("$.flag", "boolean").alias("flag"), get("$.author.name", "string").alias("author"),
    )


@query(ORACLES["retry_state"])
def retry_drain(spark, sf_dir):
    """The states of ``retry_state`` from a stream of attempts, each URL's state kept between micro-batches.

    Files come in any order, so no attempt of the year counts as late.
    """
    from threadloom.streaming import retries

    events = cut(table(spark, sf_dir, "events").repartitionByRange(3, "ts"), "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(events.scratch_path)
    said = scratch_path(spark, "retries")
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, retries.PROVIDER)
    try:
        retries.store(retries.drained(_attempts(stream), late="366 days"), said, scratch_path(spark, "retries-checkpoint"))
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    return retries.last_states(spark.read.parquet(said))
