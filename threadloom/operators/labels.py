"""Rule-based labels: rules are a table, matching is one broadcast join and one shuffle by post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import raw_tokens
from threadloom.schemas import RULES

UNCLASSIFIED = "Unclassified"
#: Forms of rule words up to which they are matched inside rows and their table is sent to every task.
MOST_FORMS = 4096

# Keywords, bigrams and thresholds of the labels (fixed values; a word listed twice counts twice).
# label: [(tier, kind, threshold, keywords)]
RULE_LISTS: dict[str, list[tuple[int, str, int, list[str]]]] = {
    "Network Connectivity": [
        (1, "unigram", 2, ["slow", "fail", "block", "time", "traffic", "packet", "refuse", "masquerade", "visitor", "transmit", "performance", "load", "direct", "stable"]),
        (2, "unigram", 1, ["network", "connect", "connectivity", "connection", "timeout", "client", "warp"]),
        (3, "bigram", 1, ["time out", "rate limit", "packet loss", "refuse connection"]),
    ],
    "Management": [
        (2, "unigram", 1, ["registration", "registrar", "register", "nameserver", "nameservers", "account", "transfer", "mydomain", "whois", "godaddy", "icann", "iana", "bluehost"]),
        (3, "bigram", 1, ["go daddy", "name server"]),
    ],
    "Security": [
        (1, "unigram", 3, ["block", "filter", "tunnel", "https", "prevent", "expose", "forbid", "captcha", "safety", "insurance", "guarantee", "warrant", "ward", "shelter", "trouble", "https", "proxy", "proxied", "feign", "intercept", "cert", "certificate"]),
        (2, "unigram", 1, ["security", "secure", "insecurity", "insecure", "firewall", "ddos", "dos", "hijack", "ssl", "tls", "ssl tls", "malware", "attack", "authentication", "authenticate", "protect", "phishing"]),
    ],
    "Website": [
        (1, "unigram", 2, ["display", "redirect", "bypass", "ip", "browser", "load", "response", "responsiveness", "visual", "optimize", "optimization", "setup", "cdn"]),
        (2, "unigram", 1, ["site", "website", "www", "http", "https", "webpage", "page", "certificate", "cert", "redirect"]),
    ],
    "DNS Resolve Related": [(2, "unigram", 1, ["resolve", "resolver", "resolvers"])],
    "Email Related": [(2, "unigram", 1, ["email", "mail"])],
}

# Resolver locations (fixed values).
LOCATIONS = [
    "root server", "tld server", "sld server", "stub resolver", "firewall", "forwarder", "gateway", "ingress server",
    "egress server", "isp resolver", "icann", "iana", "tld registry", "registrar",
]


def rule_rows(lists: dict = RULE_LISTS) -> list[tuple]:
    rows = []
    for ord_, (label, tiers) in enumerate(lists.items(), 1):
        for tier, kind, threshold, words in tiers:
            rows += [(label, ord_, tier, kind, w, words.count(w), threshold) for w in dict.fromkeys(words)]
    return rows


def rule_table(spark: SparkSession, lists: dict = RULE_LISTS) -> DataFrame:
    return spark.createDataFrame(rule_rows(lists), RULES)


def location_rules(locations: list[str] = LOCATIONS) -> dict:
    """Locations as rules: a word, the first word of several, or the words together."""
    out = {}
    for name in locations:
        tiers = [(1, "unigram", 1, [name.split(" ")[0]])]
        out[name] = tiers + ([(2, "bigram", 1, [name])] if " " in name else [])
    return out


def features(texts: DataFrame, keys: list[str], text: str, known: list[str] | None = None) -> DataFrame:
    """(keys, kind, feature) for every distinct token and bigram of ``text``; a text without any keeps its keys.

    With ``known``, features that aren't in that list are dropped inside the row,
    so that only what can match is exploded.
    """
    tokens = raw_tokens(F.col(text))
    pairs = F.transform(
        F.slice("__t", F.lit(1), F.greatest(F.size("__t") - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit(" "), F.get(F.col("__t"), i + 1))
    )
    rows = texts.select(*keys, tokens.alias("__t"))
    both = [F.array_distinct("__t"), F.array_distinct(pairs)]
    if known is not None:
        held = F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<string>")
        both = [F.array_intersect(x, held) for x in both]

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("feature")))

    return rows.select(*keys, F.inline_outer(F.concat(named("unigram", both[0]), named("bigram", both[1]))))


def label(texts: DataFrame, keys: list[str], text: str, rules: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """(keys, labels): labels whose rules hold, in rule order; every text has a row.

    Lemmas are applied to the rules, not to the tokens: a rule word stands for all
    its forms, so tokens meet one table.  Its forms (rules times inflections, at most
    ``MOST_FORMS``) are matched inside the row, and only hits are exploded and joined
    with the broadcast table; one row for each text is shuffled.
    """
    hit = F.struct("ord", "label", "tier", "threshold", "keyword", "n")
    rules = surface_rules(rules, lemmas) if lemmas is not None else rules.withColumn("form", F.col("keyword"))
    forms = [r["form"] for r in rules.select("form").distinct().limit(MOST_FORMS + 1).collect()]
    few = len(forms) <= MOST_FORMS
    matched = _matched(features(texts, keys, text, known=sorted(forms) if few else None), rules, few)
    hits = matched.groupBy(*keys).agg(F.collect_set(F.when(F.col("keyword").isNotNull(), hit)).alias("__hits"))
    return hits.select(*keys, _labels(F.col("__hits")).alias("labels"))


def surface_rules(rules: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``rules`` with ``form``: a row for each form, or pair of forms, whose lemmas make the keyword."""
    parts = F.when(F.col("kind") == "bigram", F.split("keyword", " ")).otherwise(F.array("keyword"))
    split = rules.withColumns({"__a": F.get(parts, F.lit(0)), "__b": F.get(parts, F.lit(1))})
    words = split.select(F.explode(F.array_compact(F.array("__a", "__b"))).alias("word")).distinct()
    unchanged = words.join(lemmas, words["word"] == lemmas["form"], "left_anti").select("word", F.col("word").alias("form"))
    forms = unchanged.unionByName(lemmas.select(F.col("lemma").alias("word"), "form"))
    one = forms.select(F.col("word").alias("__a"), F.col("form").alias("__fa"))
    two = forms.select(F.col("word").alias("__b"), F.col("form").alias("__fb"))
    joined = split.join(one, "__a").join(two, "__b", "left").where("__b IS NULL OR __fb IS NOT NULL")
    return joined.withColumn("form", F.concat_ws(" ", "__fa", "__fb")).drop("__a", "__b", "__fa", "__fb")


def _matched(rows: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    table = rules.withColumnRenamed("kind", "__kind")
    table = F.broadcast(table) if few else table
    return rows.join(table, (F.col("feature") == F.col("form")) & (F.col("kind") == F.col("__kind")), "left")


def _labels(hits: Column) -> Column:
    tiers = F.array_distinct(
        F.transform(hits, lambda h: F.struct(h["ord"].alias("ord"), h["label"].alias("label"), h["tier"].alias("tier"), h["threshold"].alias("threshold")))
    )

    def reached(t: Column) -> Column:
        own = F.filter(hits, lambda h: (h["label"] == t["label"]) & (h["tier"] == t["tier"]))
        return F.aggregate(own, F.lit(0), lambda total, h: total + h["n"]) >= t["threshold"]

    held = F.array_distinct(
        F.transform(F.filter(tiers, reached), lambda t: F.struct(t["ord"].alias("ord"), t["label"].alias("label")))
    )
    return F.transform(F.array_sort(held), lambda t: t["label"])


def label_posts(posts: DataFrame, key: str, body: str, title: str, rules: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """(key, labels): labels of the body, then those that only the title gives; each text is judged by itself."""
    both = F.array(
        F.struct(F.lit("body").alias("part"), F.col(body).alias("text")),
        F.struct(F.lit("title").alias("part"), F.translate(F.col(title), "-_", "  ").alias("text")),
    )
    found = label(posts.select(key, F.inline(both)), [key, "part"], "text", rules, lemmas)
    pick = lambda part: F.first(F.when(F.col("part") == part, F.col("labels")), ignorenulls=True)
    return found.groupBy(key).agg(F.array_union(pick("body"), pick("title")).alias("labels"))


def or_unclassified(labels: Column) -> Column:
    return F.when(F.size(labels) == 0, F.array(F.lit(UNCLASSIFIED))).otherwise(labels)


def label_histogram(labelled: DataFrame) -> DataFrame:
    """Posts of each label, in order of label."""
    return labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_posts")).orderBy("label")


def label_count_histogram(labelled: DataFrame) -> DataFrame:
    """Posts by number of labels, those without under 0, in order of number."""
    return labelled.groupBy(F.size("labels").alias("n_labels")).agg(F.count(F.lit(1)).alias("n_posts")).orderBy("n_labels")


def locations(posts: DataFrame, key: str, text: str, raw_tag: str | None = None, lemmas: DataFrame | None = None, rules: dict | None = None) -> DataFrame:
    """(key, labels): sorted resolver locations of relevant posts in English; posts without any are left out."""
    from threadloom.operators.filters import about_dns, foreign_text

    tokens = raw_tokens(F.col(text))
    kept = posts.where(~foreign_text(tokens))
    if raw_tag:
        kept = kept.where(about_dns(tokens, F.col(raw_tag)))
    table = rule_table(posts.sparkSession, rules or location_rules())
    found = label(kept, [key], text, table, lemmas)
    return found.where(F.size("labels") > 0).select(key, F.array_sort("labels").alias("labels"))
