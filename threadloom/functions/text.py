"""Column functions on text: all built-ins, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.schemas import LEMMAS


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def raw_tokens(text: Column) -> Column:
    """Parts between single spaces, empty ones kept, stripped and lower-cased."""
    return F.transform(F.split(text, " "), lambda t: F.lower(strip(t)))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def is_plain_word(token: Column) -> Column:
    """Only the letters a to z; the empty string passes, a trailing line feed doesn't."""
    return token.rlike(r"^[a-z]*\z")


def year_of(date: Column) -> Column:
    """The year in ``Month d, yyyy, ...``; null when the second part is missing."""
    return F.substring(F.get(F.split(date, ","), F.lit(1)), 2, 4)


# Lemmas

#: Endings that are detached, by part of speech, and what takes their place (fixed values).
DETACH = {
    "noun": [("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "adjective": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "verb": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
}
#: Words that are never changed.
SAFE = ("ns",)


def lemma_table(spark: SparkSession, words: Iterable[tuple[str, str]], exceptions: Iterable[tuple[str, str]] = (), safe: Iterable[str] = SAFE) -> DataFrame:
    """(form, lemma) for all inflected forms of ``words`` (word, part of speech).

    Forms are made by putting the detached endings back, so the table holds a
    dozen rows for each word and is small enough to be sent to every task.  A
    form of several words takes its noun reading first, then adjective, then
    verb; ``exceptions`` win over all.  A word of the list is its own lemma only
    as a noun, since the first reading that changes a word is the one taken.
    """
    found: dict[str, str] = dict(exceptions)
    nouns = {w for w, part in words if part == "noun"}
    for part in DETACH:
        for word, kind in sorted(words):
            if kind != part:
                continue
            for ending, base in DETACH[part]:
                if word.endswith(base) and (form := word[: len(word) - len(base)] + ending) != word:
                    if not (part != "noun" and form in nouns):
                        found.setdefault(form, word)
    rows = sorted((f, w) for f, w in found.items() if f not in set(safe))
    return spark.createDataFrame(rows, LEMMAS)


#: Rows of a word list up to which it is sent to every task; a longer one is joined by exchange.
SENT = 1 << 18


def sent(words: DataFrame, most: int = SENT) -> DataFrame:
    """``words`` marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(words) if words.limit(most + 1).count() <= most else words


def lemmatize(rows: DataFrame, token: str, lemmas: DataFrame) -> DataFrame:
    """``rows`` with ``token`` replaced by its lemma; the lemma table is broadcast where its size allows it."""
    table = sent(lemmas.select(F.col("form").alias("__form"), F.col("lemma").alias("__lemma")))
    joined = rows.join(table, F.col(token) == F.col("__form"), "left")
    return joined.withColumn(token, F.coalesce("__lemma", token)).drop("__form", "__lemma")


def _suffixes() -> dict[str, list[tuple[int, int, str, str]]]:
    """The nodes of the trie of reversed endings that hold rules: ending -> (part of speech, rule, ending, base)."""
    nodes: dict[str, list[tuple[int, int, str, str]]] = {}
    for part, rules in enumerate(DETACH.values()):
        for number, (ending, base) in enumerate(rules):
            nodes.setdefault(ending, []).append((part, number, ending, base))
    return nodes


def corpus_lemmas(tokens: DataFrame, exceptions: DataFrame | None = None, safe: Iterable[str] = SAFE) -> DataFrame:
    """(form, lemma) of every distinct ``token`` that has another lemma, by what the corpus itself holds.

    A token walks the trie of reversed endings, one node for each of its own last letters,
    and takes the rules of the nodes it meets; a base counts where the corpus has it as a token.
    The first part of speech with a base decides (noun, adjective, verb), in it the shortest
    base, ties in order of the rules.  ``exceptions`` (form, lemma) come first.  The table grows with the
    vocabulary: it is joined, and ``lemmatize`` broadcasts it only behind a check of its size.
    """
    words = tokens.where(is_plain_word(F.col("token")) & (F.col("token") != "")).select("token").distinct()
    nodes = _suffixes()
    rule = lambda r: F.struct(F.lit(r[0]).alias("part"), F.lit(r[1]).alias("rule"), F.lit(len(r[2])).alias("cut"), F.lit(r[3]).alias("base"))
    trie = F.create_map(*[x for ending, rules in nodes.items() for x in (F.lit(ending), F.array(*[rule(r) for r in rules]))])
    longest = max(map(len, nodes))
    walk = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.try_element_at(trie, F.right("token", k)))
    met = F.flatten(F.filter(walk, lambda x: x.isNotNull()))
    base = lambda r: F.concat(F.substring("token", F.lit(1), F.char_length("token") - r["cut"]), r["base"])
    found = words.select("token", F.explode(F.filter(met, lambda r: F.char_length("token") > r["cut"])).alias("r"))
    found = found.select(F.col("token").alias("form"), base(F.col("r")).alias("lemma"), "r.part", "r.rule").where("lemma <> form")
    held = found.join(words.select(F.col("token").alias("lemma")), "lemma", "left_semi")
    chosen = held.groupBy("form").agg(F.min(F.struct("part", F.char_length("lemma").alias("n"), "rule", "lemma")).alias("m")).select("form", F.col("m.lemma").alias("lemma"))
    if exceptions is not None:
        chosen = exceptions.select("form", "lemma").unionByName(chosen.join(exceptions.select("form"), "form", "left_anti"))
    return chosen.where(~F.col("form").isin(*safe))
