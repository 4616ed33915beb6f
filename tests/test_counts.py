"""Counts of tokens and of pairs of them."""

from collections import Counter

from threadloom.operators import stats

TEXTS = [(1, "a b a  B"), (2, ""), (3, None), (4, "x"), (5, "a b"), (5, "b a b"), (None, "n n"), (None, "n")]


def expected(n):
    out = Counter()
    for key, text in TEXTS:
        tokens = text.lower().split(" ") if text is not None else []
        out.update((key, " ".join(tokens[i : i + n])) for i in range(len(tokens) - n + 1))
    return dict(out)


def test_counts_of_repeated_and_missing_keys(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for count, name, n in ((stats.token_counts, "token", 1), (stats.bigram_counts, "bigram", 2)):
        rows = count(texts, "doc_id", "text").select("doc_id", name, "n").collect()
        assert len(rows) == len(expected(n)) and {(k, t): c for k, t, c in rows} == expected(n)


def test_parts_are_not_shuffled(spark):
    texts = spark.createDataFrame([r for r in TEXTS if r[0] in (1, 2, 3, 4)], "doc_id long, text string")
    for count in (stats.token_counts, stats.bigram_counts):
        assert "Exchange" not in count(texts, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
