import random
import re
from collections import Counter

import pytest

from threadloom.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text, least=quality.MIN_REPEAT):
    ws = words(text)
    n = len(ws)

    def covered(k):
        grams = Counter(tuple(ws[i : i + k]) for i in range(n - k + 1))
        inside = set()
        for i in range(n - k + 1):
            if grams[tuple(ws[i : i + k])] > 1:
                inside.update(range(i, i + k))
        return len(inside)

    longest = next((k - 1 for k in range(1, n + 1) if max(Counter(tuple(ws[i : i + k]) for i in range(n - k + 1)).values()) < 2), 0)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": n,
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": covered(3),
        "covered_words": covered(least),
        "longest_repeat": longest if longest >= least else 0,
    }


def test_counts_match_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "a\x0bb\x1cc d", "a " * 400, "x y z " * 9]
    for _ in range(150):
        base = [rng.choice("ab" if rng.random() < 0.3 else "abcdefgé#") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and len(base) > 12:
            base += base[3:12] + [rng.choice("pq")] + base[:10]
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in base))
    for part in (texts, texts[::-1], texts[5:6]):
        found = quality.measure(part)
        for i, text in enumerate(part):
            assert {k: int(v[i]) for k, v in found.items()} == brute(text), repr(text)


def test_short_copies_between_long_ones():
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    texts = []
    for size, part in [(104, n) for n in range(60, 104, 3)] + [(40, n) for n in range(8, 40)] + [(127, 100), (101, 67)]:
        long = [word() for _ in range(size)]
        pieces = [long, long[:part], long]
        for order in ((0, 1, 2), (1, 0, 2), (0, 2, 1)):
            texts.append(" ".join(w for i in order for w in [word()] + pieces[i] + [word()]))
    found = quality.measure(texts)
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in found.items()} == brute(text), i


def test_verdicts():
    rng = random.Random(2)
    clean = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(200))
    long_repeat = clean + " " + " ".join(f"v{i}" for i in range(2000)) + " " + " ".join(clean.split()[:150])
    texts = [clean, clean[:80], "spam ham " * 100, long_repeat, None]
    base, kept = quality.judge(quality.measure(texts))
    assert base.tolist() == [False, True, True, False, True] and kept.tolist() == [True, False, False, False, False]


def test_very_long_texts():
    texts = ["ab " * 200_000, "x" * 1_000_000, " ".join(map(str, range(200_000)))]
    found = quality.measure(texts)
    assert found["covered_words"].tolist() == [200_000, 0, 0] and found["longest_repeat"].tolist() == [199_999, 0, 0]


def test_tables(spark, save):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, None, None, None, None)]
    found = quality.op1_suffix_repetition(spark, save("documents", rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in found) == [(0, 0, False), (1, 2, False), (1, 2, False)]
    assert quality.op1_suffix_repetition(spark, save("documents", [], DOCS)).count() == 0
    clash = spark.createDataFrame([("a b", "mine", 7)], "text string, kept string, n_words int")
    assert quality.keep(clash).columns == clash.columns and quality.score(clash).first()["n_words"] == 2


def test_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = quality.op1_suffix_repetition(spark, sf_dir)
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({quality.ORACLE})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
