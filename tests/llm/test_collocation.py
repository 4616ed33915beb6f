import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import collocation, hashindex

SCHEMA = "lang string, text string, n long, phrase string, key string"
UPPER = {chr(c): chr(c + 32) for c in range(65, 91)}


def plain(rows, least, top):
    """All counts by dictionaries, all pairs of phrases for containment."""
    f, n = defaultdict(Counter), Counter()
    for lang, text, *_ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(str.maketrans(UPPER))):
            words = re.findall("[^ \t]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, save, rows, least, top=50):
    docs = spark.read.parquet(save("documents", rows, SCHEMA) + "/documents.parquet")
    return sorted(map(tuple, collocation.mine(docs.select("lang", "text"), least, top).collect()))


def random_rows(seed, n=60):
    rng = random.Random(seed)
    words = [rng.choice(["a", "B", "é", "x\x00y", "ÀB", "’s", "ab"]) * rng.randrange(1, 3) for _ in range(14)]
    ends = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?", "\xa0"]
    langs = ["en"] * 5 + [None, "und", "", "fr"]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(120))) for _ in range(n)]
    texts += ["New York City hall, new york", "", " . ", None, "one " * 300] + texts[:5]
    return [(rng.choice(langs), t, 1, "p", "k") for t in texts]


@pytest.mark.parametrize("part,block", [(hashindex.PART, hashindex.BLOCK), (16, 32)])
def test_equals_the_plain_counts(spark, save, monkeypatch, part, block):
    """Small parts and blocks: words and phrases take several passes, and the result is the same."""
    monkeypatch.setattr(hashindex, "PART", part)
    monkeypatch.setattr(hashindex, "BLOCK", block)
    monkeypatch.setattr(collocation, "FAN", 2)
    rows = random_rows(0, 30 if part == 16 else 60)
    want = plain(rows, 4, 50)
    assert len(want) > 40 and mined(spark, save, rows, 4) == want


def test_edges(spark, save):
    assert mined(spark, save, [], 2) == []
    assert mined(spark, save, [("en", None, 0, "", ""), (None, "", 0, "", "")], 1) == []
    rows = [("en", "a b. a b. a c", 0, "", "")]
    assert mined(spark, save, rows, 2) == plain(rows, 2, 50) == [("en", 1, "a b", 2, 3, 2, 6, 800000)]


def test_products_beyond_64_bits():
    a = 10**14
    assert collocation.best_cut(a, [3 * a, 2 * a], [a, 2 * a + 1]) == (2000000 * a // (4 * a + 1), 2 * a, 2 * a + 1)
    assert collocation.best_cut(a, [a, a], [a + 1, a]) == (999999, a, a + 1)
    assert collocation.best_cut(10, [10**9, 10**9], [1, 2]) == (0, 10**9, 1)  # ties after flooring: the first cut


def test_scores_beyond_64_bits(spark):
    row = {"high": 1, "low": 0, "a": 10**13} | dict.fromkeys(collocation._CUTS, 0) | {"l1": 3 * 10**13, "r1": 2 * 10**13}
    schema = ", ".join(f"{c} long" for c in row)
    found = collocation.scored(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert (found["score"], found["l"], found["r"]) == (400000, 3 * 10**13, 2 * 10**13)


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    rng = np.random.default_rng(0)
    high, low = rng.integers(0, 2**63, (2, 20000)).astype(np.uint64)
    one, two = hashindex.pair_hashes(high, low)
    held = hashindex.PerfectHash(one, two)
    slots = held.slots(one, two)
    assert sorted(slots.tolist()) == list(range(20000)) and held.size == 20000
    order = np.argsort(slots)
    block = hashindex.Block(0, {0: (0, held, (high[order], low[order]))})
    assert (collocation._find(block, high, low) == slots).all()
    assert (collocation._find(block, high + np.uint64(1), low) == -1).all()
    assert hashindex.PerfectHash(one[:0], two[:0]).size == 0


def test_words_and_pieces():
    words, text, new = collocation.split(pa.array(["Ab, c\td", None, "", "É.e\n", "x"]))
    assert words.to_pylist() == [b"ab", b"c", b"d", "É".encode(), b"e", b"x"]
    assert text.tolist() == [0, 0, 0, 3, 3, 4] and new.tolist() == [True, True, False, True, True, True]
