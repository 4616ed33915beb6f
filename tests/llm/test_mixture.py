import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import mixture, ranges

SCHEMA = "doc_id long, source string, text string, queue string, n string, part string"
TEXTS = [
    "a", "b", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "'s", "'", "don't", "'re", "<|endoftext|>", "<|", "1", "23", "!", "..", ",", " ", " ",
    "’", "x" * 300, "\x1c", "\x85", "漢", "🙂", "\x00", "Straße", "naïve.Word", "e.g", "a,'b",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(mixture.vocabulary_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [mixture.END_ID]


@pytest.mark.parametrize("cached", [mixture.CACHED, 20])
def test_tokens_equal_the_library(library, monkeypatch, cached):
    monkeypatch.setattr(mixture, "CACHED", cached)
    rng = random.Random(1)
    texts = ["".join(rng.choices(TEXTS, k=rng.randrange(25))) for _ in range(1500)] + [None, "", " ", "\n", " \n"]
    coder = mixture.UnitTokenizer(mixture.vocabulary_path())
    for at in range(0, len(texts), 300):
        found = coder.encode(pa.array(texts[at : at + 300]))
        assert [x.tolist() for x in found] == [ids(library, t)[:-1] for t in texts[at : at + 300]]


def check(spark, save, library, rows, mix=None):
    """Holds the pieces to their documents and the sequences to their law; returns tokens by (sequence, source)."""
    folder = save("documents", rows, SCHEMA)
    found = mixture.op11_mixture_packing(spark, folder, mixture=mix).collect()
    wanted = defaultdict(list)
    for doc, source, text, *_ in rows:
        wanted[doc].append((source or "", ids(library, text)))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == wanted.keys()
    spread = defaultdict(lambda: defaultdict(int))
    for doc, parts in pieces.items():
        for source, want in wanted[doc]:
            at = 0
            while at < len(want):  # equal rows are told apart by nothing but their pieces
                part = next(p for p in parts if p["start"] == at and p["doc_tokens"] == len(want))
                assert zlib.crc32(np.array(want[at : at + part["length"]], "<u4").tobytes()) == part["ids_crc32"]
                parts.remove(part)
                spread[part["sequence_id"]][source] += part["length"]
                at += part["length"]
        assert not parts
    lengths = []
    for number in sorted(sequences):
        end = 0
        for offset, length in sorted(sequences[number]):
            assert offset == end and length > 0
            end += length
        assert end <= mixture.SIZE
        lengths.append(end)
    full = sum(n == mixture.SIZE for n in lengths)
    total = sum(len(w) for ws in wanted.values() for _, w in ws)
    assert full == total // mixture.SIZE and all(n & (n - 1) == 0 for n in lengths[full:])
    assert len(set(lengths[full:])) == len(lengths) - full
    return [spread[k] for k in sorted(spread)][:full]


def random_rows(seed, n, words=400, sources=("a", "b", "c", None, "")):
    rng = random.Random(seed)
    some = ["".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(200)]
    rows = [(i, rng.choice(sources), " ".join(rng.choices(some, k=rng.randrange(words))), "q", "n", "p") for i in range(n)]
    return rows


def test_windows_keep_the_proportions(spark, save, library):
    rows = random_rows(0, 250, sources=["hot"] * 6 + ["a", "b", "c"]) + [(1000, "b", "long " * 30000, "", "", ""), (1001, None, None, "", "", ""), (1001, "", "", "", "", "")]
    windows = check(spark, save, library, rows)
    share = defaultdict(float)
    for doc, source, text, *_ in rows:
        share[source or ""] += len(ids(library, text))
    total = sum(share.values())
    due, had = defaultdict(float), defaultdict(float)
    for w in windows:
        for s in share:
            due[s] += mixture.SIZE * share[s] / total
            had[s] += w[s]
            assert abs(w[s] - mixture.SIZE * share[s] / total) <= 2 * mixture.GRAIN  # in each window
            assert abs(had[s] - due[s]) <= 2 * mixture.GRAIN  # what is owed is carried, not lost


def test_given_proportions_hold_until_a_source_is_dry(spark, save, library):
    rows = random_rows(1, 200, sources=["a", "b"])
    windows = check(spark, save, library, rows, {"a": 0.75, "b": 0.25})
    first = windows[: len(windows) // 2]
    assert all(abs(w["a"] - 0.75 * mixture.SIZE) <= mixture.GRAIN for w in first)
    assert windows[-1]["a"] == 0  # dry, and the rest is still packed


def test_many_small_sources_and_large_tables_of_places(spark, save, library, monkeypatch):
    monkeypatch.setattr(mixture, "QUEUES", 4)
    monkeypatch.setattr(mixture, "SENT", 3)
    rows = [(i, f"s{i % 40}" if i % 3 else "hot", text, *rest) for i, _, text, *rest in random_rows(2, 200)]
    check(spark, save, library, rows + rows[:10])


def test_edges(spark, save, library):
    assert mixture.op11_mixture_packing(spark, save("documents", [], SCHEMA)).collect() == []
    check(spark, save, library, [(None, None, None, "", "", ""), (None, "x", "one", "", "", "")])
    check(spark, save, library, [(7, "x", "same", "", "", "")] * 5)


def test_slots_are_those_of_the_plain_round_robin():
    rng = random.Random(3)
    for _ in range(30):
        totals = [rng.randrange(0, 3000) for _ in range(rng.randrange(1, 7))]
        layout = mixture.Plan(totals, [rng.choice([0, 1, 2, t]) for t in totals])
        left, served, order = layout.chunks.tolist(), [0] * len(totals), []
        while sum(left) > sum(served):
            open_ = [q for q in range(len(totals)) if served[q] < left[q]]
            q = min(open_, key=lambda q: ((2 * served[q] + 1) / int(layout.weights[q]), q))
            order.append((q, served[q]))
            served[q] += 1
        if order:
            queue, chunk = (np.array(x) for x in zip(*order))
            assert layout.slots(queue, chunk).tolist() == list(range(len(order)))


def test_running_sums(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS v").repartition(5)
    found = {r["id"]: r["s"] for r in ranges.running(rows, "v", "s", ["id"]).collect()}
    total = 0
    for i in range(1000):
        assert found[i] == total
        total += i % 7
