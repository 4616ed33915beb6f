import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from threadloom.llm import packing  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def unpack(counts, size):
    runs, bins = packing.plan(counts, size), defaultdict(list)
    for length, n in counts.items():
        firsts = [r[0] for r in runs[length]]
        assert firsts == sorted(firsts)
        for rank in range(n):
            first, sequence, each, offset = runs[length][bisect.bisect_right(firsts, rank) - 1]
            k = rank - first
            bins[sequence + k // each].append((offset + k % each * length, length))
    return bins


def best_fit(counts, size):
    """Best fit, longest first, one piece at a time."""
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(free, length)
            space = free.pop(at) if at < len(free) else size
            bisect.insort(free, space - length)
    return len(free)


def test_plans_equal_best_fit_piece_by_piece():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.choice([8, 17, 64])
        counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 14))}
        bins = unpack(counts, size)
        for slots in bins.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= size
        assert len(bins) == best_fit(counts, size)


def test_ids_equal_the_librarys():
    plain = tokenizers.Tokenizer.from_file(packing.vocabulary_path())
    own = packing.WordTokenizer(packing.vocabulary_path())
    rng = random.Random(2)
    letters = ["abcXYZ019.,!<|>\"#ÀéßüÿñÖ÷×-_() \n", " \n\t\r'strevlmdSTaAé漢١²½9.!?😀_\x1c\x85-́　\x0b\xa0ΣİǅK"]
    texts = ["".join(rng.choice(letters[i % 2]) for _ in range(rng.randint(0, 40))) for i in range(8000)]
    texts += ["<|endoftext|> x", "a<|startoftext|>b", None, "", "don't we'll  end"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_query(spark, save):
    plain = tokenizers.Tokenizer.from_file(packing.vocabulary_path())
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma.", "x1"]) for _ in range(rng.choice([1, 5, 60, 900, 5000]))) for _ in range(80)]
    texts += [None, "", "same text"] + ["same text"] * 200
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "x", None, None, None), (3, texts[3], None, None, None)]
    found = packing.op9_best_fit(spark, save("documents", rows, DOCS)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted([tuple(r)[:5] for r in found], key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == best_fit(Counter(r["length"] for r in found), 2048)
    assert packing.op9_best_fit(spark, save("documents", [], DOCS)).count() == 0


def test_pieces_carry_ids(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, ids string")
    row = packing.pieces(docs, packing.vocabulary_path(), size=2).orderBy("piece").collect()
    assert [len(r["ids"]) for r in row] == [2, 2] and row[-1]["ids"][-1] == 0


def test_columns_with_the_names_of_the_result(spark):
    rows = [(i, 0, 100 + i % 3, "x", "y", "z") for i in range(50)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string, offset string, shard string")
    found = packing.pack(parts)
    assert found.columns == ["doc_id", "piece", "length", "shard", "sequence_id", "offset"]
    ends = {}
    for r in sorted(found.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["shard"] == "z"
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) == 3
