import base64
import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from threadloom.llm import bpe  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(plain):
    rng = random.Random(3)
    letters = " \n\t 'strevlmdSTaAé漢١²½9.!?😀_\x1c\x85-́　"
    texts = ["", None, "'", "'s", "x'", "'re'll'd've", " 's", "\n\n x", "a" * 3000 + " " * 300 + "!" * 999, "ab" * 400]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text, ids in zip(texts, bpe.encode_batch(texts, PATH)):
        assert ids == plain.encode_ordinary(text or ""), repr(text)
        assert bpe.encoder(PATH).decode(ids) == (text or "").encode()


def test_scan_equals_a_plain_walk():
    import numpy as np

    kinds = np.random.default_rng(0).integers(0, 9, 5000).astype(np.uint8)
    state, want = 0, []
    for k in kinds:
        want.append(state)
        state = bpe.AFTER[k, state]
    assert bpe.scan_states(kinds).tolist() == want


def test_query(spark, save, plain):
    texts = ["Hello world's  end", None, "", "  ", "é" * 50_000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None), (None, "x", None, None, None)]
    found = {r["doc_id"]: r for r in bpe.op4_byte_bpe(spark, save("documents", rows, DOCS)).collect()}
    for i, text in enumerate(texts):
        ids = plain.encode_ordinary(text or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.op4_byte_bpe(spark, save("documents", [], DOCS)).count() == 0
    clash = spark.createDataFrame([("a b", 1)], "text string, tokens int")
    assert bpe.encode(clash, PATH).first()["tokens"] == plain.encode_ordinary("a b")
