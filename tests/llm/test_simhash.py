import random
import re

import numpy as np
import xxhash

from threadloom.llm import simhash
from threadloom.llm.components import components, spanning

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text, k=4):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(codes, limit):
    n = len(codes)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= limit
    label = np.arange(n)
    while True:
        new = np.array([label[near[i]].min() for i in range(n)])
        if (new == label).all():
            return label
        label = new


def families(rng, n, most=7):
    codes = []
    for base in rng.integers(0, 2**63, n, dtype=np.uint64):
        for _ in range(rng.integers(1, 80)):
            code = base
            for k in rng.integers(0, 64, rng.integers(0, most)):
                code = code ^ (np.uint64(1) << np.uint64(k))
            codes.append(code)
    return np.unique(np.array(codes, np.uint64))


def test_index_links_exactly_what_brute_force_links():
    rng = np.random.default_rng(0)
    for trial in range(5):
        codes = families(rng, 25)
        order = np.argsort(simhash.gray_rank(codes))
        sets = simhash.GrayIndex(codes[order], np.array([0])).link(4)
        assert np.array_equal(sets.root, groups(codes[order], 4))


def test_groups_of_an_index_stay_apart():
    codes = np.array([0, 1, 3, 0, 1, 1 << 60], np.uint64)
    assert simhash.GrayIndex(codes, np.array([0, 3])).link(4).root.tolist() == [0, 0, 0, 3, 3, 3]


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(64)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(64))


def test_masks_cover_every_difference():
    rng = random.Random(1)
    for blocks in (5, 6, 7):
        masks = simhash.block_masks(blocks)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_links_over_all_groups(spark):
    codes = families(np.random.default_rng(3), 30)
    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long").selectExpr("fp AS node", "fp")
    found = components(simhash.links(table, simhash.block_masks(5), 4, block=64))
    root = {r["node"]: r["root"] for r in found.collect()}
    label = groups(codes, 4)
    signed = codes.view(np.int64)
    for k in set(label):
        own = {root.get(int(c), int(c)) for c in signed[label == k]}
        assert len(own) == 1
    assert len({root.get(int(c), int(c)) for c in signed}) == len(set(label))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)]
    links = [(a, b) for a, b in links if a != b]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    a, b = spanning(np.array([x for x, _ in links]), np.array([y for _, y in links]))
    want = dict(zip(a.tolist(), b.tolist()))
    assert set(found) == {x for l in links for x in l} and all(found[n] == want.get(n, n) for n in found)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, save):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(120):
        base = [word() for _ in range(rng.randint(0, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                if copy:
                    copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy).upper())
    texts += [None, "", "\t\n", "one two", "ONE  two", "a b c d"]
    rows = [(i * 3 + 1, t, None, None, None) for i, t in enumerate(texts)] + [(None, "one two", None, None, None), (1, texts[0], None, None, None)]
    found = simhash.op8_gray_index(spark, save("documents", rows, DOCS)).collect()
    assert len(found) == len(rows)
    plain = np.array([plain_fingerprint(r[1]) for r in rows], np.uint64)
    ids = [r[0] if r[0] is not None else 10**9 for r in rows]
    label = groups(plain, 4)
    least = {k: min(i for i, l in zip(ids, label) if l == k) for k in set(label)}
    want = sorted((i if i != 10**9 else -1, f"{int(f):016x}", least[k]) for i, f, k in zip(ids, plain, label))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == want
    assert simhash.op8_gray_index(spark, save("documents", [], DOCS)).count() == 0


def test_deduplicate_keeps_one_of_similar_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, family = [], {}
    for f in range(80):
        base = [word() for _ in range(200)]
        for c in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(200)] = word()
            family[len(rows)] = f
            rows.append((len(rows), " ".join(copy), "x", "y", 1))
    rows += [(None, rows[0][1], None, None, None), (0, rows[0][1], "x", "y", 1), (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    first = {f: min(i for i, g in family.items() if g == f) for f in family.values()}
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == sorted(first.values())
    assert sum(r["doc_id"] is None for r in found) == 1
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def near_texts(rng, changes, hub):
    """Isolated pairs of texts of 316 shingles that differ in some words, and one hub of copies of a text."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(320)]
        copy = list(base)
        for at in rng.sample(range(5, 315, 6), changes):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    base = [word() for _ in range(320)]
    for _ in range(hub):
        copy = list(base)
        for at in rng.sample(range(320), rng.choice([1, 3, 5, 9])):
            copy[at] = word()
        texts.append(" ".join(copy))
    return texts


def exact_left(texts):
    """First of each component of texts that share 4/5 of their shingles."""
    sets = []
    for text in texts:
        ws = text.lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if label[i] != label[j] and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return sorted(set(label))


def test_deduplicate_finds_every_pair_of_shared_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTS", 100)
    rng = random.Random(21)
    texts = near_texts(rng, 7, 120)  # similarity 281 / 351
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)]
    want = exact_left(texts)
    assert sum(i < 120 for i in want) == 60
    assert sorted(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect()) == want


def test_deduplicate_merges_no_less_similar_texts(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = near_texts(rng, 9, 0)  # similarity 271 / 361
    passage = " ".join(word() for _ in range(12))
    for _ in range(20):  # one passage repeated in each, and words of their own
        texts.append(" ".join([passage] * 20 + [word() for _ in range(40)]))
    assert exact_left(texts) == list(range(len(texts)))
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect()) == list(range(len(texts)))


def test_deduplicate_with_shared_ids(spark):
    """Unlike texts with one id are kept apart, and which row of a group stays is fixed."""
    rng = random.Random(23)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    one, two, three = text(), text(), text()
    rows = [(1, one, "x", "y", 1), (1, two, "x", "y", 1), (2, three, "x", "y", 1), (2, one, "x", "y", 1), (2, three, "x", "y", 1)]
    for _ in range(2):
        found = simhash.deduplicate(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in found) == sorted([(1, one), (1, two), (2, three)])
        rows.reverse()


def test_majority_by_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    counts = np.array([0, 3, 0, 40, 1, 7, 0, 16, 100, 0])
    hashes = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    whole = simhash.majority(hashes, counts)
    for size in (1, 7, 16, 64):
        monkeypatch.setattr(simhash, "HASHES", size)
        assert np.array_equal(simhash.majority(hashes, counts), whole)
    own = hashes[3:43]
    assert int(whole[3]) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > 40)


def test_few_sets_of_a_shingle_leave_as_one_group(spark):
    """24 like sets that share 300 shingles are told once, not by pairs; a set of another size is not with them."""
    sets_ = [(100 + i, 400, 7, 7, 7, 7) for i in range(24)] + [(5, 900, 7, 7, 7, 7), (6, 900, 7, 7, 7, 7), (1, 9, 0, 0, 0, 0)]
    rows = [(s, *held) for s in range(300) for held in sets_] + [(900, *sets_[0]), (900, *sets_[3]), (901, *sets_[1]), (902, *sets_[0]), (902, *sets_[-1])]
    table = spark.createDataFrame(rows, "shingle long, node long, n long, o0 long, o1 long, o2 long, o3 long").repartition(5)
    found = sorted(tuple(r["members"]) for r in simhash.few_groups(table).collect())
    assert found == [(5, 6), tuple(range(100, 124)), (100, 103)]
    assert simhash.few_groups(table.limit(0)).count() == 0


def test_deduplicate_follows_chains_in_small_groups(spark, monkeypatch):
    """Chains of up to 30 texts, each like the next and unlike the first; what the first link doesn't tell is found by its group."""
    monkeypatch.setattr(simhash, "COUNTS", 100)
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for length in (3, 9, 16, 30):
        words, places = [word() for _ in range(320)], [7 * i + 3 for i in range(45)]
        rng.shuffle(places)
        for step in range(length):
            for at in places[step * 7 % 45 :][:7] if step else []:
                words[at] = word()
            texts.append(" ".join(words))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)]
    want = exact_left(texts)
    assert len(want) < len(texts) // 4
    assert sorted(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect()) == want
