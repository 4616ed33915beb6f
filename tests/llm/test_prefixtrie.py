import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from threadloom.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, key string, node string"


def plain_trie(rows):
    """The nodes of the trie, prefix by prefix."""
    held = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            held[conv].append((turn is not None, turn or 0, tie, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in held.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        paths[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    found = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        leaves = 0 if children[path] else 1
        for child in children[path]:
            leaves += found[child][4]
            saved += found[child][5]
        ends = ",".join(str(c) for c in sorted(members[path]) if len(paths[c]) == len(path))
        found[path] = (
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), leaves, saved,
            len(children[path]), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted((r[:4] + (r[6],) + r[4:6] + r[7:] for r in found.values()), key=repr)


def trie(spark, rows, save):
    folder = save("conversations", rows, SCHEMA)
    return sorted(map(tuple, prefixtrie.op13_prefix_trie(spark, folder).collect()), key=repr)


def random_rows(seed, convs, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 60), convs):
        for t in range(rng.randrange(1, 14)):
            turn = None if rng.random() < 0.1 else rng.randrange(12)
            role = rng.choice([None, "", "user", "1:a"])
            rows.append((c, turn, role, rng.choice([None, "", "é", "x", "ab"][: words + 1]), "k", "n"))
    return rows + rng.sample(rows, len(rows) // 4)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, save, seed):
    rows = random_rows(seed, 50)
    assert trie(spark, rows, save) == plain_trie(rows)


def test_hot_first_turn_long_conversations_and_copies(spark, save, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)
    rows = [(c, 0, "user", "hello", "", "") for c in range(0, 200, 5)] + [(c, t, "user", f"{t % 3}", "", "") for c in (1000, 1005) for t in range(70)]
    rows += [(c, 1, "bot", "x" * (c % 2), "", "") for c in range(0, 100, 5)] + [(2000, t, None, f"turn {t}", "", "") for t in range(33)]
    rows += [(c, 9, "user", "own", "", "") for c in range(201, 240)]  # bases that have no rows
    assert trie(spark, rows, save) == plain_trie(rows)


def test_edges(spark, save):
    assert trie(spark, [], save) == []
    lone = [(None, 0, "a", "b", "", ""), (2**63 - 1, 0, "a", "b", "", ""), (-(2**63), 0, None, None, "", "")]
    found = trie(spark, lone, save)
    assert [r[:5] for r in found if r[1] == 0] == [(-(2**63), 0, None, 2, len({r for r in found if r[1] == 1}))]
    # conversation 1 takes its first turns from an absent base and has none of its own left
    h = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    empty = hashlib.sha256(str(h).encode()).hexdigest()
    assert trie(spark, [(h, 0, "a", "b", "", "")], save) == [(h, 0, None, 1, 0, 1, 0, empty)]
