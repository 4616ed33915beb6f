import bisect
import math
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from threadloom.llm import sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def check(found, texts, slack):
    """Every row once; slots gapless; sizes near equal."""
    shards = defaultdict(list)
    for r in found:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes"
        shards[r["shard"]].append(r)
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    total = sum(r["size"] for r in found)
    largest = max(r["size"] for r in found)
    for k in range(8):
        assert abs(sum(r["size"] for r in shards[k]) - total / 8) <= slack * total / 8 + largest
    return shards


def test_hot_group_and_long_texts(spark, save):
    texts = {i: f"text number {i} " * (1 + i % 7) for i in range(3000)}
    texts |= {i: "the same text again" * 5 for i in range(3000, 4500)} | {4500: None, 4501: "", 4502: "x" * 4000}
    rows = [(i, t, "en", "src0", 1) for i, t in texts.items()]
    found = sharding.op2_sampled_splitters(spark, save("documents", rows, DOCS)).collect()
    check(found, texts, 0.03)


def test_equal_texts_stay_together(spark, save):
    texts = {i: f"some text {i // 3} " * 20 for i in range(3000)}
    found = sharding.op2_sampled_splitters(spark, save("documents", [(i, t, None, None, None) for i, t in texts.items()], DOCS)).collect()
    check(found, texts, 0.03)
    of = defaultdict(set)
    for r in found:
        of[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in of.values()) <= 10  # only groups in subdivided ranges


def test_small_and_odd_tables(spark, save):
    assert sharding.op2_sampled_splitters(spark, save("documents", [], DOCS)).count() == 0
    rows = [(None, None, None, None, None), (None, "a", None, None, None), (1, "a", None, None, None), (1, "a", None, None, None)]
    found = sharding.op2_sampled_splitters(spark, save("documents", rows, DOCS)).collect()
    assert len(found) == 4
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_general_interface_keeps_columns(spark):
    rows = spark.range(500).select("id", F.lit("x").alias("other"), (F.col("id") % 5).alias("g"))
    found = sharding.shard(rows, F.col("g"), F.col("id"), F.lit(1), shards=4)
    assert found.columns == ["id", "other", "g", "shard", "slot"] and found.count() == 500
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 20


def test_splitters_follow_weights(spark):
    rows = spark.range(10_000).select(
        F.col("id").alias("__shard_key"), F.when(F.col("id") < 1000, 90).otherwise(10).alias("__shard_size"),
        sharding._hash52(F.col("id")).alias("__shard_tie"),
    )
    bounds = sharding.splitters(rows, 180_000, 10, 200)
    weight = lambda k: 90 * min(k, 1000) + 10 * max(0, k - 1000)
    assert all(abs(weight(b) / 180_000 - i / 10) < 0.03 for i, b in enumerate(bounds, 1))


def test_repeated_rows_keep_the_law(spark, save):
    """Half of the rows alike in all columns, id included."""
    rows = [(None, "the same text again", None, None, None)] * 2000 + [(i, f"text number {i} " * 3, None, None, None) for i in range(2000)]
    found = sharding.op2_sampled_splitters(spark, save("documents", rows, DOCS)).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 8
    assert len(found) == 4000 and all(abs(sizes[k] - mean) <= 0.03 * mean for k in range(8)), sizes
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_columns_with_the_names_of_the_result(spark):
    rows = spark.range(400).selectExpr("id", "id % 7 AS shard", "'x' AS slot", "'law' AS law")
    found = sharding.shard(rows, F.col("shard"), F.col("id"), F.lit(1), shards=4)
    assert found.columns == ["id", "law", "shard", "slot"] and found.count() == 400
    assert {r["shard"] for r in found.collect()} == {0, 1, 2, 3}


def plain_shards(rows, shards, ranges, per_range):
    """(shard, slot) of every (key, tie, size): the method as loops over all rows."""
    span, total = sharding.KEY_SPAN, sum(size for _, _, size in rows)
    share = max(1, total // ranges)
    sample = sorted(key for key, tie, size in rows for _ in range(math.floor(size * (ranges * per_range / total) + tie / span)))
    found = []
    for i in range(1, ranges):
        at = (len(sample) - 1) * (i / ranges)
        lo, hi = math.floor(at), math.ceil(at)
        found.append(int((hi - at) * sample[lo] + (at - lo) * sample[hi] if hi > lo else sample[lo]))
    bounds = sorted(set(found) | {b + 1 for a, b in zip(found, found[1:]) if a == b})
    of = [bisect.bisect_right(bounds, key) for key, _, _ in rows]
    weight = defaultdict(int)
    for r, (_, _, size) in zip(of, rows):
        weight[r] += size
    parts = {r: math.ceil(w / share) if w > 1.5 * share else 1 for r, w in weight.items()}
    pieces = defaultdict(list)
    for n, (r, (_, tie, _)) in enumerate(zip(of, rows)):
        pieces[r, math.floor(tie * parts[r] / span)].append(n)
    out, before, slots = {}, 0, defaultdict(int)
    for piece in sorted(pieces):
        mass = sum(rows[n][2] for n in pieces[piece])
        shard = min(shards - 1, math.floor((before + mass / 2) * shards / total))
        before += mass
        for n in sorted(pieces[piece], key=lambda n: rows[n]):
            out[n] = (shard, slots[shard])
            slots[shard] += 1
    return out


def test_against_plain_loops(spark, monkeypatch):
    stored, cut = [], sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df, name: stored.append(cut(df, name)) or stored[-1])
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id * 31 % 501 END AS g", "1 + id * id % 97 AS size")
    rows = rows.union(spark.createDataFrame([(9_999, 3, 5_000)] * 3, "id long, g long, size long"))
    found = sharding.shard(rows, F.col("g"), F.col("id"), F.col("size"), shards=5, ranges_per_shard=8, samples_per_range=16)
    found = sorted(tuple(r) for r in found.select("id", "shard", "slot").collect())
    keyed = stored[0].select("id", "__shard_key", "__shard_tie", "__shard_size").collect()
    want = plain_shards([tuple(r)[1:] for r in keyed], 5, 40, 16)
    assert found == sorted((r["id"], *want[n]) for n, r in enumerate(keyed))
