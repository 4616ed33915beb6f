"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by a key, the hash of the group column (equal texts share
it).  A size-weighted sample of keys gives quantile boundaries; each record
falls in one key range.  A key that fills a range alone gets a range of its
own, and a range above its share of bytes is subdivided by the hash of the row
id and of the row's number in a stored table, so that rows which are alike in all
columns are dealt apart as well.  The ranges, in key order, are dealt to shards by
cumulative bytes, so the law held is ``bytes``: shard sizes are near equal (within
about one range, or one row where that is larger).

Equal texts stay together unless their range had to be subdivided.

Defined results: null text has size 1 and crc 0; a null id hashes like any
value; repeated rows are rows of their own, and which of them takes which slot is
left to their order in storage; a text of any length is one row of its size; an
empty table gives an empty result; other columns pass through, columns named
``shard`` or ``slot`` are replaced, and helper columns carry a prefix (``__shard_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import cut, table, unsigned_crc32

#: Keys are 52-bit hashes, so that they are exact as doubles.
KEY_BITS = 52
KEY_SPAN = 1 << KEY_BITS


def _hash52(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at most ``key``: a binary search as one expression."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.coalesce(F.get(held, at + step - 1), F.lit(KEY_SPAN)) <= key), at + step
        ).otherwise(at),
    )


def splitters(keyed: DataFrame, total: int, ranges: int, samples_per_range: int) -> list[int]:
    """Boundaries at weighted quantiles of a systematic, size-weighted sample.

    A row is drawn ``floor(size * m / total + u)`` times, ``u`` being a hash of
    its id and number, for m = ranges * samples_per_range; the driver receives ``ranges``
    numbers.  A key that spans several quantiles is bounded on both sides.
    """
    drawn = ranges * samples_per_range
    times = F.floor(
        F.col("__shard_size") * F.lit(drawn / total) + F.col("__shard_tie") / F.lit(float(KEY_SPAN))
    ).cast("long")
    sample = keyed.select("__shard_key", times.alias("__shard_times")).where("__shard_times > 0")
    points = [i / ranges for i in range(1, ranges)]
    row = sample.agg(F.percentile("__shard_key", F.array(*map(F.lit, points)), F.col("__shard_times"))).first()
    found = [int(x) for x in row[0] or []]
    twice = {b for a, b in zip(found, found[1:]) if a == b}
    return sorted(set(found) | {b + 1 for b in twice})


def keys(rows: DataFrame, group: Column, row_id: Column, size: Column) -> DataFrame:
    """``rows`` without ``shard`` and ``slot``, with key, tie and size of each; to be stored, as the tie holds the row's number."""
    tie = _hash52(row_id, F.monotonically_increasing_id())
    keyed = rows.withColumns({"__shard_key": _hash52(group), "__shard_tie": tie, "__shard_size": size.cast("long")})
    return keyed.drop("shard", "slot")


def shard(
    rows: DataFrame,
    group: Column,
    row_id: Column,
    size: Column,
    shards: int = 8,
    ranges_per_shard: int = 64,
    samples_per_range: int = 32,
    range_bytes: int = 256 << 20,
    most_ranges: int = 1 << 14,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in a shard).

    ``group``: equal values belong together; ``row_id`` breaks ties; ``size`` is
    a row's weight (at least 1).  The number of ranges grows with the bytes up
    to ``most_ranges``; it bounds what the driver and the broadcast hold.
    ``rows`` is stored with its keys, so pass narrow ones.
    """
    keyed = cut(keys(rows, group, row_id, size), "shard-rows")
    passed = [c for c in keyed.columns if not c.startswith("__shard_")]
    total = keyed.agg(F.sum("__shard_size")).first()[0] or 0
    if not total:
        return keyed.select(*[F.col(f"`{c}`") for c in passed]).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranges = min(most_ranges, max(shards * ranges_per_shard, total // range_bytes))
    share = max(1, total // ranges)
    bounds = splitters(keyed, total, ranges, samples_per_range)
    keyed = keyed.withColumn("__shard_range", _range_of(F.col("__shard_key"), bounds))

    # Ranges above 1.5 shares are cut by the row id's hash into equal parts.
    spread = keyed.groupBy("__shard_range").agg(F.sum("__shard_size").alias("__shard_bytes"))
    parts = F.when(F.col("__shard_bytes") > 1.5 * share, F.ceil(F.col("__shard_bytes") / share)).otherwise(1)
    spread = spread.select("__shard_range", parts.cast("long").alias("__shard_parts"))
    keyed = keyed.join(F.broadcast(spread), "__shard_range").withColumn(
        "__shard_part", F.floor(F.col("__shard_tie") * F.col("__shard_parts") / F.lit(float(KEY_SPAN))).cast("long")
    )

    # One row for each part, at most about 2.5 times the ranges: offsets by running sums.
    piece = ["__shard_range", "__shard_part"]
    counted = keyed.groupBy(*piece).agg(
        F.sum("__shard_size").alias("__shard_bytes"), F.count(F.lit(1)).alias("__shard_rows")
    )
    before = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    centre = F.coalesce(F.sum("__shard_bytes").over(before), F.lit(0)) + F.col("__shard_bytes") / 2
    dealt = counted.withColumn("shard", F.least(F.floor(centre * shards / total), F.lit(shards - 1)).cast("int"))
    inside = Window.partitionBy("shard").orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select(
        *piece, "shard", F.coalesce(F.sum("__shard_rows").over(inside), F.lit(0)).alias("__shard_start")
    )
    order = Window.partitionBy(*piece).orderBy("__shard_key", "__shard_tie", "__shard_size")
    return (
        keyed.join(F.broadcast(dealt), piece)
        .withColumn("slot", (F.col("__shard_start") + F.row_number().over(order) - 1).cast("long"))
        .select(*[F.col(f"`{c}`") for c in passed], "shard", "slot")
    )


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards; the law held is ``bytes``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        unsigned_crc32(F.col("text")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    placed = shard(narrow, F.col("text_hash"), F.col("doc_id"), F.col("size"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
