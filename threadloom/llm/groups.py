"""Work on sorted groups of rows, with large groups dealt out as pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, paused_collection


def deal(rows: DataFrame, key: list[str], tie: str, block: int, few: int = 10_000, fine: int | None = None) -> DataFrame:
    """``rows`` with ``__i`` and ``__j``: every pair of a group's rows meets in some (key, i, j).

    A group of n rows is cut into ceil(n / block) blocks by the hash of ``tie``,
    with ``fine`` into up to 12 blocks of at least that size, so that one group of
    middling size isn't one task; a row goes to every pair of blocks that holds
    its own (``__own`` tells it).  Only groups of more than one block are looked
    up; their table is sent to all tasks when it has at most ``few`` rows, and
    joined otherwise.
    """
    least = fine or block
    sizes = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least), "large-groups")
    large = sizes.limit(few + 1).count()
    if not large:
        return rows.withColumns({c: F.lit(0) for c in ("__own", "__i", "__j")})
    dealt = rows.join(F.broadcast(sizes) if large <= few else sizes, key, "left")
    blocks = F.greatest(F.ceil(F.col("__n") / block), F.least(F.lit(12), F.ceil(F.col("__n") / least)))
    dealt = dealt.withColumn("__blocks", F.coalesce(blocks, F.lit(1)).cast("int"))
    dealt = dealt.withColumn("__own", F.pmod(F.xxhash64(tie), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return dealt.withColumns(
        {"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")}
    ).drop("__n", "__blocks", "__other")


def deal_out(dealt: DataFrame, name: str, *order: str) -> DataFrame:
    """``dealt`` by its groups (name, i, j) and sorted so; the block pairs of one group go to different partitions."""
    number = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = F.shiftright(F.col("__j") * (F.col("__j") + 1), 1) + F.col("__i")
    place = F.pmod(F.pmod(F.xxhash64(name), F.lit(number)) + pair, F.lit(number)).cast("int")
    return dealt.repartitionById(number, place).sortWithinPartitions(name, "__i", "__j", *order)


def by_group(
    batches: Iterable[pa.RecordBatch], key: list[str], function: Callable[[pa.Table, np.ndarray], pa.RecordBatch], rows: int = 1 << 15
) -> Iterator[pa.RecordBatch]:
    """Calls ``function(table, starts)`` on runs of whole groups of at least ``rows`` rows in all.

    The batches are sorted by ``key``; ``starts`` are the first rows of the groups.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            whole = pa.Table.from_batches(held)
            starts = _starts(whole, key)
            last = int(starts[-1])
            if last:
                with paused_collection():
                    out = function(whole.slice(0, last), starts[:-1])
                yield out
                rest = whole.slice(last)
                held, count = rest.to_batches(), rest.num_rows
    if count:
        whole = pa.Table.from_batches(held)
        with paused_collection():
            out = function(whole, _starts(whole, key))
        yield out


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in key:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
