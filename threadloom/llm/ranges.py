"""Rows numbered without gaps, and running sums, by many tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
_INSIDE = 33


def numbered(rows: DataFrame, name: str, order: list | None = None, label: str = "numbered") -> DataFrame:
    """``rows`` with ``name``: their number from 0, in the order of ``order`` if there is one.

    Rows are dealt by ranges and sorted inside them, or stay where they are, and are
    stored with their place in their partition; the driver gets one count for each
    partition, so no key, however frequent, is numbered by one task.  Rows that tie in
    ``order`` are numbered in any order.
    """
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(rows.withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", _INSIDE)
    counts = {r[0]: r[1] for r in held.groupBy(part).agg(F.count(F.lit(1))).collect()}
    starts, total = [], 0
    for key in sorted(counts):
        starts.append((key, total))
        total += counts[key]
    # one row for each partition
    before = held.sparkSession.createDataFrame(starts, "__part long, __before long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << _INSIDE) - 1))
    joined = held.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.col("__before") + inside).drop("__at", "__part", "__before")


def running(rows: DataFrame, value: str, name: str, order: list[str], label: str = "running") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, in the order of columns without ties.

    As with ``numbered``, ranges are summed by tasks and the driver gets a sum for each.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(value).to_numpy()
            sums = total + np.cumsum(values)
            total = int(sums[-1]) if len(sums) else total
            columns = [*batch.columns, pa.array(sums - values, pa.int64()), pa.array(np.full(len(values), part, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name, "__part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    held = cut(dealt.mapInArrow(add, f"{schema}, `{name}` long, __part long"), label)
    totals = {r[0]: r[1] for r in held.groupBy("__part").agg(F.sum(value)).collect()}
    starts, total = [], 0
    for key in sorted(totals):
        starts.append((key, total))
        total += totals[key]
    # one row for each partition
    before = held.sparkSession.createDataFrame(starts, "__part long, __before long")
    joined = held.join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
