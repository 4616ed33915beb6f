"""Minimal perfect hashes with stored keys, in parts that tasks build and blocks that tasks can hold.

Keys are dealt to parts by their hash, so a part holds about ``PART`` keys whatever their
number, and one task builds each: levels of bits, where a key that is alone at its bit takes
it and the others go on to the next level; a key's slot is the rank of its bit.  An absent
key may reach a slot, and is told by the key stored there.  ``blocks`` hands the parts out,
so many at a time that a task's memory holds them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut

#: Keys of a part, about, and of a block of parts that tasks hold at once.
PART, BLOCK = 1 << 18, 1 << 22
#: Bits of a level for each of its keys.
ROOM = 2


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_hashes(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of pairs of 64-bit numbers."""
    one = mix(high ^ mix(low + np.uint64(0x9E3779B97F4A7C15)))
    return one, mix(low ^ mix(high + one)) | np.uint64(1)


class PerfectHash:
    """Slots 0 to n - 1 of n keys, which are given by two hashes each."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        level = 0
        while len(one):
            bits = max(64, -(-ROOM * len(one) // 64) * 64)
            at = self._at(one, two, level, bits)
            alone = np.bincount(at, minlength=bits)[at] == 1
            held = np.zeros(bits, bool)
            held[at[alone]] = True
            words = np.packbits(held, bitorder="little").view("<u8")
            ranks = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.levels.append((words, (self.size + ranks - np.bitwise_count(words)).astype(np.int64)))
            self.size += int(ranks[-1])
            one, two = one[~alone], two[~alone]
            level += 1
            if level > 200:
                raise ValueError("keys repeat")

    @staticmethod
    def _at(one: np.ndarray, two: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(one + np.uint64(level) * two) % np.uint64(bits)).astype(np.int64)

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """A slot for each, -1 for keys that reach none; others than the keys may reach one."""
        out = np.full(len(one), -1, np.int64)
        todo = np.arange(len(one))
        for level, (words, ranks) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._at(one[todo], two[todo], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = ranks[at[hit] >> 6] + below
            todo = todo[~hit]
        return out


class Block:
    """Some parts of an index: slots of keys by (hashes, equality with the stored key)."""

    def __init__(self, bits: int, parts: dict[int, tuple[int, PerfectHash, object]]):
        self.bits, self.parts = bits, parts

    def part_of(self, one: np.ndarray) -> np.ndarray:
        return part_of(one, self.bits)

    def covers(self, one: np.ndarray) -> np.ndarray:
        """Whether the part of each key is in this block."""
        if len(self.parts) == 1 << self.bits:
            return np.ones(len(one), bool)
        return np.isin(self.part_of(one), list(self.parts))

    def find(self, one: np.ndarray, two: np.ndarray, same: Callable[[object, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The number of each key, -1 if it isn't in this block; ``same(stored, slots, rows)`` compares keys."""
        out = np.full(len(one), -1, np.int64)
        of = self.part_of(one) if self.bits else None
        for number, (base, slots, stored) in self.parts.items():
            rows = np.arange(len(one)) if of is None else np.flatnonzero(of == number)
            if slots is None or not len(rows):
                continue
            found = slots.slots(one[rows], two[rows])
            rows, found = rows[found >= 0], found[found >= 0]
            equal = same(stored, found, rows)
            out[rows[equal]] = base + found[equal]
        return out


def part_of(one: np.ndarray, bits: int) -> np.ndarray:
    return (one >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)


class Index:
    """The stored parts of an index over the rows of a table."""

    def __init__(self, parts: DataFrame, bits: int, sizes: dict[int, int]):
        self.table, self.bits, self.sizes = parts, bits, sizes
        self.bases, at = {}, 0
        for number in sorted(sizes):
            self.bases[number] = at
            at += sizes[number]
        self.size = at

    def blocks(self) -> Iterator[tuple[list[int], object]]:
        """For each block: its parts, and a broadcast ``Block``.  The driver holds one block at a time."""
        step = max(1, BLOCK // PART)
        spark = self.table.sparkSession
        for first in range(0, 1 << self.bits, step):
            rows = self.table.where(F.col("part").between(first, first + step - 1)).collect()
            numbers = list(range(first, min(first + step, 1 << self.bits)))
            parts = dict.fromkeys(numbers, (0, None, None))
            for r in rows:
                parts[r["part"]] = (self.bases[r["part"]], *pickle.loads(r["blob"]))
            yield numbers, spark.sparkContext.broadcast(Block(self.bits, parts))


def index(rows: DataFrame, hashes: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], store: Callable[[pa.Table, np.ndarray], object], name: str) -> Index:
    """An index over distinct ``rows`` (stored); ``store(table, order)`` are the keys to keep, ``order`` rows by slot."""
    n = rows.count()
    bits = max(0, (-(-n // PART) - 1).bit_length())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def deal(batches):
        for batch in batches:
            one, _ = hashes(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part_of(one, bits).astype(np.int32))], names=[*batch.schema.names, "part"])

    def build(table: pa.Table) -> pa.Table:
        one, two = hashes(table)
        found = PerfectHash(one, two)
        order = np.empty(len(one), np.int64)
        order[found.slots(one, two)] = np.arange(len(one))
        blob = pickle.dumps((found, store(table, order)), protocol=5)
        number = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([number], pa.int32()), "n": pa.array([len(one)], pa.int64()), "blob": pa.array([blob], pa.large_binary())}).cast(
            pa.schema([("part", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
        )

    dealt = rows.mapInArrow(deal, f"{fields}, part int")
    parts = cut(dealt.groupBy("part").applyInArrow(build, "part int, n long, blob binary"), name)
    sizes = {r["part"]: r["n"] for r in parts.select("part", "n").collect()}
    return Index(parts, bits, sizes)
