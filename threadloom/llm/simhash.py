"""SimHash near-duplicates through a hierarchical index in Gray order.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word
shingles.  Two fingerprints that differ in at most ``MAX_BITS`` bits agree on
all bits of some ``blocks - MAX_BITS`` of ``blocks`` bit blocks, so each distinct
fingerprint joins one group for every such choice; the number of blocks grows
with the number of fingerprints, so that groups stay small.  In a group the
fingerprints are sorted by Gray rank, which puts similar bit patterns side by
side, and runs of eight become nodes: a node holds the bits that all below it
share (pattern and mask), and its parent the bits that eight nodes share.  A
query walks down from the root, adding at each node only the differences in
bits that its parent did not hold; a node whose sum exceeds the limit is pruned
with all below it, as is one whose members are already linked to the query.

Every link between different fingerprints is found, and what is written down
are spanning links, so dense groups never become lists of pairs.  Groups above
``BLOCK`` fingerprints are dealt out as pairs of blocks.

``deduplicate`` is the form for similar texts: the index finds the close ones, and
an exact search finds the rest, which no fingerprint can promise (two texts that
share 4/5 of their shingles differ in some 10 of 64 bits, and now and then in 20).

Defined results: null and empty texts have fingerprint zero and are linked like
any other; repeated rows and equal texts share a component; a null id takes the
smallest id of its component (null when it has none); texts are read whole, however
long; ties in Gray rank don't matter; an empty table gives no rows; other columns
pass through ``deduplicate``, where unlike texts with one id stay apart and repeated
rows become one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, cut, discard, map_batches, table
from threadloom.llm.components import UnionFind, components, thin
from threadloom.llm.groups import by_group, deal, deal_out

SEED = 42
#: Words of a shingle and bits that may differ, by the contract of the query.
WORDS, MAX_BITS = 4, 4
#: Fingerprints of a group that one task takes at once.
BLOCK = 8192
#: Fingerprints that a group holds on average before more bit blocks are used.
MEAN_GROUP = 64
FANOUT = 8
#: (query, node) entries held at once by a search.
FRONTIER = 1 << 19
#: Similar texts (``deduplicate``): words of a shingle; they share 4/5 of their distinct shingles or more.
SIMILAR_WORDS = 5
#: Hashes whose bits are held as bytes at once.
HASHES = 1 << 18
#: Words of 64 bits in the parity sketch that meets others by shingle, and in the shortest of those that pairs are tested with.
SKETCH, WIDE = 4, 32
#: Rows of a shingle's group up to which all its pairs are tested at once.
FEW = 32
#: Sets of a more common shingle that one task compares at once.
FOREST_BLOCK = 4096
#: Texts of an open cluster that one task compares at once, and blocks that are not cut further.
OPEN_BLOCK, OPEN_FINE = 1024, 128
#: Texts counted for the order of shingles, the least count that matters, and counts sent to all tasks.
COUNTED, OFTEN, COUNTS = 20_000, 4, 1 << 18
#: Sets of a partition that are remembered, so that copies are sent once.
SEEN = 1 << 20


def shingle_hashes(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts in order, and shingles of each text."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            continue
        line = b" ".join(found)
        if len(found) <= words:
            hashes.append(digest(line, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.append(0, ends[:-words]).tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        hashes.extend([digest(line[a:b], SEED) for a, b in zip(starts, stops)])
        counts[i] = len(starts)
    return np.array(hashes, "<u8"), counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in more than half of each text's hashes, as unsigned 64-bit numbers; zero without hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        ends = np.cumsum(counts[some])
        ones = np.zeros((len(some), 64), np.int64)
        for begin in range(0, len(hashes), HASHES):
            end = min(len(hashes), begin + HASHES)
            bits = np.unpackbits(hashes[begin:end].view(np.uint8), bitorder="little").reshape(-1, 64)
            first, last = np.searchsorted(ends, [begin, end - 1], "right")
            at = np.maximum(np.append(0, ends)[first : last + 1], begin) - begin
            ones[first : last + 1] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        most = ones * 2 > counts[some][:, None]
        out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    return majority(*shingle_hashes(texts, words))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_masks(blocks: int, limit: int = MAX_BITS) -> list[int]:
    """Masks of every choice of blocks - limit out of ``blocks`` bit blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - limit)]


def blocks_for(distinct: int, limit: int = MAX_BITS) -> int:
    """Fewest blocks for which groups of random fingerprints stay near MEAN_GROUP."""
    blocks = limit + 1
    while blocks < 16 and distinct > MEAN_GROUP << (64 * (blocks - limit) // blocks):
        blocks += 1
    return blocks


class GrayIndex:
    """Trees of shared bit patterns over groups of codes, each group in Gray order."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        n = len(codes)
        ends = np.append(starts[1:], n)
        full = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        leaf = np.arange(n, dtype=np.int64)
        # pattern, mask, first child, end of children, first leaf, end of leaves
        self.levels = [(codes, full, leaf, leaf + 1, leaf, leaf + 1)]
        ones, any_ = codes, codes
        first, size = starts, ends - starts
        while (size > 1).any():
            above = -(-size // FANOUT)
            begin = np.cumsum(above) - above
            nth = np.arange(above.sum()) - np.repeat(begin, above)
            lo = np.repeat(first, above) + nth * FANOUT
            hi = np.minimum(lo + FANOUT, np.repeat(first + size, above))
            below = self.levels[-1]
            ones, any_ = np.bitwise_and.reduceat(ones, lo), np.bitwise_or.reduceat(any_, lo)
            self.levels.append((ones, ~(ones ^ any_), lo, hi, below[4][lo], below[5][hi - 1]))
            first, size = begin, above
        self.codes, self.roots = codes, np.repeat(np.arange(len(starts)), ends - starts)
        self.longest = int((ends - starts).max(initial=1))

    def link(self, limit: int) -> UnionFind:
        """Sets of codes connected by differences of at most ``limit`` bits within their group."""
        n = len(self.codes)
        sets = UnionFind(n)
        near = (np.bitwise_count(self.codes[1:] ^ self.codes[:-1]) <= limit) & (self.roots[1:] == self.roots[:-1])
        sets.add(np.flatnonzero(near), np.flatnonzero(near) + 1)
        for _, mask, _, _, leaf_lo, leaf_hi in self.levels[1:]:
            tight = np.flatnonzero(np.bitwise_count(~mask) <= limit)
            many = leaf_hi[tight] - leaf_lo[tight]
            head = np.repeat(leaf_lo[tight], many)
            sets.add(head, head + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        step = max(16, min(1 << 14, FRONTIER // self.longest))
        for begin in range(0, n, step):
            self._search(np.arange(begin, min(n, begin + step)), limit, sets)
        return sets

    def _search(self, query: np.ndarray, limit: int, sets: UnionFind) -> None:
        codes, labels = self.codes, sets.root
        alike = [labels]  # the set that all leaves of a node are in, or -1
        for _, _, lo, _, _, _ in self.levels[1:]:
            least, most = np.minimum.reduceat(alike[-1], lo), np.maximum.reduceat(alike[-1], lo)
            alike.append(np.where(least == most, least, -1))
        top = len(self.levels) - 1
        pattern, mask = self.levels[top][:2]
        node = self.roots[query]
        far = np.bitwise_count((codes[query] ^ pattern[node]) & mask[node]).astype(np.int16)
        held = mask[node]
        for level in range(top, -1, -1):
            _, _, lo, hi, _, leaf_hi = self.levels[level]
            keep = (far <= limit) & (leaf_hi[node] > query + 1) & (alike[level][node] != labels[query])
            query, node, far, held = query[keep], node[keep], far[keep], held[keep]
            if not level or not len(query):
                break
            many = hi[node] - lo[node]
            child = np.repeat(lo[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            query, far, held = np.repeat(query, many), np.repeat(far, many), np.repeat(held, many)
            pattern, mask = self.levels[level - 1][:2]
            below = mask[child]
            far = far + np.bitwise_count((codes[query] ^ pattern[child]) & below & ~held)
            node, held = child, below
        sets.add(query, node)


def links(codes: DataFrame, masks: list[int], limit: int, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) among the distinct fingerprints of ``codes`` (fp).

    Fingerprints are compared when they agree on all bits of a mask.
    """

    def spread(batch: pa.RecordBatch) -> dict:
        fp = batch.column("fp").to_numpy()
        raw, k = fp.view(np.uint64), len(masks)
        return {
            "fp": np.tile(fp, k),
            "choice": np.repeat(np.arange(k, dtype=np.int32), len(fp)),
            "value": np.concatenate([(raw & np.uint64(m)).view(np.int64) for m in masks]),
        }

    bound_batches(codes.sparkSession)
    rows = map_batches(codes.select("fp"), spread, "choice int, value long, fp long")
    key = ["choice", "value", "__i", "__j"]
    dealt = deal(rows, ["choice", "value"], "fp", block).repartition(*key).sortWithinPartitions(*key)

    def join(held: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        fp = held.column("fp").to_numpy()
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fp))))
        order = np.lexsort((gray_rank(fp.view(np.uint64)), group))
        sets = GrayIndex(fp[order].view(np.uint64), starts).link(limit)
        moved = np.flatnonzero(sets.root != np.arange(len(fp)))
        a, b = fp[order[moved]], fp[order[sets.root[moved]]]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(lambda batches: thin(by_group(batches, key, join)), "a long, b long")


def fingerprint(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every document."""
    bound_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        fp = fingerprints(batch.column("text").to_pylist(), words)
        return {"doc_id": batch.column("doc_id"), "fp": fp.view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def classes(docs: DataFrame, words: int = WORDS, limit: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    marked = cut(fingerprint(docs, words), "simhash-fp")
    codes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-codes")
    masks = block_masks(blocks_for(codes.count(), limit), limit)
    found = components(links(codes, masks, limit))
    linked = codes.join(found, codes["fp"] == found["node"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    named = codes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # stored, so that both sides of the last join are plain exchanges, which may be split where one fp is hot
    return marked.join(cut(named, "simhash-named"), "fp").select("doc_id", "fp", "component_id")


def shingle_sets(texts: list[str | None], words: int = SIMILAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, ascending in each, and how many each has."""
    hashes, counts = shingle_hashes(texts, words)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))


def _remix(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return hashes ^ (hashes >> np.uint64(29))


def digests(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that tell equal sets."""
    out = np.zeros((2, len(counts)), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = np.cumsum(counts[some]) - counts[some]
        out[0, some], out[1, some] = np.add.reduceat(hashes, at), np.add.reduceat(_remix(hashes), at)
    return out[0].view(np.int64), out[1].view(np.int64)


def sketches(hashes: np.ndarray, counts: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """(n, words): parity of the members that fall on each bit.

    Two sketches never differ in more bits than their sets differ in members.
    """
    size = 64 * words
    bit = (_remix(hashes) >> np.uint64(40)).astype(np.int64) % size
    ones = np.bincount(np.repeat(np.arange(len(counts)), counts) * size + bit, minlength=len(counts) * size)
    bits = (ones & 1).astype(np.uint8).reshape(len(counts), size)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def wide_sketches(hashes: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Parity sketches of two bits or more for each member: a power of two of words, WIDE at least.

    The two halves of a sketch, added, are the sketch of half the size.
    """
    words = np.full(len(counts), WIDE, np.int64)
    while (small := 32 * words < counts).any():
        words[small] *= 2
    ends = np.append(0, np.cumsum(words))
    bit = (_remix(hashes) >> np.uint64(20)).astype(np.int64) & np.repeat(64 * words - 1, counts)
    ones = np.bincount(np.repeat(64 * ends[:-1], counts) + bit, minlength=64 * int(ends[-1]))
    flat = np.packbits((ones & 1).astype(np.uint8), bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _often(docs: DataFrame, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of some counted rows of ``docs`` (key, text) hold, ascending, and their counts.

    They only order the shingles, so what the sample holds changes no result.
    """
    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(max(1, number // COUNTED))) == 0).select("text")
    held = map_batches(some, lambda batch: {"shingle": shingle_sets(batch.column("text").to_pylist())[0].view(np.int64)}, "shingle long")
    least, counts = OFTEN, cut(held.groupBy("shingle").count().where(F.col("count") >= OFTEN), "simhash-often")
    while counts.where(F.col("count") >= least).count() > COUNTS:
        least *= 2
    found = counts.where(F.col("count") >= least).toArrow()
    discard(counts)
    shingles, number = found.column("shingle").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], number[order]


def marks(docs: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, key, s1, s2, n, fp, o0, ..., wide, rare, prefix) of the rows (id, key, text).

    s1, s2 and n tell equal sets of shingles, fp is the fingerprint of the set and
    o0, ... and ``wide`` are its parity sketches.  ``prefix`` holds the rarest fifth of the set and one
    more: in one order of all shingles, sets of n and m members that share 4/5 of
    their union share a member within the first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1.
    Its first ``rare`` members aren't among those counted often.
    """
    spread = docs.sparkSession.sparkContext.broadcast(often)

    def run(batch: pa.RecordBatch) -> dict:
        known, number = spread.value
        flat, n = shingle_sets(batch.column("text").to_pylist())
        s1, s2 = digests(flat, n)
        odd = sketches(flat, n).view(np.int64)
        fp = majority(flat, n).view(np.int64)
        own = flat.view(np.int64)
        weight = np.zeros(len(flat), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            weight = np.where(known[place] == own, number[place], 0)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((own, weight, owner))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        many = np.where(n > 0, n + 1 - -(-4 * n // 5), 0)
        chosen = order[rank < np.repeat(many, n)]
        first = own[chosen]
        rare = np.bincount(owner[chosen], weights=weight[chosen] == 0, minlength=len(n)).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(first))
        out = {"id": batch.column("id"), "key": batch.column("key"), "s1": s1, "s2": s2, "n": n, "fp": fp, "rare": rare, "prefix": prefix}
        out["wide"] = wide_sketches(flat, n)
        return out | {f"o{i}": odd[:, i] for i in range(SKETCH)}

    columns = ", ".join(f"{c} long" for c in ("s1", "s2", "n", "fp", *(f"o{i}" for i in range(SKETCH))))
    return map_batches(docs, run, f"id long, key string, {columns}, wide array<long>, rare int, prefix array<long>")


def shared_prefixes(marked: DataFrame) -> DataFrame:
    """(shingle, s1, s2): the prefix shingles that two or more different sets have, or that were counted often.

    Those counted often need no test, so the exchange by shingle meets no key that
    a large share of the sets has.
    """

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            s1, s2 = batch.column("s1").to_numpy(), batch.column("s2").to_numpy()
            new = np.zeros(len(s1), bool)
            for i, pair in enumerate(zip(s1.tolist(), s2.tolist())):
                new[i] = pair not in seen
                seen.add(pair)
            batch = batch.filter(pa.array(new))
            prefix, many = batch.column("prefix"), batch.column("prefix").value_lengths().to_numpy()
            columns = [prefix.flatten(), pa.array(np.repeat(s1[new], many)), pa.array(np.repeat(s2[new], many))]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "s1", "s2"])
            if len(seen) > SEEN:  # sets that come again are only sent again
                seen.clear()

    def repeated(held: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        s1, s2 = held.column("s1").to_numpy(), held.column("s2").to_numpy()
        new = np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))
        new[starts] = True
        size = np.add.reduceat(new.astype(np.int64), starts)
        return held.filter(pa.array(new & np.repeat(size > 1, np.diff(np.append(starts, held.num_rows))))).combine_chunks()

    def shared(batches):
        for table_ in by_group(batches, ["shingle"], repeated):
            yield from table_.to_batches()

    schema = "shingle long, s1 long, s2 long"
    rare = marked.where("n > 0").select("s1", "s2", F.slice("prefix", F.lit(1), F.col("rare")).alias("prefix"))
    rare = rare.mapInArrow(spread, schema).repartition("shingle").sortWithinPartitions("shingle", "s1", "s2")
    often = marked.where("rare < size(prefix)").select("s1", "s2", F.slice("prefix", F.col("rare") + 1, F.size("prefix")).alias("prefix"))
    often = often.mapInArrow(spread, schema).distinct()
    return rare.mapInArrow(shared, schema).unionByName(often)


def sets(texts: DataFrame) -> DataFrame:
    """(node, n, shingles) of the rows (node, s1, s2, n, text) whose text has the node's set; repeated rows give one."""
    seen: set[int] = set()

    def run(batch: pa.RecordBatch) -> dict:
        hashes, n = shingle_sets(batch.column("text").to_pylist())
        s1, s2 = digests(hashes, n)
        ours = (s1 == batch.column("s1").to_numpy()) & (s2 == batch.column("s2").to_numpy())
        ours &= n == batch.column("n").to_numpy()
        node = batch.column("node").to_numpy()
        for i in np.flatnonzero(ours).tolist():
            ours[i] = int(node[i]) not in seen
            seen.add(int(node[i]))
        ends = pa.array(np.append(0, np.cumsum(n[ours])), pa.int32())
        flat = pa.array(hashes[np.repeat(ours, n)].view(np.int64))
        return {"node": node[ours], "n": n[ours], "shingles": pa.ListArray.from_arrays(ends, flat)}

    return map_batches(texts, run, "node long, n long, shingles array<long>")


def close_fingerprints(codes: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between nodes of ``codes`` (node, fp) with equal or close fingerprints, by the index; they span its groups."""
    prints = cut(codes.groupBy("fp").agg(F.min("node").alias("head")), "simhash-prints")
    masks = block_masks(blocks_for(prints.count(), limit), limit)
    near = links(prints, masks, limit).distinct()
    near = near.join(prints.toDF("a", "head_a"), "a").join(prints.toDF("b", "head_b"), "b")
    same = codes.select("node", "fp").join(prints, "fp").where("node <> head").select("node", "head")
    return near.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).union(
        same.select(F.least("node", "head"), F.greatest("node", "head"))
    )


class Parities:
    """Wide sketches of some sets, compared by place."""

    def __init__(self, wide: pa.ListArray):
        self.words = wide.value_lengths().to_numpy().astype(np.int64)
        flat, ends = wide.flatten().to_numpy().view(np.uint64), np.cumsum(self.words)
        self.at = np.zeros(len(self.words), np.int64)
        self.of: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for size in np.unique(self.words).tolist():
            here = np.flatnonzero(self.words == size)
            self.at[here] = np.arange(len(here))
            rows = flat[(ends[here] - size)[:, None] + np.arange(size)]
            self.of[size], self.half[size] = rows, rows[:, : size // 2] ^ rows[:, size // 2 :]

    def differ(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits in which set i differs from each of the others, in sketches of the smaller size; many where none fit."""
        size = int(self.words[i])
        out = np.full(len(others), 1 << 40, np.int64)
        for other in (size // 2, size, 2 * size):
            here = np.flatnonzero(self.words[others] == other)
            if len(here):
                own = self.half[size][self.at[i]] if other < size else self.of[size][self.at[i]]
                rows = (self.half if other > size else self.of)[other][self.at[others[here]]]
                out[here] = np.bitwise_count(own ^ rows).sum(axis=1, dtype=np.int64)
        return out


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def few_groups(rows: DataFrame) -> DataFrame:
    """(members): sets of the rows (shingle, node, n, o0, ...) that share a shingle and that size and sketch link, ascending.

    For shingles of at most FEW rows.  Two sets of one that may be similar are in a group, told once however many
    shingles make it, so what leaves a task grows with the rows and not with their pairs.
    """
    sketch = [f"o{i}" for i in range(SKETCH)]

    def join(held: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, n = held.column("node").to_numpy(), held.column("n").to_numpy()
        odd = np.stack([held.column(c).to_numpy() for c in sketch], 1).view(np.uint64)
        last = np.repeat(np.append(starts[1:], len(node)), np.diff(np.append(starts, len(node))))
        linked = UnionFind(len(node))
        few = np.arange(len(node))
        for step in range(1, FEW):
            few = few[few + step < last[few]]
            if not len(few):
                break
            to = few + step
            near = 5 * np.minimum(n[few], n[to]) >= 4 * np.maximum(n[few], n[to])
            near &= 9 * np.bitwise_count(odd[few] ^ odd[to]).sum(axis=1, dtype=np.int64) <= n[few] + n[to]
            linked.add(few[near], to[near])
        size = np.bincount(linked.root, minlength=len(node))
        order = np.lexsort((node, linked.root))
        order = order[size[linked.root[order]] > 1]
        ends = np.append(0, np.cumsum(size[size > 1]))
        members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(node[order]))
        return pa.RecordBatch.from_arrays([members], names=["members"])

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, ...]] = set()
        for batch in by_group(batches, ["shingle"], join):
            new = np.zeros(batch.num_rows, bool)
            for i, group in enumerate(map(tuple, batch.column("members").to_pylist())):
                new[i] = group not in seen
                seen.add(group)
            yield batch.filter(pa.array(new))
            if len(seen) > SEEN >> 3:  # groups that come again are only sent again
                seen.clear()

    dealt = rows.repartition("shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(once, "members array<long>").distinct()


def forest_pairs(rows: DataFrame, block: int = FOREST_BLOCK) -> DataFrame:
    """Pairs (a < b) that span, for each shingle of the rows (shingle, node, n, wide), the sets that may be similar.

    Two sets of a shingle that wide sketches allow to be similar are joined by a path of such pairs.
    """
    key = ["shingle", "__i", "__j"]
    dealt = deal_out(deal(rows, ["shingle"], "node", block), "shingle")

    def join(held: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, n = held.column("node").to_numpy(), held.column("n").to_numpy()
        wide = Parities(held.column("wide").combine_chunks())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(node)).tolist()):
            left, queue = lo + np.argsort(node[lo:hi], kind="stable"), []
            while len(left):
                if not queue:
                    queue, left = [left[0]], left[1:]
                at = queue.pop()
                near = 5 * np.minimum(n[at], n[left]) >= 4 * np.maximum(n[at], n[left])
                near[near] = 9 * wide.differ(at, left[near]) <= n[at] + n[left[near]]
                a.append(np.full(int(near.sum()), at))
                b.append(left[near])
                queue.extend(left[near].tolist())
                left = left[~near]
        return _pairs(node[np.concatenate(a)], node[np.concatenate(b)])

    return dealt.mapInArrow(lambda batches: by_group(batches, key, join, 4 * block), "a long, b long").distinct()


def plausible(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs that wide sketches of ``codes`` (node, n, wide) allow to share 4/5 of their union."""
    one, two = codes.select("node", "n", "wide").toDF("a", "n_a", "of_a"), codes.select("node", "n", "wide").toDF("b", "n_b", "of_b")

    def halved(x):
        half = F.shiftright(F.size(x), 1)
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    # sizes within 4/5 of each other: the sketches are of one size, or one is twice the other
    of_a = F.when(F.size("of_a") > F.size("of_b"), halved(F.col("of_a"))).otherwise(F.col("of_a"))
    of_b = F.when(F.size("of_b") > F.size("of_a"), halved(F.col("of_b"))).otherwise(F.col("of_b"))
    odd = F.zip_with(of_a, of_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(odd, F.lit(0), lambda held, x: held + x)
    sizes = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
    near = F.when(sizes, 9 * differ <= F.col("n_a") + F.col("n_b"))
    return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose sets share 4/5 of their union or more."""
    one = held.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a"))
    two = held.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b")
    return both.where(9 * F.size(F.array_intersect("of_a", "of_b")) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def open_members(members: DataFrame, block: int = OPEN_BLOCK, fine: int = OPEN_FINE) -> DataFrame:
    """(node) of the members (hub, node, label, n, wide) whose sketch allows that they are similar to one of another label."""
    key = ["hub", "__i", "__j"]
    dealt = deal(members.select("hub", "node", "label", "n", "wide"), ["hub"], "node", block, fine=fine)

    def compare(held: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out = [np.zeros(0, np.int64)]
        for lo, hi in zip(starts, np.append(starts[1:], held.num_rows)):
            part = held.slice(lo, hi - lo)
            node, label, n = (part.column(c).to_numpy() for c in ("node", "label", "n"))
            wide, found = Parities(part.column("wide").combine_chunks()), np.zeros(len(n), bool)
            order = np.argsort(n, kind="stable")
            stop = np.searchsorted(4 * n[order], 5 * n[order], "right")
            for place, i in enumerate(order.tolist()):
                rest = order[place + 1 : stop[place]]
                rest = rest[label[rest] != label[i]]
                near = 9 * wide.differ(i, rest) <= n[i] + n[rest]
                found[rest] |= near
                found[i] |= near.any()
            out.append(node[found])
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["node"])

    found = deal_out(dealt, "hub").mapInArrow(lambda batches: by_group(batches, key, compare, 4 * block), "node long")
    return found.distinct()


def cross_links(members: DataFrame, block: int = OPEN_BLOCK, fine: int = OPEN_FINE) -> DataFrame:
    """Links (a, b) between similar sets of one hub (hub, node, label, n, shingles) that differ in label."""
    key = ["hub", "__i", "__j"]
    dealt = deal(members.select("hub", "node", "label", "n", "shingles"), ["hub"], "node", block, fine=fine)

    def compare(held: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(starts, np.append(starts[1:], held.num_rows)):
            part = held.slice(lo, hi - lo)
            node, label, n = (part.column(c).to_numpy() for c in ("node", "label", "n"))
            flat = part.column("shingles").combine_chunks().flatten().to_numpy()
            _, ids, count = np.unique(flat, return_inverse=True, return_counts=True)
            holders = np.repeat(np.arange(len(n)), n)[np.argsort(ids, kind="stable")]
            begin, offset = np.cumsum(count) - count, np.append(0, np.cumsum(n))
            names, often = np.unique(label, return_counts=True)
            for i in np.flatnonzero(label != names[often.argmax()]).tolist():
                own = ids[offset[i] : offset[i + 1]]
                many = count[own]
                at = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                shared = np.bincount(holders[at], minlength=len(n))
                found = np.flatnonzero((9 * shared >= 4 * (n + n[i])) & (label != label[i]))
                a.append(np.full(len(found), node[i]))
                b.append(node[found])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return deal_out(dealt, "hub").mapInArrow(lambda batches: thin(by_group(batches, key, compare, 4 * block)), "a long, b long")


def similar(codes: DataFrame, marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of every set of ``codes`` (node, key, s1, s2, n, fp, o0, ...) that is linked with another.

    The index finds the sets whose fingerprints are close, which are nearly all
    that are copied with few changes.  Sets further apart are found by a shingle
    of their prefixes, by sketches that can't rule out a similar pair.  Of the sets
    that a shingle brings together a spanning forest of what the sketches allow is
    verified: where few sets have the shingle, the links with the smallest one, if wider sketches
    allow them all.  Where that leaves sets apart that a forest holds together, they
    are compared themselves.
    """
    sketch = [f"o{i}" for i in range(SKETCH)]
    shared = cut(shared_prefixes(marked), "simhash-prefixes")
    discard(marked)
    rows = cut(shared.join(codes.select("s1", "s2", "node", "n", *sketch), ["s1", "s2"]).drop("s1", "s2"), "simhash-rows")
    discard(shared)
    common = cut(rows.groupBy("shingle").count().where(F.col("count") > FEW).select("shingle"), "simhash-common")
    groups = few_groups(rows.join(common, "shingle", "left_anti"))
    groups = cut(groups.withColumn("group", F.monotonically_increasing_id()), "simhash-groups")
    stars = groups.select("group", F.size("members").alias("many"), F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, FEW)).alias("b"))
    allowed = cut(plausible(stars.select("a", "b").distinct(), codes), "simhash-stars")
    several = stars.where("many > 2")
    broken = cut(several.join(allowed, ["a", "b"], "left_anti").select("group").distinct(), "simhash-broken")
    crowded = rows.join(common, "shingle").select("shingle", "node").union(groups.join(broken, "group").select("group", F.explode("members")))
    forest = forest_pairs(crowded.join(codes.select("node", "n", "wide"), "node"))
    forest = cut(forest.union(several.join(broken, "group", "left_anti").select("a", "b")).distinct(), "simhash-forest")
    discard(rows, common)
    likely = cut(allowed.union(forest).distinct(), "simhash-likely")
    near = cut(plausible(close_fingerprints(codes), codes), "simhash-near")
    ends = likely.union(near)
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
    wanted = codes.select("node", "key", "s1", "s2", "n").join(nodes, "node")
    held = cut(sets(texts.join(wanted, "key").select("node", "s1", "s2", "n", "text")), "simhash-shingles")
    all_ = cut(verified(near.union(likely).distinct(), held), "simhash-similar")
    found = components(all_)
    if forest.limit(1).count():
        hubs = components(forest).select("node", F.col("root").alias("hub"))
        members = cut(hubs.join(found, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("label")), "simhash-hubs")
        apart = members.groupBy("hub").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("hub")
        members = members.join(apart, "hub")
        left = cut(open_members(members.join(codes.select("node", "n", "wide"), "node")), "simhash-left")
        if left.limit(1).count():
            cross = cut(cross_links(members.join(left, "node").join(held, "node")), "simhash-cross")
            found = components(all_.union(cross))
    discard(groups, allowed, broken, forest, likely, held, near)
    return found


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the smallest id stays.

    Texts are linked when they share 4/5 or more of their distinct
    ``SIMILAR_WORDS``-word shingles; no pair is missed and none is added.  Rows
    are known by id and text, so unlike texts with one id are kept apart, and
    repeated rows become one.
    """
    bound_batches(docs.sparkSession)
    key = F.concat_ws("~", F.col("doc_id").cast("string"), F.sha1(F.coalesce("text", F.lit(""))))
    sketch = [f"o{i}" for i in range(SKETCH)]
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("key"), "text")
    marked = cut(marks(narrow, _often(narrow.select("key", "text"), docs.count())), "simhash-marks")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first")
    codes = marked.groupBy("s1", "s2", "n", "fp", *sketch).agg(first, F.first("wide").alias("wide"))
    codes = codes.withColumn("node", F.monotonically_increasing_id())
    codes = cut(codes.withColumn("key", F.col("first.key")), "simhash-sets")
    found = similar(codes, marked, narrow.select("key", "text"))
    roots = codes.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    stay = cut(roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("__key")), "simhash-stay")
    kept = docs.withColumn("__key", key).join(stay, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).drop("__key")


def op8_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
