"""Phrase collocation mining: Apriori-safe candidates counted by perfect-hash slots.

1. Words are counted by language, and those that reach ``least`` get dense ids, the slots
   of a perfect hash whose stored words tell other words apart.  Texts become arrays of
   ids, stored once; 0 stands for other words and for the ends of pieces.
2. For 2, 3 and 4 words, tasks sieve: only occurrences whose two parts without the first
   and without the last word are candidates themselves are summed, as a phrase is nowhere
   more frequent than its parts, and sums below ``least`` go.  No phrase is lost.
3. One perfect hash spans words and candidates.  Tasks look up every position's phrases,
   verify the stored ids, and count slots with bincount into one array for each part of
   the hash; arrays are summed as a tree, ``FAN`` of them at a time.
4. A candidate's cuts read the counts of both sides by slot.  Longer candidates tell the
   phrases inside them, which are dropped where they mostly stand there.

Memory is bounded: perfect hashes come in parts that tasks build, and tasks hold a block of
them at once (``hashindex``); more candidates or words than a block take a pass over the ids,
or texts, for each block.  Frequent words and phrases are summed before each shuffle, and
ranks come from ranges, so no word, language or phrase is one task's work.

Counts and products are exact: 64-bit where they fit, Python's integers otherwise.

Defined results: null texts are empty, a null language is ``und``; only A to Z are lowered;
texts are read whole, however long, and repeated rows count again; an empty table gives no
rows; ties are broken by the phrase's bytes; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import hashindex
from threadloom.llm.common import bound_batches, cut, discard, give_back, paused_collection, slices, table
from threadloom.llm.hashindex import Index, index, pair_hashes
from threadloom.llm.ranges import numbered

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase is dropped if a longer one holds it in SHARE of 100 of its occurrences or more.
SHARE, SCALE = 80, 2_000_000
#: Rows and bytes of text taken at once, and arrays that one task sums.
ROWS, BYTES, FAN = 2048, 4 << 20, 16
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
WORD, BLANK, STOP = range(3)
_KIND = np.full(256, WORD, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = STOP


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of all texts as a dictionary array, the text of each word, and whether a piece begins at it."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at, raw = at - at[0], _LOWER[raw]
    kind = _KIND[raw]
    word = kind == WORD
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    bounds = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[word]))]
    ).dictionary_encode()
    text = np.searchsorted(at, starts, "right") - 1
    stops = np.cumsum(kind == STOP)[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])
    return words, text, new


def _by_language(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a batch with their language before them, which of them each word is, and where pieces begin."""
    words, text, new = split(batch.column("text"))
    lang = batch.column("lang").dictionary_encode()
    names = [x.encode() + b"\xff" for x in lang.dictionary.to_pylist()]
    which, size = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    both = lang.indices.to_numpy().astype(np.int64)[text] * size + which
    found, back = _distinct(both, size * max(1, len(names)))
    plain = words.dictionary.to_pylist()
    return [names[k // size] + plain[k % size] for k in found.tolist()], back, new


def _distinct(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values from 0 to ``most`` - 1 in order, and the place of each value among them."""
    seen = np.zeros(most, bool)
    seen[values] = True
    found = np.flatnonzero(seen)
    place = np.zeros(most, np.int64)
    place[found] = np.arange(len(found))
    return found, place[values]


def _word_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(map(_digest, keys)), "<u8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1] | np.uint64(1)


_digest = xxhash.xxh3_128_digest


def _texts(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession, ROWS)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")


def _each(batches: Iterable[pa.RecordBatch], function) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, BYTES):
            with paused_collection():
                out = function(some)
            yield out
    give_back()


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): occurrences of every word; a key is the language, byte 255 and the word."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, back, _ = _by_language(batch)
        counts = np.bincount(back, minlength=len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts)], names=["key", "n"])

    counts = _texts(docs).mapInArrow(lambda batches: _each(batches, count), "key binary, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def _vocabulary(words: DataFrame) -> Index:
    """Slots of the frequent words (key)."""

    def hashes(rows: pa.Table):
        return _word_hashes(rows.column("key").to_pylist())

    def store(rows: pa.Table, order: np.ndarray):
        return rows.column("key").combine_chunks().cast(pa.large_binary()).take(pa.array(order))

    return index(words.select("key"), hashes, store, "vocabulary")


def _same_words(keys: pa.Array):
    return lambda stored, slots, rows: pc.equal(stored.take(pa.array(slots)), keys.take(pa.array(rows))).to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, vocabulary: Index) -> DataFrame:
    """(ids): arrays of word numbers from 1 as bytes; 0 between pieces and for words without number."""
    rows, blocks = _texts(docs), list(range(0, 1 << vocabulary.bits, max(1, hashindex.BLOCK // hashindex.PART)))
    held = None
    for k, (_, sent) in enumerate(vocabulary.blocks()):
        first, last = k == 0, k == len(blocks) - 1

        def run(batch: pa.RecordBatch, sent=sent, first=first, last=last) -> pa.RecordBatch:
            keys, back, new = _by_language(batch)
            one, two = _word_hashes(keys)
            numbers = sent.value.find(one, two, _same_words(pa.array(keys, pa.large_binary()))) + 1
            ids = numbers[back].astype(np.uint32) if len(keys) else np.zeros(0, np.uint32)
            if not first:
                ids = np.maximum(ids, np.frombuffer(batch.column("ids")[0].as_py(), np.uint32))
            if not last:
                # the texts of a slice and their ids stay together: the first row has the ids
                blobs = pa.array([ids.tobytes()] + [None] * (batch.num_rows - 1), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array([batch.select(["lang", "text"]).to_pylist()], _LISTED), blobs[:1]], names=["rows", "ids"])
            at = np.flatnonzero(new)
            ids = np.insert(ids, at, 0)
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
            return pa.RecordBatch.from_arrays([pa.array([ids[keep].astype("<u4").tobytes()], pa.binary())], names=["ids"])

        def start(batches, run=run):
            return _each(batches, run)

        def again(batches, run=run):
            for batch in batches:
                for i in range(batch.num_rows):
                    rows_ = pa.RecordBatch.from_pylist(batch.column("rows")[i].as_py(), pa.schema([("lang", pa.string()), ("text", pa.string())]))
                    ids = pa.array([batch.column("ids")[i].as_py()] * rows_.num_rows, pa.binary())
                    yield run(pa.RecordBatch.from_arrays([*rows_.columns, ids], names=["lang", "text", "ids"]))

        schema = "ids binary" if last else "rows array<struct<lang:string,text:string>>, ids binary"
        new_rows = cut(rows.mapInArrow(start if first else again, schema), "ids")
        discard(*([held] if held is not None else []))
        rows = held = new_rows
    return held


_LISTED = pa.list_(pa.struct([("lang", pa.string()), ("text", pa.string())]))


def _phrases(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where n known words stand together, and their ids as two 64-bit numbers."""
    known = ids != 0
    fits = known[: len(ids) - n + 1].copy() if len(ids) >= n else np.zeros(0, bool)
    for k in range(1, n):
        fits &= known[k : len(ids) - n + 1 + k]
    at = np.flatnonzero(fits)
    return (at, *_packed([ids[at + k] for k in range(n)]))


def _packed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Up to four ids as a high and a low number."""
    full = [p.astype(np.uint64) for p in parts] + [np.zeros(len(parts[0]), np.uint64)] * (LONGEST - len(parts))
    return full[0] << np.uint64(32) | full[1], full[2] << np.uint64(32) | full[3]


def _unpacked(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64(0xFFFFFFFF)
    return [high >> np.uint64(32), high & mask, low >> np.uint64(32), low & mask]


def _find(block, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    one, two = pair_hashes(high, low)
    return block.find(one, two, lambda stored, slots, rows: (stored[0][slots] == high[rows]) & (stored[1][slots] == low[rows]))


def _covers(block, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return block.covers(pair_hashes(high, low)[0])


def _sums(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """(high, low, n) of the distinct pairs."""
    order = np.lexsort((low, high)) if low.any() else np.argsort(high)
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    columns = [high[at].view(np.int64), low[at].view(np.int64), np.diff(np.append(at, len(high))).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["high", "low", "n"])


def candidates(ids: DataFrame, n: int, shorter: Index | None, least: int) -> DataFrame:
    """(high, low) of phrases of ``n`` words that may occur ``least`` times: of those whose parts may."""
    found = None
    for sent in [None] if shorter is None else (s for _, s in shorter.blocks()):

        def sieve(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            out = []
            for blob in batch.column("ids").to_pylist():
                held = np.frombuffer(blob, "<u4")
                at, high, low = _phrases(held, n)
                if sent is not None:
                    block = sent.value
                    where, h, lo = _phrases(held, n - 1)
                    member = np.zeros(len(held) + 1, bool)
                    member[where] = _find(block, h, lo) >= 0
                    other = np.zeros(len(held) + 1, bool)  # in a block that another pass holds
                    other[where] = ~_covers(block, h, lo)
                    safe = member[at] & (member[at + 1] | other[at + 1])
                    high, low = high[safe], low[safe]
                out.append((high, low))
            return _sums(*(np.concatenate(c) for c in zip(*out))) if out else _sums(*[np.zeros(0, np.uint64)] * 2)

        def run(batches, sieve=sieve):
            for batch in batches:
                with paused_collection():
                    out = sieve(batch)
                yield out
            give_back()

        sums = ids.mapInArrow(run, "high long, low long, n long")
        found = sums if found is None else found.unionByName(sums)
    total = found.groupBy("high", "low").agg(F.sum("n").alias("n"))
    return cut(total.where(F.col("n") >= least).select("high", "low"), f"candidates-{n}")


def _phrase_index(phrases: DataFrame) -> Index:
    def pairs(rows: pa.Table):
        return (rows.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))

    def store(rows: pa.Table, order: np.ndarray):
        high, low = pairs(rows)
        return high[order], low[order]

    return index(phrases, lambda rows: pair_hashes(*pairs(rows)), store, "phrases")


def counts(ids: DataFrame, phrases: Index) -> DataFrame:
    """(part, counts): occurrences of the phrases of each part, by slot, as bytes of 64-bit numbers."""
    found = None
    for numbers, sent in phrases.blocks():
        first = min((phrases.bases[p] for p in numbers if p in phrases.bases), default=0)
        sizes = [(p, phrases.bases[p] - first, phrases.sizes[p]) for p in numbers if p in phrases.sizes]
        total = sum(s for _, _, s in sizes)

        def run(batches, sent=sent, first=first, sizes=sizes, total=total) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(total, np.int64)
            for batch in batches:
                block = sent.value
                for blob in batch.column("ids").to_pylist():
                    held = np.frombuffer(blob, "<u4")
                    member = None
                    for n in range(1, LONGEST + 1):
                        at, high, low = _phrases(held, n)
                        if member is not None:
                            safe = member[at] & member[at + 1]
                            at, high, low = at[safe], high[safe], low[safe]
                        slots = _find(block, high, low)
                        sums += np.bincount(slots[slots >= 0] - first, minlength=total)
                        # a phrase with a part that is no candidate is none; parts of other blocks are not known
                        member = np.zeros(len(held) + 1, bool)
                        member[at] = (slots >= 0) | ~_covers(block, high, low)
            give_back()
            if sums.any():
                task = TaskContext.get().partitionId()
                rows = [(p, task, sums[a : a + s].tobytes()) for p, a, s in sizes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["part", "task", "counts"]
                )

        arrays = cut(ids.mapInArrow(run, "part int, task long, counts binary"), "arrays")
        summed = tree_sum(arrays)
        found = summed if found is None else found.union(summed)
    return found


def tree_sum(arrays: DataFrame) -> DataFrame:
    """(part, counts): the sums of the arrays (part, task, counts) of each part, FAN at a time."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts"))
        return pa.table({"part": rows.column("part")[:1], "task": rows.column("task")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    while (arrays.agg(F.max("task")).first()[0] or 0) > 0:
        near = arrays.withColumn("task", F.floor(F.col("task") / FAN).cast("long"))
        new = cut(near.groupBy("part", "task").applyInArrow(add, "part int, task long, counts binary"), "arrays")
        discard(arrays)
        arrays = new
    return arrays.select("part", "counts")


_CUTS = [f"{side}{k}" for side in "lr" for k in range(1, LONGEST)]


def cuts(phrases: Index, sums: DataFrame, least: int) -> DataFrame:
    """(high, low, a, l1..l3, r1..r3): frequent phrases of two words or more, with the counts of both sides of each cut."""
    schema = ", ".join(f"{c} long" for c in ("high", "low", "a", *_CUTS))

    def listed(batches) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            for blob, raw in zip(batch.column("blob"), batch.column("counts")):
                high, low = pickle.loads(blob.as_py())[1]
                a = np.frombuffer(raw.as_py(), np.int64)
                keep = (a >= least) & (high & np.uint64(0xFFFFFFFF) != 0)
                columns = [high[keep].view(np.int64), low[keep].view(np.int64), a[keep], *[np.zeros(keep.sum(), np.int64)] * len(_CUTS)]
                whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["high", "low", "a", *_CUTS])
                yield from (whole.slice(k, 1 << 16) for k in range(0, len(whole), 1 << 16))

    stored = cut(phrases.table.join(sums, "part").select("part", "blob", "counts"), "counted")
    rows = stored.mapInArrow(listed, schema)
    spark = sums.sparkSession
    for numbers, sent in phrases.blocks():
        held = {r["part"]: bytes(r["counts"]) for r in sums.where(F.col("part").isin(numbers)).collect()}  # of one block
        by_slot = spark.sparkContext.broadcast((min((phrases.bases[p] for p in held), default=0), b"".join(held[p] for p in sorted(held))))

        def fill(batches, sent=sent, by_slot=by_slot) -> Iterator[pa.RecordBatch]:
            first, raw = by_slot.value
            all_ = np.frombuffer(raw, np.int64)
            for batch in batches:
                block = sent.value
                high, low = (batch.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
                ids = _unpacked(high, low)
                size = sum((p != 0).astype(np.int64) for p in ids)
                out = {c: batch.column(c).to_numpy().copy() for c in _CUTS}
                for n in range(2, LONGEST + 1):
                    of = np.flatnonzero(size == n)
                    for k in range(1, n):
                        for name, part in ((f"l{k}", ids[:k]), (f"r{k}", ids[k:n])):
                            slots = _find(block, *_packed([p[of] for p in part]))
                            out[name][of[slots >= 0]] += all_[slots[slots >= 0] - first]
                columns = [batch.column(c) for c in ("high", "low", "a")] + [pa.array(out[c]) for c in _CUTS]
                yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "a", *_CUTS])

        rows = rows.mapInArrow(fill, schema)
    return cut(rows, "cuts")


def best_cut(a: int, left: list[int], right: list[int]) -> tuple[int, int, int]:
    """(score, l, r) of the cut with the lowest score, ties to the first."""
    scores = [SCALE * a // (x + y) for x, y in zip(left, right)]
    k = scores.index(min(scores))
    return scores[k], left[k], right[k]


def scored(rows: DataFrame) -> DataFrame:
    """(high, low, a, l, r, score) of the rows of ``cuts``."""
    names = ["high", "low", "a", "l", "r", "score"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy()
            left, right = (np.stack([batch.column(f"{side}{k}").to_numpy() for k in range(1, LONGEST)], 1) for side in "lr")
            used = left + right > 0
            if len(a) and a.max() <= (1 << 62) // SCALE:
                score = np.where(used, SCALE * a[:, None] // np.maximum(left + right, 1), np.iinfo(np.int64).max)
                k = score.argmin(axis=1)
                i = np.arange(len(a))
                columns = [left[i, k], right[i, k], score[i, k]]
            else:
                found = [best_cut(x, y[u].tolist(), z[u].tolist()) for x, y, z, u in zip(a.tolist(), left, right, used)]
                columns = [[f[1] for f in found], [f[2] for f in found], [f[0] for f in found]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _inside(rows: DataFrame) -> DataFrame:
    """(high, low, most): phrases inside longer ones, with the count of the most frequent of these."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = (batch.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            ids, a = _unpacked(high, low), batch.column("a").to_numpy()
            size = sum((p != 0).astype(np.int64) for p in ids)
            out = []
            for n in range(3, LONGEST + 1):
                of = size == n
                for m in range(2, n):
                    out += [(*_packed([p[of] for p in ids[k : k + m]]), a[of]) for k in range(n - m + 1)]
            h, lo, most = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(most)], names=["high", "low", "most"])

    held = rows.select("high", "low", "a").mapInArrow(run, "high long, low long, most long")
    return held.groupBy("high", "low").agg(F.max("most").alias("most"))


def _spelled(rows: DataFrame, vocabulary: Index) -> DataFrame:
    """``rows`` with ``lang`` and ``phrase``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    words = [f"w{k}" for k in range(LONGEST)]
    names = rows.columns
    rows = rows.withColumns({w: F.lit(None).cast("binary") for w in words})
    for _, sent in vocabulary.blocks():

        def spell(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = sent.value
                ids = _unpacked(*(batch.column(c).to_numpy().view(np.uint64) for c in ("high", "low")))
                out = []
                for w, ids_ in zip(words, ids):
                    found = batch.column(w).to_pylist()
                    at = ids_.astype(np.int64) - 1
                    for base, slots, stored in block.parts.values():
                        here = np.flatnonzero((at >= base) & (at < base + slots.size)) if slots else ()
                        if len(here):
                            for i, key in zip(here.tolist(), stored.take(pa.array(at[here] - base)).to_pylist()):
                                found[i] = key
                    out.append(pa.array(found, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], names=[*names, *words])

        rows = rows.mapInArrow(spell, fields + "".join(f", {w} binary" for w in words))

    def join(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(w).to_pylist() for w in words))
            split_ = [(k[0].partition(b"\xff")[0], b" ".join(w.partition(b"\xff")[2] for w in k if w is not None)) for k in keys]
            lang, phrase = (pa.array([x[j].decode() for x in split_], pa.string()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lang, phrase], names=[*names, "lang", "phrase"])

    return rows.mapInArrow(join, fields + ", lang string, phrase string")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language of (lang, text)."""
    words = cut(word_counts(docs), "word-counts")
    frequent = cut(words.where(F.col("n") >= least), "frequent")
    vocabulary = _vocabulary(frequent)
    ids = encode(docs, vocabulary)
    levels, last = [], None
    for n in range(2, LONGEST + 1):
        found = candidates(ids, n, last, least)
        levels.append(found)
        if n < LONGEST:
            last = _phrase_index(found)
    single = docs.sparkSession.range(1, vocabulary.size + 1).select(F.shiftleft("id", 32).alias("high"), F.lit(0).cast("long").alias("low"))
    whole = single
    for found in levels:
        whole = whole.union(found)
    phrases = _phrase_index(cut(whole, "all-candidates"))
    sums = cut(counts(ids, phrases), "sums")
    rows = cuts(phrases, sums, least)
    best = scored(rows).join(_inside(rows), ["high", "low"], "left")
    kept = best.where(F.col("most").isNull() | (100 * F.col("most") < SHARE * F.col("a"))).drop("most")
    spelled = cut(_spelled(cut(kept, "kept"), vocabulary), "spelled")
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    placed = cut(numbered(spelled, "place", order, "ranked"), "placed")
    first = placed.groupBy("lang").agg(F.min("place").alias("first"))
    ranked = placed.join(first, "lang").withColumn("rank", F.col("place") - F.col("first") + 1).where(F.col("rank") <= top)
    return ranked.join(_totals(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _totals(words: DataFrame) -> DataFrame:
    """(lang, n) from (key, n)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pa.array([k.partition(b"\xff")[0].decode() for k in batch.column("key").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([langs, batch.column("n")], names=["lang", "n"])

    return words.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases by collocation score."""
    return mine(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM
  (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}),
x AS (SELECT c.lang, c.phrase, c.k, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:cut], ' ') AND l.k = cut
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1 :], ' ') AND r.k = c.k - cut),
s AS (SELECT lang, phrase, k, any_value(a) AS a, arg_min(l, score * 4 + cut) AS l, arg_min(r, score * 4 + cut) AS r, min(score) AS score FROM x GROUP BY 1, 2, 3),
kept AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = s.lang AND d.k > s.k AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * d.a >= {SHARE} * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
