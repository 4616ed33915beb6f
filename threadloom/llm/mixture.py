"""Mixture-controlled packing: deficit round-robin over source queues.

Each source's tokens, document after document, are a queue, cut into chunks of
``GRAIN`` tokens.  Slots of windows are served in turn, and each takes a chunk from the
queue with the largest deficit, in the sense of round-robin with weights: queue q is
served its chunk x when its turn (2x + 1) / weight(q) is the smallest one open, ties to
the first queue, and queues that ran dry are passed over.  So every window holds the
target proportions up to a chunk for each queue, and what a queue lacks in one window
is due first in the next.

The rule has a closed form: the slot of a chunk is the number of chunks, over all
queues, whose turn comes before.  Any task therefore knows the deficits at the window
where its rows begin from the rows' places in their queues, and carries nothing over
from other tasks; ids never move.  Places come from sums by (source, partition), summed
on by ranges, so a source that holds a third of the rows is placed by many tasks.

Chunks fill whole windows; what is left of every queue (less than a chunk) follows as
one stream, and the last, partly filled window becomes sequences whose lengths are
powers of two, which need no padding.  So there is no padding at all.

The target proportions are weights by source; sources without one weigh as much as
they hold.  Without named weight, sources below 1/``QUEUES`` of the tokens share one
queue, so there are at most ``QUEUES`` + 1 of those, whatever the number of sources.

Defined results: null and empty texts are one token, the end id; a null source is the
empty one; texts are read whole, however long; repeated rows are packed one by one, and
rows of a queue stand in the order of its sources and of the stored partitions; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, cut, give_back, paused_collection, slices, table
from threadloom.llm.ranges import running

SIZE = 2048
END_ID = 1
#: Tokens of a chunk; divides ``SIZE``.
GRAIN = 128
#: Sources below this part of all tokens share a queue.
QUEUES = 1024
#: Weights are whole numbers of this sum, about, so that products stay below 2^63.
WEIGHT = 1 << 20
#: Rows (source, partition) up to which the table of places is sent to every task; beyond, it is joined by exchange.
SENT = 1 << 18
#: Rows and bytes of text that are tokenized at once: the more, the fewer distinct units each has.
ROWS, BYTES = 4096, 8 << 20
#: Cached units of a worker, kept in two generations of this size, and bytes of a unit that is kept.
CACHED, KEPT_BYTES = 400_000, 64


BLANK, SPACE, LETTER, STOP, OTHER = range(5)
#: A word that the tokenizer's pattern takes whole: ASCII and Latin-1 letters, as UTF-8.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[0x09:0x0E], kinds[0x20] = SPACE, BLANK
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    kinds[list(b".,;:!?")] = STOP
    return kinds


def _starts() -> np.ndarray:
    """Whether a unit begins at a byte, by its kind and those before and after, as 25 * before + 5 * own + after."""
    before, own, after = np.unravel_index(np.arange(125), (5, 5, 5))
    space, space_before, space_after = own <= SPACE, before <= SPACE, after <= SPACE
    stop = (own == STOP) & (before == LETTER) | (own == LETTER) & (before == STOP)
    return np.where(space, ~space_before | ~space_after, (before == SPACE) | stop)


_KINDS, _STARTS = _kinds(), _starts()


class UnitTokenizer:
    """The byte-level tokenizer, asked once for each unit that its pattern never looks beyond.

    A unit is a run without ASCII white space and the blank before it, or a run of white
    space; where stops follow a letter, or a letter stops, another begins.  The pattern's
    matches lie inside units, whatever stands around them.  Units are found on the bytes
    of a whole batch and made distinct, new ones go to the library in one text, whose ids
    are dealt out by the tokens' bytes.  Texts with other white space or the sign of a
    special token go to the library whole.
    """

    #: What sends a text to the library whole: white space beyond ASCII as UTF-8 (fixed values).
    WIDE = {0xC2: {b"\x85", b"\xa0"}, 0xE1: {b"\x9a\x80"}, 0xE3: {b"\x80\x80"}, 0xE2: {bytes([0x80, c]) for c in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)} | {b"\x81\x9f"}}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: The same model for words that its pattern takes whole, set apart by line feeds.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of a token: its name has a character for each.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.dtype = np.dtype("<u2" if len(self.widths) <= 1 << 16 else "<u4")
        self.units: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = self._whole(texts)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        found = self._plain(pa.concat_arrays([plain]))
        for i in np.flatnonzero(whole).tolist():
            found[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
        return found

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and offsets with the end."""
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
        return raw, at - at[0] if len(at) else np.zeros(1, np.int64)

    def _whole(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for sign in self.special:
            found |= pc.match_substring(texts, sign).to_numpy(zero_copy_only=False)
        raw, offsets = self._bytes(texts)
        for lead, rest in self.WIDE.items():
            at = np.flatnonzero(raw == lead)
            for tail in rest:
                hit = at[at + len(tail) < len(raw)]
                for k, byte in enumerate(tail):
                    hit = hit[raw[hit + 1 + k] == byte]
                found[np.searchsorted(offsets, hit, "right") - 1] = True
        return found

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        raw, offsets = self._bytes(texts)
        n = len(raw)
        if not n:
            return [np.zeros(0, self.dtype)] * len(texts)
        kinds = _KINDS[raw]
        code = 5 * kinds
        code[1:] += 25 * kinds[:-1]
        code[:-1] += kinds[1:]
        last = offsets[1:][np.diff(offsets) > 0] - 1  # a text's end is like white space to come
        code[last] -= code[last] % 5 - SPACE
        start = _STARTS[code]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        cuts = np.flatnonzero(start)
        bounds = pa.py_buffer(np.append(cuts, n).astype(np.int32 if n < 1 << 31 else np.int64))
        kind = pa.binary() if n < 1 << 31 else pa.large_binary()
        units = pa.Array.from_buffers(kind, len(cuts), [None, bounds, pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        parts = self._ids(units.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(parts), self.dtype)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        which = units.indices.to_numpy()
        many = lengths[which]
        ends = np.cumsum(many)
        take = np.arange(int(ends[-1])) + np.repeat(starts[which] - (ends - many), many)
        ids = flat[take]
        docs = np.append(0, ends)[np.searchsorted(cuts, offsets)]
        return [ids[a:b] for a, b in zip(docs[:-1].tolist(), docs[1:].tolist())]

    def _ids(self, units: list[bytes]) -> list[bytes]:
        if len(self.units) > CACHED:
            self.old, self.units = self.units, {}
        held, old = self.units, self.old
        new = list(itertools.filterfalse(held.__contains__, units))
        if old:
            known = list(filter(old.__contains__, new))
            held.update(zip(known, map(old.__getitem__, known)))
            new = list(itertools.filterfalse(held.__contains__, new))
        if new:
            self._learn(new)
        found = list(map(held.__getitem__, units))
        for unit in new:
            if len(unit) > KEPT_BYTES:
                del held[unit]
        return found

    def _learn(self, units: list[bytes]) -> None:
        """Ids of new units: plain words straight from the model, other ones from the whole tokenizer."""
        words = list(filter(_WORD, units))
        if words:
            self._store(words, words, self.model, b"\n")
        rest = set(units).difference(words) if len(words) < len(units) else ()
        lone = [u for u in rest if u.isspace()]
        for unit in lone:
            self.units[unit] = np.array(self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
        rest = [u for u in rest if u not in self.units]
        if rest:
            # what doesn't begin with a blank comes after a line feed, a token of its own
            self._store(rest, [u if u[0] == 0x20 else b"\n" + u for u in rest], self.tokenizer, b"")

    def _store(self, units: list[bytes], written: list[bytes], coder, between: bytes) -> None:
        (got,) = coder.encode_batch_fast([between.join(written).decode()], add_special_tokens=False)
        ids = np.array(got.ids, self.dtype)
        at = np.append(0, np.cumsum(self.widths[ids]))
        ends = np.cumsum(np.fromiter(map(len, written), np.int64, len(written)))
        begins = ends - np.fromiter(map(len, units), np.int64, len(units))
        a, b = np.searchsorted(at, begins), np.searchsorted(at, ends)
        if not (np.array_equal(at[a], begins) and np.array_equal(at[b], ends)):
            raise ValueError("a token of this vocabulary reaches over a blank or line feed")
        raw, width = ids.tobytes(), self.dtype.itemsize
        self.units.update(zip(units, map(raw.__getitem__, map(slice, (width * a).tolist(), (width * b).tolist()))))


@functools.cache
def tokenizer(path: str) -> UnitTokenizer:
    return UnitTokenizer(path)


def tokens(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n, part, at, ids) for (doc_id, source, text): ids with the end id, and where they begin among
    those of their source in the task ``part``.  To be stored, as ``part`` and ``at`` belong to this run."""
    bound_batches(df.sparkSession, ROWS)
    schema = "doc_id long, source string, n long, part int, at long, ids binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, ends = tokenizer(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch, BYTES):
                with paused_collection():
                    found = coder.encode(some.column("text"))
                    sources = some.column("source").to_pylist()
                    n, at = np.fromiter(map(len, found), np.int64, len(found)) + 1, []
                    for source, more in zip(sources, n.tolist()):
                        at.append(ends.get(source, 0))
                        ends[source] = at[-1] + more
                    last = np.array([END_ID], coder.dtype).tobytes()
                    columns = [
                        some.column("doc_id"), some.column("source"), pa.array(n), pa.array(np.full(len(n), part, np.int32)),
                        pa.array(at, pa.int64()), pa.array([x.tobytes() + last for x in found], pa.binary()),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "n", "part", "at", "ids"])
        give_back()

    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text").mapInArrow(run, schema)


class Plan:
    """Where a place of a queue lies in the sequences: weights, chunks and leftovers of at most QUEUES + 1 queues."""

    def __init__(self, totals: list[int], weights: list[float], size: int = SIZE, grain: int = GRAIN):
        self.size, self.grain = size, grain
        self.chunks = np.array(totals, np.int64) // grain
        sum_ = sum(weights) or 1
        self.weights = np.array([max(1, round(w / sum_ * WEIGHT)) for w in weights], np.int64)
        left = np.array(totals, np.int64) % grain
        self.after = int(self.chunks.sum()) * grain + np.cumsum(left) - left
        self.tokens = int(sum(totals))
        self.last = self.tokens // size * size  # where the partly filled window begins
        rest, at, self.ends = self.tokens - self.last, self.last, []
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                self.ends.append(at)

    def slots(self, queue: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """How many chunks have their turn before: the slot of each."""
        before = np.zeros(len(queue), np.int64)
        turn, own = 2 * chunk + 1, self.weights[queue]
        for q in np.flatnonzero(self.chunks):
            # chunks x of q with (2x + 1) / weight(q) < turn / own, or equal if q comes first
            earlier = (turn * self.weights[q] + own - (q >= queue)) // (2 * own)
            before += np.minimum(earlier, self.chunks[q])
        return before

    def places(self, queue: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Where chunks, the last ones of a queue that aren't whole included, begin in the stream of all sequences."""
        out = self.after[queue]
        full = chunk < self.chunks[queue]
        out[full] = self.slots(queue[full], chunk[full]) * self.grain
        return out

    def cut(self, place: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length) of what lies at ``place``."""
        while length:
            if place < self.last:
                sequence, offset = divmod(place, self.size)
                room = self.size - offset
            else:
                k = next(k for k, e in enumerate(self.ends) if place < e)
                begin = self.ends[k - 1] if k else self.last
                sequence, offset, room = self.last // self.size + k, place - begin, self.ends[k] - place
            yield sequence, offset, min(room, length)
            place, length = place + min(room, length), length - min(room, length)


def plan(sums: DataFrame, mixture: Mapping[str, float] | None = None) -> tuple[Plan, DataFrame]:
    """The plan for token sums (source, part, n), and (source, part, queue, base): where a queue continues."""
    totals = cut(sums.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    all_ = totals.agg(F.sum("n")).first()[0] or 0
    mixture = dict(mixture or {})
    # at most QUEUES sources have such a part of the whole
    large = totals.where((F.col("n") * QUEUES >= all_) | F.col("source").isin(list(mixture)))
    queues = [(r["source"], r["n"]) for r in large.orderBy("source").collect()]
    sizes = [all_ - sum(n for _, n in queues)] + [n for _, n in queues]
    weights = [float(sizes[0])] + [n if s not in mixture else mixture[s] * all_ for s, n in queues]
    numbers = sums.sparkSession.createDataFrame([(s, k + 1) for k, (s, _) in enumerate(queues)], "source string, queue int")
    held = sums.join(F.broadcast(numbers), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(0)))
    placed = running(held, "n", "before", ["queue", "source", "part"], "places")
    starts = np.cumsum([0, *sizes]).tolist()
    begin = sums.sparkSession.createDataFrame(list(enumerate(starts[:-1])), "queue int, start long")
    places = placed.join(F.broadcast(begin), "queue").select("source", "part", "queue", (F.col("before") - F.col("start")).alias("base"))
    return Plan(sizes, weights), places


def pack(rows: DataFrame, mixture: Mapping[str, float] | None = None, width: int = 2) -> DataFrame:
    """The pieces of ``rows`` (as from ``tokens``, stored), in sequences that keep to the mixture; ``width`` bytes an id."""
    sums = cut(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "sums")
    layout, places = plan(sums, mixture)
    few = sums.limit(SENT + 1).count() <= SENT
    placed = rows.join(F.broadcast(places) if few else places, ["source", "part"])
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("at")).alias("begin"), "n", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                with paused_collection():
                    columns = [pa.array(c, pa.int64()) for c in _pieces(some, layout, width)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _pieces(rows: pa.RecordBatch, layout: Plan, width: int) -> list:
    queue, begin, n = (rows.column(c).to_numpy() for c in ("queue", "begin", "n"))
    grain, size = layout.grain, layout.size
    low, high = begin // grain, (begin + n - 1) // grain
    many = high - low + 1
    doc = np.repeat(np.arange(len(n)), many)
    chunk = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    a = np.maximum(begin[doc], chunk * grain)
    length = np.minimum(begin[doc] + n[doc], (chunk + 1) * grain) - a
    place = layout.places(queue[doc].astype(np.int64), chunk) + a - chunk * grain
    sequence, offset, start = place // size, place % size, a - begin[doc]
    odd = (place + length > layout.last) | (offset + length > size)
    if odd.any():
        more = [(d, s + at, *x) for d, s, p, m in zip(doc[odd].tolist(), start[odd].tolist(), place[odd].tolist(), length[odd].tolist()) for at, x in _steps(layout.cut(p, m))]
        extra = np.array(more, np.int64).T
        doc, start, sequence, offset, length = (
            np.concatenate([x[~odd], y]) for x, y in zip((doc, start, sequence, offset, length), extra)
        )
        order = np.lexsort((start, doc))
        doc, start, sequence, offset, length = (x[order] for x in (doc, start, sequence, offset, length))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + length[:-1])
    first = np.flatnonzero(new)
    length = np.add.reduceat(length, first) if len(first) else length
    doc, start, sequence, offset = (x[first] for x in (doc, start, sequence, offset))
    kind = np.dtype(f"<u{width}")
    wide = [memoryview(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in rows.column("ids").to_pylist()]
    crc = [zlib.crc32(wide[d][4 * s : 4 * (s + m)]) for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())]
    return [rows.column("doc_id").take(pa.array(doc)), start, length, crc, n[doc], sequence, offset]


def _steps(parts: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, tuple[int, int, int]]]:
    at = 0
    for part in parts:
        yield at, part
        at += part[2]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_mixture_packing(spark: SparkSession, sf_dir: str, path: str | None = None, mixture: Mapping[str, float] | None = None) -> DataFrame:
    """All documents packed by source, in the proportions that the sources have."""
    path = path or vocabulary_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(cut(tokens(docs, path), "op11-tokens"), mixture, tokenizer(path).dtype.itemsize)
