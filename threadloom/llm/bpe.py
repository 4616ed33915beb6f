"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation works on arrays.  Each code point of a batch has a class (with
what must be seen ahead folded in: an apostrophe that begins a contraction, a
white-space character before more white space), and each class is a transition
function over eight states.  Composition of such functions is associative, so
the state before every character comes from a blocked scan: functions are
composed inside blocks, the blocks' totals are scanned in turn, and the states
follow.  State and class tell where a token starts.  The byte slices between
starts are looked up, or merged pair by pair once and cached; their offsets are
kept and the ids decode to those very slices.

The pattern is the one for English contractions, letters, numbers, other
characters and white space that the ``byte_bpe_50k`` vocabulary was made with.

Defined results: null and empty texts have no tokens; texts are independent of
each other and of row order; repeated rows get equal results; of pairs of one rank
the leftmost is merged first; a text is encoded whole, however long; an empty table
gives no rows; other columns pass through, and one named ``tokens`` is replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import bound_batches, map_batches, table

#: Classes of characters.
LETTER, NUMBER, OTHER, SHORT, LONG, MORE_SPACE, LAST_BLANK, LAST_SPACE, RESET = range(9)
#: States: what the token that holds the previous character still takes.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_LEFT, TWO_LEFT, AFTER_BLANK, IN_SPACES = range(8)
#: Pieces of at most this many bytes are merged by repeated scans, longer ones by a heap.
SCAN_BYTES = 48
#: Above every rank.
NONE = 1 << 40
#: Cached pieces of a worker; the cache is emptied when full.
CACHED = 1_000_000

# White_Space of the Unicode character database (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point; white space as LAST_SPACE, apostrophe as OTHER."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    table[WHITE] = LAST_SPACE
    return table


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state]."""
    after = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    for kind, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        after[kind] = inside
        starts[kind, [inside, AFTER_BLANK]] = False
    for kind, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        after[kind] = left
        after[kind, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS
        starts[kind, [IN_OTHERS, AFTER_BLANK]] = False
    after[MORE_SPACE] = IN_SPACES
    starts[MORE_SPACE, IN_SPACES] = False
    after[LAST_BLANK], after[LAST_SPACE], after[RESET] = AFTER_BLANK, FRESH, FRESH
    for kind in (LETTER,):  # what remains of a contraction is letters
        after[kind, ONE_LEFT], after[kind, TWO_LEFT] = FRESH, ONE_LEFT
        starts[kind, [ONE_LEFT, TWO_LEFT]] = False
    return after, starts


AFTER, STARTS = _transitions()
_FLAT = AFTER.reshape(-1)


def scan_states(kinds: np.ndarray, block: int = 64) -> np.ndarray:
    """The state before each character, starting from FRESH."""
    return _scan(AFTER[kinds], block)


def _scan(functions: np.ndarray, block: int) -> np.ndarray:
    """States before each of the functions (n x 8), applied in order from FRESH."""
    n = len(functions)
    if n <= block:
        states, now = np.empty(n, np.uint8), FRESH
        for i in range(n):
            states[i] = now
            now = functions[i, now]
        return states
    blocks = -(-n // block)
    padded = np.empty((blocks * block, 8), np.uint8)
    padded[:n] = functions
    padded[n:] = np.arange(8)
    padded = padded.reshape(blocks, block, 8)
    total = padded[:, 0]
    rows = np.arange(blocks)[:, None]
    for i in range(1, block):
        total = padded[rows, i, total]
    now = _scan(total, block)
    states = np.empty((blocks, block), np.uint8)
    flat = np.arange(blocks)
    for i in range(block):
        states[:, i] = now
        now = padded[flat, i, now]
    return states.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, the byte offsets of token starts (with the end), and tokens of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    raw = joined.encode("utf-8")
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return b"", np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    kinds = _classes()[points]
    first = np.zeros(n + 1, bool)  # where a text begins
    first[np.cumsum(lengths) - lengths] = True
    first[n] = True
    space = kinds == LAST_SPACE
    ends = first[1:]
    more = space & (ends | np.append(space[1:], True))
    kinds[space & (points == 0x20)] = LAST_BLANK
    kinds[more] = MORE_SPACE
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        wide = np.append(points, [0, 0, 0])
        one = wide[quotes + 1] * ~first[np.minimum(quotes + 1, n)]
        two = wide[quotes + 2] * ~(first[np.minimum(quotes + 1, n)] | first[np.minimum(quotes + 2, n)])
        kinds[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = (one << 8) | two * (two < 256)
        kinds[quotes[np.isin(pairs, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    states = _scan_texts(kinds, first)
    starts = STARTS[kinds, states]
    starts |= first[:n]
    widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.cumsum(widths, dtype=np.int64) - widths
    offsets = np.append(at[starts], len(raw))
    counts = np.add.reduceat(np.append(starts, False).astype(np.int64), np.minimum(np.cumsum(lengths) - lengths, n))
    counts[lengths == 0] = 0
    return raw, offsets, counts


def _scan_texts(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """States with each text begun afresh: a constant function stands before its first character."""
    functions = AFTER[kinds]
    opens = np.flatnonzero(first[:-1])
    functions[opens] = AFTER[kinds[opens], FRESH][:, None]
    states = _scan(functions, 64)
    states[opens] = FRESH
    return states


class Encoder:
    """Ranks of a vocabulary file, with a cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.written = {v: str(v) for v in self.tokens}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        held = self.cache.get(raw)
        if held is None:
            whole = self.ranks.get(raw)
            held = (whole,) if whole is not None else tuple(self._merge(raw))
            if len(self.cache) >= CACHED:
                self.cache.clear()
            if len(raw) <= 256:
                self.cache[raw] = held
        return held

    def _merge(self, raw: bytes) -> list[int]:
        if len(raw) > SCAN_BYTES:
            return self._merge_long(raw)
        find, n = self.ranks.get, len(raw)
        cuts = list(range(n + 1))
        pairs = [find(raw[i : i + 2], NONE) for i in range(n - 1)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = find(raw[cuts[i] : cuts[i + 2]], NONE)
            if i:
                pairs[i - 1] = find(raw[cuts[i - 1] : cuts[i + 1]], NONE)
        return [self.ranks[raw[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, over a linked list."""
        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(raw[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def write(self, ids) -> str:
        """Decimal ids joined by spaces."""
        return " ".join(map(self.written.__getitem__, ids))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_batch(texts: list[str | None], path: str) -> list[list[int]]:
    """The ids of each text."""
    coder = encoder(path)
    texts = [t or "" for t in texts]
    raw, offsets, counts = boundaries(texts)
    cuts = offsets.tolist()
    cache, piece = coder.cache, coder.piece
    found = [cache.get(p) or piece(p) for p in map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))]
    at = np.append(0, np.cumsum(counts)).tolist()
    return [list(chain.from_iterable(found[a:b])) for a, b in zip(at, at[1:])]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``tokens`` (array of ids); a column of that name is replaced."""
    bound_batches(df.sparkSession)
    passed = df.select(*[c for c in df.columns if c != "tokens"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.schema)
    names = passed.columns

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in names} | {"tokens": encode_batch(batch.column(text).to_pylist(), path)}

    return map_batches(passed, run, f"{schema}, tokens array<int>")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests."""
    bound_batches(spark)
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> dict:
        coder = encoder(path)
        out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in encode_batch(batch.column("text").to_pylist(), path):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(coder.write(ids).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_batches(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
