"""Best-fit packing of token sequences, planned over a histogram of lengths.

Texts become pieces of at most ``size`` tokens.  The driver gets one count for
each length (never more than ``size`` rows), runs best fit, longest first, on
counts instead of pieces, and keeps the result as runs: so many pieces of this
length, from that rank on, go to those sequences at this offset.  Pieces take
their planned slot by rank within their length.  Ranks come from counts by
(length, salt), so a length that many pieces share is numbered by many tasks.

Defined results: null and empty texts are one piece holding only the end id;
repeated rows are packed one by one; a text of any length is read whole and cut
into pieces; pieces of equal length are ranked by salt, id and number, and ties
among them are interchangeable; an empty table gives no rows; ``pack`` passes other
columns through and replaces those named ``sequence_id`` and ``offset``.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, cut, map_batches, table

SIZE = 2048
END_ID = 0
#: Salts of a length: tasks that can number the pieces of one length.
SALTS = 256
#: Cached parts of a worker (about 200 bytes each), kept in two generations of this size: a full
#: one becomes the old one, from which parts in use come back.
CACHED = 400_000
#: New parts given to the tokenizer at once.
LEARNED = 2000


class WordTokenizer:
    """The word tokenizer, asked once for each part that its pre-tokenizer makes.

    Texts of ASCII and Latin-1 letters are lower-cased and cut by the
    pre-tokenizer's own pattern, which on such characters needs no Unicode classes;
    distinct parts go to the library's model without its normaliser, which would
    leave them as they are.  Other texts are cut at blanks, where the pre-tokenizer
    always cuts; words with other characters, or with the sign of a special token,
    go through the whole tokenizer.
    """

    #: Plain texts, and how they are cut after lower-casing (the tokenizer's pattern; fixed value).
    PLAIN = re.compile("[ -~\t\n\rÀ-ÖØ-öø-ÿ]*")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
    BLANKS = re.compile("[ \t\n\r]+")
    #: Marks a word for the whole tokenizer.
    ODD = "\0"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)  # the same model behind another front
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        #: Whether a token ends a part: its vocabulary entry says so.
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [self._cut(t or "") for t in texts]
        if len(self.parts) > CACHED:
            self.old, self.parts = self.parts, {}
        parts, old = self.parts, self.old
        new = set().union(*cut) - parts.keys()
        if old:
            known = new & old.keys()
            parts.update(zip(known, map(old.__getitem__, known)))
            new -= known
        self._learn(list(new))
        return [b"".join(map(parts.__getitem__, ps)) for ps in cut]

    def _cut(self, text: str) -> list[str]:
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return self.PARTS.findall(text.lower())
        out: list[str] = []
        for word in self.BLANKS.split(text):
            if self.PLAIN.fullmatch(word) and "<|" not in word:
                out += self.PARTS.findall(word.lower())
            else:
                out.append(self.ODD + word)
        return out

    def _learn(self, new: list[str]) -> None:
        odd = [p for p in new if p[0] == self.ODD]
        plain = [p for p in new if p[0] != self.ODD] if odd else new
        for at in range(0, len(odd), LEARNED):
            some = odd[at : at + LEARNED]
            for part, found in zip(some, self.tokenizer.encode_batch([p[1:] for p in some], add_special_tokens=False)):
                self.parts[part] = np.array(found.ids, "<u4").tobytes()
        for at in range(0, len(plain), LEARNED):
            some = plain[at : at + LEARNED]
            (found,) = self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the vocabulary has characters without a form that ends a word")
            raw = ids.tobytes()
            self.parts.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends))))


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(df: DataFrame, path: str, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every document.

    A document is its ids and then the end id; only longer ones are cut.
    """
    bound_batches(df.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        out = defaultdict(list)
        for doc_id, ids in zip(
            batch.column("doc_id").to_pylist(), tokenizer(path).encode(batch.column("text").to_pylist())
        ):
            ids += END_ID.to_bytes(4, "little")
            for number, start in enumerate(range(0, len(ids) // 4, size)):
                part = ids[4 * start : 4 * (start + size)]
                out["doc_id"].append(doc_id)
                out["piece"].append(number)
                out["start"].append(start)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                if with_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int64))
        return out

    ids = ", ids array<long>" if with_ids else ""
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}"
    return map_batches(df.select(F.col("doc_id").cast("long"), "text"), run, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best fit over counts: for each length, runs (first rank, first sequence, per sequence, offset).

    Sequences of equal free space are kept as ranges of numbers.  The pieces of
    a length go to the tightest open sequences that take them, as many in each
    as fit, and then to new ones.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first sequence, how many)]
    spaces: list[int] = []  # the keys of free, sorted
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank, own = counts[length], 0, []
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, many = size, opened, -(-left // (size // length))
                opened += many
            each = space // length
            full = min(many, left // each)
            if full:
                own.append((rank, first, each, size - space))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = many - full
            if rest and left and left < each:  # the last sequence takes fewer
                own.append((rank, first + full, each, size - space))
                put(space - left * length, first + full, 1)
                rest, full, left = rest - 1, full + 1, 0
            put(space, first + full, rest)
        runs[length] = own
    return runs


def pack(parts: DataFrame, size: int = SIZE, salts: int = SALTS, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``parts`` (a stored table with ``length``) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    parts = parts.drop("sequence_id", "offset")
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    salted = parts.withColumn("__salt", salt)
    each = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most size * salts rows
    starts = each.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = spark.sparkContext.broadcast(
        {k: (np.array([r[0] for r in v], np.int64), np.array(v, np.int64)) for k, v in plan(counts, size).items()}
    )
    within = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1).join(starts, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__from")).drop("__salt", "__from")
    names = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)

    def place(batch: pa.RecordBatch) -> dict:
        lengths = batch.column("length").to_numpy()
        ranks = batch.column("__rank").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            firsts, runs = held.value[int(length)]
            here = np.flatnonzero(lengths == length)
            run = runs[np.searchsorted(firsts, ranks[here], "right") - 1]
            nth = ranks[here] - run[:, 0]
            sequence[here] = run[:, 1] + nth // run[:, 2]
            offset[here] = run[:, 3] + nth % run[:, 2] * length
        return {c: batch.column(c) for c in names} | {"sequence_id": sequence, "offset": offset}

    return map_batches(ranked.select(*names, "__rank"), place, f"{schema}, sequence_id long, offset long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(cut(pieces(docs, path or vocabulary_path(), with_ids=False), "op9-pieces"))
