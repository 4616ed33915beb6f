"""Quality rules: word counts, and repetition found by suffix arrays.

Words are runs of characters other than space and \\t to \\r.  For each text a
suffix array over its words is built by prefix doubling, all texts of an Arrow
batch at once: a word's symbol is (text, word), so no suffix of one text equals
that of another.  Only suffixes whose prefix still occurs elsewhere are sorted
again in the next round; the others keep their place in the order of all.  Longest common prefixes of neighbours in the array
bound the LCP intervals; a suffix's deepest interval is as deep as the larger of
its two neighbouring values, and the union of those prefixes is the union of the
maximal repeated substrings.  A text is rejected when repeats of at least
``min_repeat`` words cover more than ``max_covered`` of its words, or when one
repeat is longer than ``max_repeat`` words.

Defined results: null and empty texts have no words and fail the base rule;
repeated rows are judged alike; ids and other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import bound_batches, map_batches, paused_collection, slices, table

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Words of the shortest repeat that counts: a power of two, as ranks double.
MIN_REPEAT = 8
#: Share of words in such repeats, in percent, and words of the longest repeat.
MAX_COVERED, MAX_REPEAT = 50, 100
MIN_WORDS = 50
MAX_REPEAT_WORDS = 50

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long"
)


def _rank(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the keys, and how often each row's key occurs."""
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    return rank, count[rank]


class Repeats:
    """Suffix order and longest common prefixes of many word sequences."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, n_owners: int, min_repeat: int = MIN_REPEAT):
        self.n, self.owner, self.n_owners, self.min_repeat = len(words), owner, n_owners, min_repeat
        n = self.n
        symbols = owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        _, dense, count = np.unique(symbols, return_inverse=True, return_counts=True)
        # Suffixes ordered before each one; a suffix alone keeps its place, tied ones share the first.
        place = (np.cumsum(count) - count)[dense]
        tied = count[dense] > 1
        # At each level the place of a suffix whose prefix occurs elsewhere, or -1 - position; in 32 bits if they hold it.
        small = np.int32 if n < 1 << 31 else np.int64
        self.levels: list[tuple[int, np.ndarray]] = [(1, np.where(tied, place, -1 - np.arange(n, dtype=np.int64)).astype(small))]
        active = np.flatnonzero(tied)
        repeated = np.zeros(0, np.int64)
        length = 1
        while len(active):
            if length == min_repeat:
                repeated = active
            follow = active + length
            inside = follow < n
            second = np.full(len(active), -1, np.int64)
            second[inside] = place[follow[inside]]
            keys, dense, count = np.unique(place[active] * (n + 1) + second + 1, return_inverse=True, return_counts=True)
            before, first = np.cumsum(count) - count, keys // (n + 1)
            new = np.append(True, first[1:] != first[:-1])
            place[active] = (first + before - np.maximum.accumulate(np.where(new, before, 0)))[dense]
            active, length = active[count[dense] > 1], length * 2
            full = -1 - np.arange(n, dtype=small)
            full[active] = place[active]
            self.levels.append((length, full))
        self.order = repeated[np.argsort(place[repeated], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b begin with alike."""
        total = np.zeros(len(a), np.int64)
        for length, full in reversed(self.levels):
            i, j = a + total, b + total
            ok = (i < self.n) & (j < self.n)
            same = np.zeros(len(a), bool)
            x = full[i[ok]]
            same[ok] = (x == full[j[ok]]) & (x >= 0)
            total[same] += length
        return total

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the suffixes in LCP intervals of min_repeat or more, and their depths."""
        if len(self.order) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lcp = self.common(self.order[:-1], self.order[1:])
        depth = np.maximum(np.append(0, lcp), np.append(lcp, 0))
        deep = depth >= self.min_repeat
        return self.order[deep], depth[deep]

    def covered(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Words of each owner in the union of the spans."""
        step = np.zeros(self.n + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + lengths, -1)
        inside = np.cumsum(step[:-1]) > 0
        return np.bincount(self.owner[inside], minlength=self.n_owners)

    def windows_of_three(self) -> np.ndarray:
        """Starts of three-word windows that occur twice or more."""
        two = next((full for length, full in self.levels if length == 2), None)
        if two is None:
            return np.zeros(0, np.int64)
        one = self.levels[0][1]
        starts = np.flatnonzero(two[:-2] >= 0) if self.n > 2 else np.zeros(0, np.int64)
        starts = starts[one[starts + 2] >= 0]
        _, count = _rank(two[starts].astype(np.int64) * (self.n + 1) + one[starts + 2])
        return starts[count > 1]


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of every text."""
    k = len(texts)
    out = {name.split()[0]: np.zeros(k, np.int64) for name in FIELDS.split(", ")}
    known: dict[bytes, int] = {}
    ids: list[int] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        ids.extend([known.setdefault(w, len(known)) for w in words])
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if ids:
        owner = np.repeat(np.arange(k), out["n_words"])
        found = Repeats(np.array(ids, np.int64), owner, k, min_repeat)
        three = found.windows_of_three()
        out["n_repeat_words"] = found.covered(three, np.full(len(three), 3))
        starts, depth = found.spans()
        out["covered_words"] = found.covered(starts, depth)
        np.maximum.at(out["longest_repeat"], owner[starts], depth)
    return out


def judge(counts: dict[str, np.ndarray], max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT):
    """(base_failed, kept) of every text."""
    n = counts["n_words"]
    base = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_WORDS * n)
    bad = (100 * counts["covered_words"] > max_covered * n) | (counts["longest_repeat"] > max_repeat)
    return base, ~base & ~bad


def score(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts, ``base_failed`` and ``kept``; columns of those names are replaced."""
    bound_batches(df.sparkSession)
    added = [f.split()[0] for f in FIELDS.split(", ")] + ["base_failed", "kept"]
    passed = df.select(*[c for c in df.columns if c not in added])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.schema)
    names = passed.columns

    def run(batch: pa.RecordBatch) -> dict:
        counts = measure(batch.column(text).to_pylist())
        base, kept = judge(counts)
        return {c: batch.column(c) for c in names} | counts | {"base_failed": base, "kept": kept}

    return map_batches(passed, run, f"{schema}, {FIELDS}, base_failed boolean, kept boolean")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, columns unchanged."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                with paused_collection():
                    _, kept = judge(measure(part.column(text).to_pylist()))
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every whole text."""
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.withColumn("long_repeat", scored["longest_repeat"] > MAX_REPEAT).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "covered_words", "long_repeat",
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
tok AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
win AS (
  SELECT r, i, w,
    count(*) OVER (PARTITION BY r) AS n,
    string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w3,
    string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {MIN_REPEAT - 1} FOLLOWING) AS wk,
    string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {MAX_REPEAT} FOLLOWING) AS wl
  FROM tok
),
rep AS (
  SELECT r, i,
    (i + 3 <= n AND count(*) FILTER (WHERE i + 3 <= n) OVER (PARTITION BY r, w3) > 1)::INT AS r3,
    (i + {MIN_REPEAT} <= n AND count(*) FILTER (WHERE i + {MIN_REPEAT} <= n) OVER (PARTITION BY r, wk) > 1)::INT AS rk,
    (i + {MAX_REPEAT + 1} <= n AND count(*) FILTER (WHERE i + {MAX_REPEAT + 1} <= n) OVER (PARTITION BY r, wl) > 1)::INT AS rl
  FROM win
),
cov AS (
  SELECT r, rl,
    max(r3) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
    max(rk) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {MIN_REPEAT - 1} PRECEDING AND CURRENT ROW) AS ck
  FROM rep
),
agg AS (SELECT r, sum(c3)::BIGINT AS n_repeat_words, sum(ck)::BIGINT AS covered_words, max(rl) > 0 AS long_repeat FROM cov GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c AS (
  SELECT d.doc_id, len(w.ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(covered_words, 0) AS covered_words, coalesce(long_repeat, false) AS long_repeat
  FROM d JOIN w USING (r) LEFT JOIN agg USING (r) LEFT JOIN dup USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words)
    AND 100 * covered_words <= {MAX_COVERED} * n_words AND NOT long_repeat AS kept,
  covered_words, long_repeat
FROM c
"""
