"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Letters of a text are lower-cased, other characters become one blank; hashed
n-grams of two and three characters are counted, damped, weighted by inverse
document frequency and normalised.  Each language of a bounded labelled sample
is clustered into several centroids (spherical k-means), and a text gets the
language of the centroid with the largest cosine.  A text whose distance to it
is larger than nearly all training texts had is rejected: ``rejected`` is set,
while the prediction stays.  A language of few labelled texts takes the loosest
limit of the others, as its own texts are its centroids.

Defined results: a null text and one without a letter are ``und``, score 0 and
rejected; repeated rows get equal results; of centroids at equal cosine the first
counts, languages being in order of name; texts are read whole, however long; with
no labelled row everything is ``und`` with score 0 and ``keep`` keeps every text
with a letter; an empty table gives no rows; other columns pass through
``identify``, and columns with the names of its results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, map_batches, paused_collection, slices, table

#: Hashed n-gram features.
FEATURES = 1 << 13
#: Labelled texts of a language used for fitting, at most about this many.
SAMPLE = 400
CENTROIDS = 4
#: Labelled texts below which a language has no limit of its own.
ENOUGH = 32
#: A text is rejected below this share of the cosine that all but 0.5 % of the training texts reach.
LOOSE = 0.6
#: Texts turned into dense vectors at once.
CHUNK = 64
UNKNOWN = "und"


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with non-letters as 0, and each text's share (with a 0 around it)."""
    lowered = ["\0" + t.lower() + "\0" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[~_is_letter(points)] = 0
    return points, np.fromiter(map(len, lowered), np.int64, len(lowered))


def _is_letter(points: np.ndarray) -> np.ndarray:
    kinds, places = np.unique(points, return_inverse=True)
    return np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))[places]


def counts(texts: list[str], features: int = FEATURES) -> np.ndarray:
    """Hashed n-gram counts, a row for each text; no n-gram crosses two texts."""
    points, sizes = _letters(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    out = np.zeros(len(texts) * features, np.float32)
    x = points.astype(np.uint64)
    # runs of blanks count as one: keep letters, and blanks that follow a letter or begin a text
    keep = x > 0
    keep[1:] |= x[:-1] > 0
    keep[np.cumsum(sizes) - sizes] = True
    x, owner = x[keep], owner[keep]
    for n in (2, 3):
        if len(x) < n:
            continue
        mixed = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        same = owner[: len(x) - n + 1] == owner[n - 1 :]
        key = owner[: len(same)][same] * features + (mixed[same] % np.uint64(features)).astype(np.int64)
        out += np.bincount(key, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), features)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Centroids with their languages, feature weights and rejection limits."""

    languages: tuple[str, ...]
    owner: np.ndarray
    centroids: np.ndarray
    weights: np.ndarray
    limits: np.ndarray

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        return _normal(np.log1p(raw) * self.weights)

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        n = len(texts)
        out = {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "rejected": [True] * n}
        some = [i for i in range(n) if self.languages and has_letter(texts[i])]
        for at in range(0, len(some), CHUNK):
            part = some[at : at + CHUNK]
            near = self.vectors(counts([texts[i] for i in part], len(self.weights))) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, c, s in zip(part, best.tolist(), near[np.arange(len(part)), best].tolist()):
                out["lang_pred"][i] = self.languages[self.owner[c]]
                out["score"][i] = min(1.0, max(0.0, s))
                out["rejected"][i] = bool(s < self.limits[c])
        return out


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _cluster(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row and then the farthest rows."""
    chosen = [int((rows @ rows.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centres = rows[chosen]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        new = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _normal(sums), centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _rows(raw, which: np.ndarray, features: int) -> np.ndarray:
    """Some rows of raw counts as a dense matrix; ``raw`` is one, or a list of (features, counts)."""
    if isinstance(raw, np.ndarray):
        return raw[which]
    out = np.zeros((len(which), features), np.float32)
    for row, i in enumerate(which.tolist()):
        out[row, raw[i][0]] = raw[i][1]
    return out


def fit(raw, languages: list[str], centroids: int = CENTROIDS, loose: float = LOOSE, features: int = FEATURES) -> Model:
    """A model from raw counts (a matrix, or a list of (features, counts)) and the language of each row.

    One language at a time is held as a dense matrix.
    """
    names = tuple(sorted(set(languages)))
    if isinstance(raw, np.ndarray):
        features = raw.shape[1]
    if not names:
        return Model((), np.zeros(0, int), np.zeros((0, features), np.float32), np.ones(features, np.float32), np.zeros(0))
    of = np.array([names.index(x) for x in languages])
    df = np.zeros(features)
    for number in range(len(names)):
        df += (_rows(raw, np.flatnonzero(of == number), features) > 0).sum(axis=0)
    weights = (np.log((1 + len(languages)) / (1 + df)) + 1).astype(np.float32)
    owner, centres, limits = [], [], []
    for number in range(len(names)):
        own = _normal(np.log1p(_rows(raw, np.flatnonzero(of == number), features)) * weights)
        found = _cluster(own, centroids)
        enough = len(own) >= ENOUGH
        owner += [number] * len(found)
        centres.append(found)
        limits += [loose * float(np.quantile((own @ found.T).max(axis=1), 0.005)) if enough else np.nan] * len(found)
    limits = np.array(limits)
    limits[np.isnan(limits)] = np.nanmin(limits) if not np.isnan(limits).all() else 0.0
    return Model(names, np.array(owner), np.concatenate(centres).astype(np.float32), weights, limits)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit on labelled documents of folds 1 to 4: at most about ``sample`` of each language, by a hash of the id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([], [])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, sample / n)])
    chosen = labelled.where(draw < share[F.col("lang")]).select("doc_id", "text", "lang", F.xxhash64("text").alias("tie"))

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": [], "tie": [], "lang": [], "feature": [], "n": []}
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "tie")))
        for doc_id, text, lang, tie in rows:
            if has_letter(text):
                row = counts([text])[0]
                held = np.flatnonzero(row)
                for key, value in (("doc_id", doc_id), ("tie", tie), ("lang", lang), ("feature", held.astype(np.int32)), ("n", row[held])):
                    out[key].append(value)
        return out

    bound_batches(docs.sparkSession)
    rows = map_batches(chosen, run, "doc_id long, tie long, lang string, feature array<int>, n array<float>").toArrow()
    order = [(c, "ascending") for c in ("doc_id", "tie", "lang")]
    rows = rows.take(pc.sort_indices(rows.select([c for c, _ in order]), order))  # the same model whatever the partitions
    raw = [(feature.values.to_numpy(), n.values.to_numpy()) for feature, n in zip(rows.column("feature"), rows.column("n"))]
    return fit(raw, rows.column("lang").to_pylist(), centroids)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of those names are replaced."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    added = ("lang_pred", "score", "rejected")
    passed = docs.select(*[c for c in docs.columns if c not in added])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.schema)
    names = passed.columns

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in names} | held.value.predict(batch.column("text").to_pylist())

    return map_batches(passed, run, f"{schema}, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, columns unchanged; with a model of no language, all with a letter."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def told(texts: list[str | None]) -> list[bool]:
        return held.value.predict(texts)["rejected"] if held.value.languages else [not has_letter(t) for t in texts]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                with paused_collection():
                    rejected = np.array(told(part.column("text").to_pylist()), bool)
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op3_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")
