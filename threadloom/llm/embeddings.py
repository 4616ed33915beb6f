"""Near-duplicate vectors by sorted projection passes.

Vectors with equal components and label become one representative.  In each
pass a representative gets a code, the concatenated signs of random projections
drawn for that pass, taken about the mean of its label, since vectors that all
point one way would else have like signs; representatives are range-partitioned
and sorted by (label, code), and each is compared with the next ``WINDOW`` ones.
Pairs at ``least`` cosine or more are united over all passes.  An exact check
follows: inside each component found, all representatives are compared, in
blocks, so that the number of links of a vector is complete however many vectors
lie close together.

The number of passes follows from the data, label by label: from a bounded sample of
its vectors and its size, each in a task of its own, it is estimated how many vectors share the first k signs
with another, hence how deep a window reaches, and with what chance a pair at
exactly ``least`` agrees so far; passes are added until such a pair is found with
``RECALL``.  The sample (and the means, which any value may stand for) changes
the cost and the recall, never what counts as a link.  Two passes at a time are
shuffled; their files go before the next two.

Cost: about (1.2 x passes + 2) times the input is shuffled, a third of which is on
disk at once when there are many passes; the exact check of a component of n
vectors takes n * n / 2 products, as its counts do by definition.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without label, link with nothing, as do vectors of
different lengths; copies of one vector are linked with each other; repeated
rows count as vectors of their own; a null id is no smallest id, and such a row is
kept only where its whole component has no id; vectors are read whole, however
long; ties in codes are sorted by node; an empty table gives no rows; the result
has the four columns named below, whatever other columns the input has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import cut, map_batches, table
from threadloom.llm.components import components, spanning, thin
from threadloom.llm.groups import by_group, deal, deal_out

LEAST = 0.98
#: Signs in a code, and neighbours compared in each pass.
BITS, WINDOW = 62, 512
#: Chance with which a pair at exactly LEAST is to be found, fewest passes, and passes of one shuffle.
RECALL, PASSES, ROUND = 0.98, 3, 2
#: Vectors of a label, about, that its mean and passes are estimated from, and pairs of them.
SAMPLE, PAIRS = 4096, 4096
#: Labels above a window up to which their table is sent to every task; beyond, it is joined by exchange.
SENT = 10_000
#: Representatives of a component that one task compares at once, and blocks that are not cut further.
BLOCK, FINE = 4096, 64
SEED = 20240


def _unit(values: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    rows = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def representatives(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with keys (null for those that link with nothing), and one row for each distinct vector."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    values = F.transform(F.col("embedding"), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 becomes 0.0
    sound = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
        & F.exists("embedding", lambda x: x != 0)
    )
    sound = F.coalesce(sound, F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("string").alias("label"),
        F.when(sound, values).alias("vector"),
    ).withColumns(
        {
            "k1": F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")),
            "k2": F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(SEED), "vector", "label")),
        }
    )
    found = (
        rows.where("k1 IS NOT NULL")
        .groupBy("k1", "k2")
        .agg(
            F.min("vec_id").alias("least"),
            F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        )
        .withColumn("dim", F.size("vector"))
        .withColumn("group", F.xxhash64("label", "dim"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    return rows.select("vec_id", "k1", "k2"), cut(found, "vectors")


def depth_chance(unit: np.ndarray, centre: np.ndarray, number: int, window: int, least: float, bits: int = BITS) -> float:
    """Chance that a pass brings two of ``number`` vectors like ``unit`` that lie at ``least`` within ``window``.

    Of the vectors that don't link with one, number * mean(agree ** k) share its
    first k signs; at the first k where they fit the window the pair is found if
    it agrees in k signs.
    """
    rng = np.random.default_rng(SEED)
    i, j = rng.integers(0, len(unit), (2, PAIRS))
    apart = (unit[i] * unit[j]).sum(axis=1) < least

    def agree(x, y):
        x, y = x - centre, y - centre
        scale = np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-30)
        return 1 - np.arccos(np.clip((x * y).sum(axis=1) / scale, -1, 1)) / np.pi

    aside = rng.standard_normal(unit.shape)
    aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-30)
    near = agree(unit, least * unit + (1 - least * least) ** 0.5 * aside)
    other = agree(unit[i[apart]], unit[j[apart]])
    for k in range(bits + 1):
        rivals = number * (other**k).sum() / PAIRS
        if rivals <= window:
            return float((near**k).mean())
    return float((near**bits).mean() * window / rivals)


def plan(reps: DataFrame, least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """(group, mean, passes) of every group above ``window``: its mean unit vector and the passes it takes.

    A bounded sample of each such group goes to a task, whatever the number of
    groups; in a smaller group every window holds all others, so one pass does.
    """
    sizes = reps.groupBy("group").agg(F.count(F.lit(1)).alias("number")).where(F.col("number") > window)
    sizes = cut(sizes, "vector-groups")
    few = sizes.limit(SENT + 1).count() <= SENT
    draw = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30))
    held = reps.select("group", "node", "dim", "vector").join(F.broadcast(sizes) if few else sizes, "group")
    held = held.where(draw * F.col("number") < F.lit((1 << 30) * SAMPLE)).drop("node")

    def estimate(rows: pa.Table) -> pa.Table:
        unit = _unit(rows.column("vector"), rows.column("dim")[0].as_py())
        mean = unit.mean(axis=0)
        chance = min(max(depth_chance(unit, mean, rows.column("number")[0].as_py(), window, least), 1e-6), 1 - 1e-9)
        passes = max(PASSES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - chance))))
        columns = [pa.array([rows.column("group")[0].as_py()]), pa.array([mean], pa.list_(pa.float64())), pa.array([passes], pa.int32())]
        return pa.Table.from_arrays(columns, names=["group", "mean", "passes"])

    return cut(held.groupBy("group").applyInArrow(estimate, "group long, mean array<double>, passes int"), "vector-plan")


def planned(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """``reps`` with ``mean`` and ``passes`` of their group; null and 1 where it has none."""
    few = groups.limit(SENT + 1).count() <= SENT
    joined = reps.select("group", "dim", "node", "vector").join(F.broadcast(groups) if few else groups, "group", "left")
    return joined.withColumn("passes", F.coalesce("passes", F.lit(1)))


def neighbour_links(rows: DataFrame, passes: range, least: float = LEAST, bits: int = BITS, window: int = WINDOW) -> DataFrame:
    """Links (a, b) between rows of ``planned`` that lie close in some of the passes, thinned to spanning ones."""
    kind = dict(rows.dtypes)["vector"]

    def code(batch: pa.RecordBatch) -> dict:
        dims, group, most = (batch.column(c).to_numpy() for c in ("dim", "group", "passes"))
        centred = batch.column("mean").is_valid().to_numpy(zero_copy_only=False)
        codes = np.zeros((len(passes), batch.num_rows), np.int64)
        for size in np.unique(dims):
            here = np.flatnonzero(dims == size)
            unit = _unit(batch.column("vector").take(pa.array(here)), int(size))
            about = np.flatnonzero(centred[here])
            if len(about):
                means = batch.column("mean").take(pa.array(here[about])).flatten().to_numpy().reshape(-1, int(size))
                unit[about] -= means
            for row, p in enumerate(passes):
                planes = np.random.default_rng([SEED, p, int(size)]).standard_normal((int(size), bits))
                codes[row, here] = (unit @ planes > 0) @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
        taken = np.array(passes)[:, None] < most[None]
        again = pa.array(np.nonzero(taken)[1])
        out = {name: batch.column(name).take(again) for name in ("node", "vector")}
        mixed = np.stack([group ^ np.int64(p) for p in passes])  # a group's passes are groups of their own
        return out | {"group": mixed[taken], "code": codes[taken]}

    order = ["group", "code", "node"]
    some = rows.where(F.col("passes") > passes.start).select("group", "dim", "node", "vector", "mean", "passes")
    coded = map_batches(some, code, f"group long, code long, node long, vector {kind}")
    coded = coded.repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            whole = pa.Table.from_batches([*(tail.to_batches() if tail is not None else []), batch])
            tail = whole.slice(max(0, whole.num_rows - window))
            a, b = _near(whole, window, least)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return coded.mapInArrow(lambda batches: thin(compare(batches)), "a long, b long")


def _near(rows: pa.Table, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    n, node, group = rows.num_rows, rows.column("node").to_numpy(), rows.column("group").to_numpy()
    starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), n) if n else np.zeros(1, np.int64)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(starts[:-1], starts[1:]):
        part = rows.slice(lo, hi - lo).column("vector")
        unit = _unit(part, len(part[0].as_py()))
        short = unit.astype(np.float32)
        for begin in range(0, hi - lo, 256):
            end = min(hi - lo, begin + 256)
            stop = min(hi - lo, end + window)
            # single precision is right to 1e-5; what comes so near is computed in double precision
            maybe = np.flatnonzero(((short[begin:end] @ short[begin:stop].T >= least - 1e-4).sum(axis=1)) > 1)
            if not len(maybe):
                continue
            i, j = np.nonzero(unit[begin + maybe] @ unit[begin:stop].T >= least)
            i = maybe[i]
            ahead = (j > i) & (j - i <= window)
            a, b = spanning(node[i[ahead] + begin + lo], node[j[ahead] + begin + lo])
            found_a.append(a)
            found_b.append(b)
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


def link_counts(members: DataFrame, least: float = LEAST, block: int = BLOCK, fine: int = FINE) -> DataFrame:
    """(node, linked): copies of other vectors linked with each representative, by exact comparison."""
    key = ["root", "__i", "__j"]
    dealt = deal(members.select("root", "node", "copies", "dim", "vector"), ["root"], "node", block, fine=min(fine, block))
    dealt = deal_out(dealt, "root", "__own", "node")

    def count(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, copies, own = (rows.column(c).to_numpy() for c in ("node", "copies", "__own"))
        first, last = rows.column("__i").to_numpy(), rows.column("__j").to_numpy()
        linked = np.zeros(len(node), np.int64)
        for lo, hi in zip(starts, np.append(starts[1:], len(node))):
            part = rows.slice(lo, hi - lo)
            unit = _unit(part.column("vector"), part.column("dim")[0].as_py())
            whole = first[lo] == last[lo]
            split = hi - lo if whole else int((own[lo:hi] == first[lo]).sum())
            other = slice(lo, hi) if whole else slice(lo + split, hi)
            for begin in range(0, split, 512):
                some = slice(lo + begin, lo + min(split, begin + 512))
                near = unit[some.start - lo : some.stop - lo] @ unit[other.start - lo :].T >= least
                if whole:
                    near[np.arange(near.shape[0]), begin + np.arange(near.shape[0])] = False
                else:
                    linked[other] += copies[some] @ near
                linked[some] += near @ copies[other]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked)], names=["node", "linked"])

    counted = dealt.mapInArrow(lambda batches: by_group(batches, key, count, 8192), "node long, linked long")
    return counted.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows, reps = representatives(vectors)
    groups = plan(reps, least)
    passes = groups.agg(F.max("passes")).first()[0] or 1
    dealt, found = planned(reps, groups), []
    for begin in range(0, passes, ROUND):
        some = range(begin, min(passes, begin + ROUND))
        found.append(cut(neighbour_links(dealt, some, least), "vector-links"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    found = components(links)
    members = cut(reps.join(found, "node"), "vector-members")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.select("node", "root").join(ids, "root").join(link_counts(members, least), "node", "left")
    table_ = reps.select("node", "k1", "k2", "least", "copies").join(named.drop("root"), "node", "left")
    table_ = table_.select(
        "k1",
        "k2",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    component = F.coalesce("component_id", "vec_id")
    return rows.join(table_, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op7_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= {LEAST}
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN deg ON deg.a = vec_id
"""
