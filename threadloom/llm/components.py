"""Connected components by alternating large-star and small-star rounds.

Producers thin their links inside each partition by union-find (a forest spans
the same components with at most one link per node), so what is shuffled
afterwards grows with the nodes.  Each round writes its links to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, discard


class UnionFind:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for every i."""
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            self.flatten()

    def flatten(self) -> None:
        root = self.root
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, smallest member) of the components of the links."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = UnionFind(len(nodes))
    sets.add(places[: len(a)], places[len(a) :])
    moved = np.flatnonzero(sets.root != np.arange(len(nodes)))
    return nodes[moved], nodes[sets.root[moved]]


def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of all links (a, b) of a partition.

    Producers of links call it in their own function: one Python step in a stage
    needs one worker for each core, two steps would need two.
    """
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1 << 20:
            a, b = spanning(a, b)
    a, b = spanning(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``links`` (long a, long b); root is the smallest node.

    Nodes without links don't appear.  No null may occur in ``links``, and links
    need no order; ``thin`` them where they are made.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    seen = None
    for _ in range(rounds):
        larger, least = _large_star(links)
        new = cut(_small_star(larger), "links")
        discard(links, least)
        links = new
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), b < a, where every larger neighbour of a node is linked to its smallest one; and a table they read."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # stored, so that the join reads two plain exchanges and may be split at a node with very many links
    least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct(), least


def _small_star(links: DataFrame) -> DataFrame:
    """Links (a, b), b < a, where a node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return out.where("a <> b").distinct()
