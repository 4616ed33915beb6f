"""Prefix trie of conversations, named by prefix doubling.

Turns get dense names; blocks of 1, 2, 4, ... turns that begin at multiples of their
length get dense names from the names of their halves, one join round for each power
of two.  A prefix of d turns is the blocks of d's binary digits, longest first: its
name is made from that of the prefix without the last block and that block's, one join
round for each number of digits.  Rows with equal (depth, name) are a node.

A node is known by its smallest member and its depth, so the ancestor of a node at any
distance is found among its own member's prefixes by a join on unique keys, and sums
over subtrees take one round for each power of two: after round k a node holds the
sum over its descendants less than 2^(k+1) below.

Texts never move: a turn is the SHA-256 of role and text and the text's length in
bytes.  Positions and names are numbered by ranges and by partitions, and counts are
summed before they are shuffled, so neither a conversation nor a node that a third of
the rows share is one task's work; only the digest of a node's ends is a stream in
one task, as SHA-256 is, over strings of up to ``CHUNK`` ids.

Defined results: turns are ordered by ``turn``, null first, and ties by the digest of
role and text; null roles and texts are empty; repeated rows are turns of their own;
texts of any length count whole; rows without ``conv_id`` belong to no conversation
and are left out; ``%`` has the sign of the dividend; an empty table has no nodes;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import cut, discard, table
from threadloom.llm.ranges import numbered

#: Conversations that share a base, and the turns that one may take from it, less one (fixed values).
FAMILY, TAKES = 5, 9
#: Ids that one string of a node's ends holds at most.
CHUNK = 4096


def turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, n_bytes) of every turn, and (conv_id, n) of every conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    placed = cut(numbered(narrow, "number", order, "turns"), "numbers")
    convs = cut(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first")), "convs")
    at = placed.join(convs.select("conv_id", "first"), "conv_id")
    return at.select("conv_id", (F.col("number") - F.col("first")).alias("pos"), "key", "n_bytes"), convs.select("conv_id", "n")


def _takes(conv_id) -> F.Column:
    return F.crc32(conv_id.cast("string")) % TAKES


def rebuilt(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as from ``turns`` of the rebuilt conversations, and (conv_id, n) of them, n = 0 included."""
    conv = F.col("conv_id")
    bases = convs.select(conv.alias("base"), F.col("n").alias("base_n"))
    sized = convs.withColumns({"takes": _takes(conv), "base": conv - conv % FAMILY}).join(bases, "base", "left")
    sized = cut(sized.withColumn("taken", F.least("takes", F.coalesce("base_n", F.lit(0)))), "sizes")
    own = rows.join(sized.select("conv_id", "takes", "taken"), "conv_id").where("pos >= takes")
    own = own.select("conv_id", (F.col("pos") - F.col("takes") + F.col("taken")).alias("pos"), "key", "n_bytes")
    near = F.array(*[F.try_add(conv, F.lit(k).cast("long")) for k in range(1 - FAMILY, FAMILY)])
    lent = rows.where((conv % FAMILY == 0) & (F.col("pos") < TAKES - 1)).withColumn("to", F.explode(near))
    to = F.col("to")
    lent = lent.where((to - to % FAMILY == conv) & (_takes(to) > F.col("pos"))).drop("conv_id").withColumnRenamed("to", "conv_id")
    lent = lent.join(convs.select("conv_id"), "conv_id", "left_semi").select("conv_id", "pos", "key", "n_bytes")
    sizes = sized.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("takes"), F.lit(0))).alias("n"))
    return cut(own.unionByName(lent), "rebuilt"), sizes


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (stored) with ``name`` instead of ``keys``: equal keys, equal name, dense from 0."""
    names = numbered(rows.select(*keys).distinct(), "name", label="names")
    drop = [k for k in keys if k != "depth"]
    return cut(rows.join(names, keys).drop(*drop), "named")


def blocks(rows: DataFrame, longest: int) -> list[DataFrame]:
    """For each power of two up to ``longest``: (conv_id, i, name) of the blocks of that many turns."""
    found = [_named(rows.select("conv_id", F.col("pos").alias("i"), "key"), ["key"])]
    while 2 ** len(found) <= longest:
        odd = F.col("i") % 2 == 1
        pairs = found[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("l"), F.max(F.when(odd, F.col("name"))).alias("r")
        )
        pairs = cut(pairs.where("l IS NOT NULL AND r IS NOT NULL"), "pairs")
        found.append(_named(pairs, ["l", "r"]))
        discard(pairs)
    return found


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, name) of every prefix; prefixes of one depth are equal where their names are."""
    last = None
    for k, level in enumerate(levels):
        ends = level.where(F.col("i") % 2 == 0).select(
            "conv_id", ((F.col("i") + 1) * 2**k).alias("depth"), (F.col("i") * 2**k).alias("before"), F.col("name").alias("r"),
            (F.bit_count("i") + 1).alias("digits"),
        )
        last = ends if last is None else last.union(ends)
    last = cut(last, "last-blocks")
    most = last.agg(F.max("digits")).first()[0] or 0
    found = last.where("digits = 1").select("conv_id", "depth", F.col("r").alias("name"))
    before = found
    for digits in range(2, most + 1):
        left = before.select("conv_id", F.col("depth").alias("before"), F.col("name").alias("l"))
        pairs = last.where(F.col("digits") == digits).join(left, ["conv_id", "before"]).select("conv_id", "depth", "l", "r")
        pairs = cut(pairs, "prefix-pairs")
        before = _named(pairs, ["depth", "l", "r"]).select("conv_id", "depth", "name")
        discard(pairs)
        found = found.union(before)
    return found


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, digest): SHA-256 of the ``conv_id`` of each (node, depth) in order, joined by commas."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, conv = (batch.column(c).to_numpy() for c in ("node", "depth", "conv_id"))
            if not len(node):
                continue
            new = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
            starts = np.unique(np.concatenate([[0], new, np.arange(0, len(node), CHUNK)]))
            stops = np.append(starts[1:], len(node))
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts.tolist(), stops.tolist())]
            columns = [pa.array(node[starts]), pa.array(depth[starts]), pa.array(conv[starts]), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "depth", "first", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("digest", pa.string())])
        for batch in batches:
            out = []
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if (node, depth) == now:
                    digest.update(b",")
                else:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (node, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else _empty(schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, digest.hexdigest()), schema)], schema=schema)

    dealt = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    parts = dealt.mapInArrow(chunks, "node long, depth long, first long, ids string")
    sorted_ = parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return sorted_.mapInArrow(digests, "node long, depth long, digest string")


def _empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations; ``rows`` (stored) and ``sizes`` as ``rebuilt`` returns them."""
    sizes = cut(sizes, "trie-sizes")
    deepest = sizes.agg(F.max("n")).first()[0] or 0
    found = prefixes(blocks(rows.select("conv_id", "pos", "key"), deepest))
    found = cut(found, "prefixes")
    nodes = cut(found.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    owners = cut(found.join(nodes.select("depth", "name", "node"), ["depth", "name"]).select("conv_id", "depth", "node"), "owners")
    discard(found)

    above = owners.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    last = rows.select(F.col("conv_id").alias("node"), (F.col("pos") + 1).alias("depth"), "n_bytes")
    whole = nodes.select("node", "depth", "n_convs").join(last, ["node", "depth"]).join(above, ["node", "depth"], "left")
    whole = cut(whole, "whole-nodes")
    under = whole.where("depth > 1").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"))
    joined = whole.join(under.agg(F.count(F.lit(1)).alias("n_children")), ["node", "depth"], "left")
    start = joined.select(
        "node", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    start = sums = cut(start, "subtrees")
    step = 1
    while step < deepest:
        high = owners.select("conv_id", F.col("depth").alias("high"), F.col("node").alias("ancestor"))
        low = sums.where(F.col("depth") > step).select(
            F.col("node").alias("conv_id"), (F.col("depth") - step).alias("high"), "n_leaves", "saved_tokens"
        )
        more = low.join(high, ["conv_id", "high"]).groupBy(F.col("ancestor").alias("node"), F.col("high").alias("depth"))
        more = more.agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        total = sums.join(more, ["node", "depth"], "left")
        sums = cut(
            total.withColumns(
                {
                    "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)),
                    "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)),
                }
            ).drop("more_leaves", "more_saved"),
            "subtrees",
        )
        step *= 2

    # one row each: the root sees all nodes
    root = sizes.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")).where("node IS NOT NULL")
    below = start.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    )
    root = cut(root.join(F.broadcast(below)).withColumns({"depth": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")}), "root")
    top = root.select(F.col("node").alias("__root"))
    inner = sums.join(F.broadcast(top)).withColumn("parent", F.when(F.col("depth") == 1, F.col("__root")).otherwise(F.col("parent"))).drop("__root")

    ending = sizes.select("conv_id", F.col("n").alias("depth"))
    ends = ending.where("depth > 0").join(owners, ["conv_id", "depth"]).select("node", "depth", "conv_id")
    at_root = ending.where("depth = 0").join(F.broadcast(top)).select(F.col("__root").alias("node"), "depth", "conv_id")
    digests = end_digests(cut(ends.union(at_root), "ends"))
    full = inner.unionByName(root.select(*inner.columns)).join(digests, ["node", "depth"], "left")
    return full.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with turns of its base."""
    return trie(*rebuilt(*turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


#: The same rows: prefixes as lists of turn numbers, subtrees by the ancestors of every node.
ORACLE = """WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc FROM o GROUP BY conv_id),
h AS (SELECT conv_id, n, xor(crc, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM c),
t AS (SELECT h.conv_id, o.pos, role, text FROM h JOIN o ON o.conv_id = h.base AND o.pos < h.h
  UNION ALL SELECT h.conv_id, o.pos - h + least(h, coalesce((SELECT n FROM c b WHERE b.conv_id = h.base), 0)), role, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos >= h.h),
k AS (SELECT conv_id, pos, strlen(text) AS bytes, dense_rank() OVER (ORDER BY role, text) AS name FROM t),
p AS (SELECT conv_id, pos + 1 AS depth, bytes, list(name) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM k
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
s AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id),
m AS (SELECT path, depth, min(conv_id) AS node, count(*) AS n_convs, any_value(bytes) AS bytes,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = s.n), '') AS ends
  FROM p JOIN s USING (conv_id) GROUP BY path, depth),
g AS (SELECT m.*, (SELECT count(*) FROM m x WHERE x.depth = m.depth + 1 AND x.path[:m.depth] = m.path) AS n_children FROM m),
a AS (SELECT g.path, sum((d.n_children = 0)::INT) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved
  FROM g JOIN g d ON d.depth >= g.depth AND d.path[:g.depth] = g.path GROUP BY g.path)
SELECT g.node AS conv_id, g.depth, u.node AS parent_conv_id, g.n_convs, g.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN a ON a.path = g.path LEFT JOIN m u ON u.depth = g.depth - 1 AND u.path = g.path[:g.depth - 1]"""
