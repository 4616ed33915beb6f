"""Components, numbering and reports of clusters; k-means and projections of dense vectors.  Neighbours are in ``density``."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.scratch import cut

NOISE = -1


def eps_graph(pairs: DataFrame, eps: float) -> DataFrame:
    """Both directions (a, b) of the pairs within ``eps``."""
    near = pairs.where(F.col("dist") <= eps)
    return near.select(F.col("i").alias("a"), F.col("j").alias("b")).union(near.select(F.col("j").alias("a"), F.col("i").alias("b")))


def smallest_reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id of each node's component, for links (a, b) in both directions.

    Each round a node takes the smallest label among its own, its neighbours' and
    its label's label, so chains shrink by jumping; labels are stored every round.
    """
    labels = cut(links.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id"), "labels")
    links = cut(links, "links")
    seen = None
    for _ in range(rounds):
        of_b = labels.select(F.col("id").alias("b"), F.col("root").alias("m"))
        near = links.join(of_b, "b").groupBy("a").agg(F.min("m").alias("m"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("root", "m").alias("root"))
        up = step.select(F.col("id").alias("root"), F.col("root").alias("top"))
        labels = cut(step.join(up, "root", "left").select("id", F.least("root", F.coalesce("top", "root")).alias("root")), "labels")
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == seen:
            return labels
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: their number from 0 in the order of a column without repeats, by ranges of it."""
    dealt = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    # one row for each range
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return dealt.join(F.broadcast(counts), "__part").withColumn(name, inside + F.col("__before") - 1).drop("__part", "__before")


def cluster_counts(labels: DataFrame) -> DataFrame:
    """One row: clusters without noise, and noise points."""
    return labels.agg(
        F.count_distinct(F.when(F.col("label") != NOISE, F.col("label"))).alias("n_clusters"),
        F.count_if(F.col("label") == NOISE).alias("n_noise"),
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def kmeans(points: DataFrame, k: int = 4, rounds: int = 20, seed: int = 1) -> DataFrame:
    """(id, label): Lloyd's rounds from the ``k`` vectors whose ids have the smallest hashes, until the centres rest.

    A round is one pass with k broadcast centres and one row of sums for each
    centre and component; a centre that loses all points stays where it was.
    """
    draw = F.xxhash64("id", F.lit(seed))
    first = points.select("vector").orderBy(draw, "id").limit(k).collect()
    return kmeans_rounds(points, [r["vector"] for r in first], rounds)


def kmeans_rounds(points: DataFrame, centres: list[list[float]], rounds: int) -> DataFrame:
    """(id, label) after ``rounds`` rounds from given centres, numbered as they are given."""
    spark = points.sparkSession
    held = [[float(x) for x in c] for c in centres]
    frame = lambda: spark.createDataFrame(list(enumerate(held)), "label int, centre array<double>")
    for _ in range(rounds):
        near = _nearest(points, frame())
        means = near.select("best.label", F.posexplode("vector").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
        rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")).collect()
        new = list(held)
        for r in rows:
            new[r["label"]] = [x["m"] for x in r["c"]]
        if np.allclose(new, held, rtol=0, atol=1e-12):
            break
        held = new
    return kmeans_step(points, frame()).select("id", "label")


def _nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, vector, best): the nearest centre of each point, found in its row; the k centres are one broadcast row."""
    held = centres.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("cs"))
    cost = lambda c: F.aggregate(F.zip_with("vector", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)
    best = F.array_min(F.transform("cs", lambda c: F.struct(cost(c["centre"]).alias("cost"), c["label"].alias("label"))))
    return points.select("id", "vector").join(F.broadcast(held)).select("id", "vector", best.alias("best"))


def kmeans_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, label, cost): nearest centre (label, centre) of each point; ties go to the smaller label.  No row moves."""
    return _nearest(points, centres).select("id", "best.label", "best.cost")


def project(points: DataFrame, k: int = 2) -> DataFrame:
    """(id, xs): the first k principal components of centred vectors; the largest loading of each is positive."""
    rows = points.select("id", array_to_vector("vector").alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="c").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="c", outputCol="xs").fit(centred)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.abs(loadings[:, i]).argmax(), i]) or 1.0) for i in range(k)]
    xs = vector_to_array("xs")
    return model.transform(centred).select("id", F.array(*[xs[i] * F.lit(s) for i, s in enumerate(signs)]).alias("xs"))


def scatter(points: DataFrame, labels: DataFrame, most: float | None = None) -> DataFrame:
    """(id, x, y, label) for plots; points with x above ``most`` are left out."""
    rows = project(points).join(labels.select("id", "label"), "id")
    rows = rows.select("id", F.col("xs")[0].alias("x"), F.col("xs")[1].alias("y"), "label")
    return rows.where(F.col("x") <= most) if most is not None else rows


def cluster_members(labels: DataFrame, titles: DataFrame) -> DataFrame:
    """(label, titles) sorted by id, a row for each cluster. ``titles`` is (id, title).

    A cluster's titles make one row, so it is for reports on clusters that can be
    read; ``first_members`` gives rows.
    """
    rows = labels.join(titles, "id").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("rows"))
    return rows.select("label", F.transform("rows", lambda r: r["title"]).alias("titles"))


def first_members(labels: DataFrame, titles: DataFrame, n: int) -> DataFrame:
    """(label, id, title) of the first ``n`` members of each cluster by id; partial ranks keep a cluster from one task."""
    rows = labels.join(titles, "id")
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("__k") <= n).drop("__k")
