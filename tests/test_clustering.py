import numpy as np

from threadloom.operators import clustering, density, features


def points(spark, rows, labels=None):
    data = [(i, [float(x) for x in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id long, vector array<double>, label int")


def brute_dbscan(d, eps, m):
    n = len(d)
    near = [[j for j in range(n) if d[i, j] <= eps] for i in range(n)]
    core = [len(x) >= m for x in near]
    label, k = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], k
            while stack:
                for j in near[stack.pop()]:
                    if label[j] < 0:
                        label[j] = k
                        if core[j]:
                            stack.append(j)
            k += 1
    return label


def test_silhouette(spark):
    rng = np.random.default_rng(0)
    x, labels = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    labels[0] = 9
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for i in range(40):
        own = labels == labels[i]
        a = d[i][own].sum() / max(own.sum() - 1, 1)
        b = min(d[i][labels == k].mean() for k in set(labels) - {labels[i]})
        want.append((b - a) / max(a, b) if own.sum() > 1 else 0)
    rows = points(spark, x, labels)
    found, _ = density.silhouette(density.dense_points(rows), rows.select("id", "label"))
    assert np.allclose([r["s"] for r in found.orderBy("id").collect()], want)


def test_cosine_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.random((20, 12)) * (rng.random((20, 12)) < 0.3)
    x = x[np.linalg.norm(x, axis=1) > 0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = spark.createDataFrame([(int(i), f"t{j}", float(u[i, j])) for i, j in zip(*np.nonzero(u))], "doc_id long, term string, w double")
    s = u @ u.T
    ids = sorted({r["doc_id"] for r in w.collect()})
    assert ids == list(range(len(u)))
    near = {(r["i"], r["j"]) for r in features.cosine_pairs(w, 0.6).collect()}
    assert near == {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if s[i, j] >= 0.6}


def test_tfidf(spark):
    tokens = spark.createDataFrame([(0, t) for t in ["aa", "bb", "aa", "c"]] + [(1, "aa"), (2, "dd")], "doc_id long, token string")
    counts = features.term_counts(tokens)
    idf = features.idf_table(features.prune(features.document_frequency(counts), 1, 2), 3)
    found = {(r["doc_id"], r["term"]): r["w"] for r in features.tfidf(counts, idf).collect()}
    a, b = np.log(4 / 3) + 1, np.log(4 / 2) + 1
    norm = np.hypot(2 * a, b)
    assert np.allclose([found[0, "aa"], found[0, "bb"], found[1, "aa"]], [2 * a / norm, b / norm, 1]) and len(found) == 3


def test_kmeans_and_projection(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(20, 5)), rng.normal(size=(20, 5)) + 10])
    p = points(spark, x)
    found = [r["label"] for r in clustering.kmeans(p, 2).orderBy("id").collect()]
    assert len(set(found[:20])) == 1 and len(set(found)) == 2
    xs = np.array([r["xs"] for r in clustering.project(p).orderBy("id").collect()])
    assert abs(xs.mean(axis=0)).max() < 1e-9 and abs(xs[:20, 0].mean() - xs[20:, 0].mean()) > 10
    assert [tuple(r) for r in clustering.label_counts(p).collect()] == [(0, 40)]


def test_display(spark):
    w = spark.createDataFrame([(0, "a", 0.6), (0, "b", 0.8), (1, "b", 1.0), (1, "c", 0.0)], "doc_id long, term string, w double")
    assert sorted(map(tuple, features.wide(w, ["a", "b"]).collect())) == [(0, 0.6, 0.8), (1, 0.0, 1.0)]
    assert [r[0] for r in features.feature_names(w).collect()] == ["a", "b", "c"]
    assert [tuple(r) for r in features.top_terms(w, 0, 1).collect()] == [(0, "b", 0.8)]


def test_rows_that_share_no_term_are_compared(spark):
    """Three documents without common words are one cluster at eps 2 and noise at eps 1."""
    w = spark.createDataFrame([(i, f"t{i}", 1.0) for i in range(3)], "doc_id long, term string, w double")
    copies = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, copies long")
    cells = density.cells(density.similarity_row_points(w, copies))
    for eps, label in ((2.0, 0), (1.0, -1)):
        assert [r["label"] for r in density.dbscan(cells, eps).collect()] == [label] * 3


def test_equal_documents_are_compared_once(spark):
    rows = [(i, t, w) for i in range(40) for t, w in (("a", 0.6), ("b", 0.8))] + [(50, "a", 1.0), (51, "c", 1.0)]
    w = spark.createDataFrame(rows, "doc_id long, term string, w double")
    classes, pairs = features.similar_classes(w, 0.5)
    assert {(r["doc_id"], r["head"]) for r in classes.collect()} == {(i, 0) for i in range(40)} | {(50, 50), (51, 51)}
    assert [(r["i"], r["j"], round(r["sim"], 6)) for r in pairs.collect()] == [(0, 50, 0.6)]
    found = features.cosine_pairs(w, 0.5).collect()
    assert len(found) == 40 * 39 // 2 + 40 and len({(r["i"], r["j"]) for r in found}) == len(found)


def test_numbers_by_ranges(spark):
    rows = spark.range(1000).selectExpr("id * 7 AS root").repartition(5)
    assert all(r["label"] * 7 == r["root"] for r in clustering.numbered(rows, "root", "label").collect())


def test_kmeans_rounds(spark):
    x = np.random.default_rng(3).normal(size=(50, 3))
    centres = x[:4].copy()
    for _ in range(3):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == k].mean(0) for k in range(4)])
    want = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    found = clustering.kmeans_rounds(points(spark, x), x[:4].tolist(), 3).orderBy("id").collect()
    assert [r["label"] for r in found] == want.tolist()
