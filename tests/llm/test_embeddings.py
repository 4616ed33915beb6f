import numpy as np
import pytest

from threadloom.llm import embeddings

TABLE = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    n = len(rows)
    sound = [
        i for i, (_, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {i: set() for i in range(n)}
    for a in sound:
        for b in sound:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a].add(b)
    out, root = [], list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least_id, rows[i][0] == least_id))
    return sorted(out, key=repr)


def test_against_brute_force(spark, save):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for label in range(3):
        for size in [1] * 40 + [2] * 20 + [5] * 6 + [60]:
            centre = rng.normal(size=16)
            for _ in range(size):
                noise = rng.choice([0.0, 0.02, 0.05, 0.1])
                rows.append((k, [float(np.float32(x)) for x in centre + noise * rng.normal(size=16)], label))
                k += 1
    same = rows[5][1]
    rows += [(k + i, same, 0) for i in range(30)] + [(k + 40, same, 1), (k + 41, same, None), (k + 42, None, 0), (k + 43, [0.0] * 16, 0)]
    rows += [(k + 44, [float("nan")] * 16, 0), (k + 45, [float("inf")] + [1.0] * 15, 0), (k + 46, [], 0), (k + 47, same[:8], 0)]
    rows += [(k + 48, [None] + [1.0] * 15, 0), (None, same, 0), (7, same, 0), (k + 49, [-0.0 if x == 0 else x * 1e-30 for x in same], 0)]
    found = sorted(map(tuple, embeddings.op7_sorted_projections(spark, save("embeddings", rows, TABLE)).collect()), key=repr)
    assert found == brute(rows)


def test_blocks_of_large_components(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in centre + 0.08 * rng.normal(size=8)], 1) for i in range(120)]
    vectors = spark.createDataFrame(rows, TABLE)
    _, reps = embeddings.representatives(vectors)
    members = reps.selectExpr("0L AS root", "node", "copies", "dim", "vector", "least")
    found = members.join(embeddings.link_counts(members, block=16), "node").select("least", "linked").collect()
    u = np.array([np.array(r[1], np.float32) for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert {r["least"]: r["linked"] for r in found} == dict(enumerate(want.tolist()))


def test_empty(spark, save):
    assert embeddings.op7_sorted_projections(spark, save("embeddings", [], TABLE)).count() == 0


def test_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    df = embeddings.op7_sorted_projections(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({embeddings.ORACLE})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def clustered(rng, number, pairs, size=32, clusters=20, spread=0.42):
    """Unit vectors around centres (cosine about 0.85 inside a cluster), and pairs at 0.981 of which ``pairs`` rows are one half."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(clusters, size)))
    base = unit(centres[rng.integers(0, clusters, number)] + spread * unit(rng.normal(size=(number, size))))
    aside = rng.normal(size=(pairs, size))
    aside = unit(aside - (aside * base[:pairs]).sum(axis=1, keepdims=True) * base[:pairs])
    return np.concatenate([base, 0.981 * base[:pairs] + (1 - 0.981**2) ** 0.5 * aside]).astype(np.float32)


@pytest.mark.parametrize("number", [4_000, 40_000])
def test_recall_of_planted_pairs_among_clusters(spark, tmp_path, number):
    """Pairs just above the limit in one dense label are found alike at both sizes."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pairs = 400
    rows = clustered(np.random.default_rng(number), number, pairs)
    ids = np.arange(len(rows))
    vectors = pa.FixedSizeListArray.from_arrays(rows.reshape(-1), 32).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": ids, "embedding": vectors, "label": np.zeros(len(rows), np.int32)}), tmp_path / "embeddings.parquet")
    found = embeddings.op7_sorted_projections(spark, f"file://{tmp_path}").toPandas().set_index("vec_id")
    halves = found.loc[ids[number:]]
    assert (halves["component_id"].to_numpy() == ids[:pairs]).mean() >= 0.95


def test_other_columns_and_kinds(spark):
    """Columns with the names of the result, doubles as components, vectors in any type of label."""
    rows = [(1, [1.0, 2.0], "a", 5, 6, "x"), (2, [1.0, 2.0], "a", 5, 6, "y"), (3, [2.0, 4.1], "a", 1, 1, "z"), (4, [2.0, 4.1], None, 1, 1, "z")]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string, n_links int, component_id long, node string")
    found = sorted(map(tuple, embeddings.near_duplicates(vectors).collect()))
    assert found == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_recall_with_many_labels(spark):
    """400 labels, half of them dense and above a window; planted pairs are found in every one of these."""
    rng, rows, halves = np.random.default_rng(5), [], {}
    for label in range(400):
        number, pairs = (540, 12) if label % 2 else (20, 2)
        some = clustered(rng, number, pairs, size=8, clusters=2, spread=0.3) if label % 2 else clustered(rng, number, pairs, size=8)
        at = len(rows)
        rows += [(at + i, v.tolist(), label) for i, v in enumerate(some)]
        halves[label] = [(at + i, at + number + i) for i in range(pairs)]
    vectors = spark.createDataFrame(rows, TABLE).repartition(4)
    _, reps = embeddings.representatives(vectors)
    assert embeddings.plan(reps).count() == 200
    found = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(vectors).collect()}
    for label, pairs in halves.items():
        assert np.mean([found[a] == found[b] for a, b in pairs]) >= 0.9, label
    assert np.mean([found[a] == found[b] for pairs in halves.values() for a, b in pairs]) >= 0.995


def test_plans_joined_by_exchange_give_the_same(spark, monkeypatch):
    rows = clustered(np.random.default_rng(6), 1200, 60, size=8, clusters=2, spread=0.3)
    vectors = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(rows)], TABLE)
    sent = sorted(map(tuple, embeddings.near_duplicates(vectors).collect()))
    monkeypatch.setattr(embeddings, "SENT", 0)
    assert sorted(map(tuple, embeddings.near_duplicates(vectors).collect())) == sent
