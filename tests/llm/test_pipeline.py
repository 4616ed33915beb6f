"""The pipeline on the small tables against plain versions of its stages."""

import random

import pytest
from test_simhash import exact_left

import corpus_pipeline
from threadloom.llm import language, packing, pii, quality
from threadloom.scratch import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_kept(rows):
    """Ids that a plain quality rule, the model's rejection and all-pairs comparison leave."""
    _, good = quality.judge(quality.measure([r["text"] for r in rows]))
    return [r for r, k in zip(rows, good) if k]


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, rows = [n for n, _ in corpus_pipeline.STAGES], docs.collect()
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, sf_dir), "test")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        found = {r["doc_id"]: r for r in out.collect()}
        if name == "quality rules":
            assert set(found) == {r["doc_id"] for r in plain_kept(rows)} and len(found) < len(rows)
        elif name == "language ID":
            model = language.train(docs)
            rejected = model.predict([r["text"] for r in rows])["rejected"]
            assert set(found) == {r["doc_id"] for r, bad in zip(rows, rejected) if not bad}
        elif name == "SimHash near-dedup":
            rows.sort(key=lambda r: r["doc_id"])
            assert set(found) == {rows[i]["doc_id"] for i in exact_left([r["text"] for r in rows])} and len(found) < len(rows)
        else:
            for r in rows:
                (_, spans), = pii.find([r["text"]], pii.default_tagger())
                assert found[r["doc_id"]]["text"] == pii.masked(r["text"], spans)
                assert found[r["doc_id"]]["n_chars"] == len(found[r["doc_id"]]["text"])
        docs, rows = out, out.collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    own = packing.tokenizer(packing.vocabulary_path())
    assert sum(r["length"] for r in packed) == sum(len(x) // 4 + 1 for x in own.encode([r["text"] for r in rows]))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_tables_without_documents_to_keep(spark, save, rows):
    assert corpus_pipeline.run(spark, save("documents", rows, DOCS)).count() == 0


def test_repeated_rows_become_one(spark, save):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] * 2 + [(99, texts[0], "en", "s", 1)]
    found = corpus_pipeline.run(spark, save("documents", rows, DOCS)).collect()
    assert sorted(r["doc_id"] for r in found if r["piece"] == 0) == list(range(40))
