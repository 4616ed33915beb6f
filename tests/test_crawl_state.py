"""Closures, updates in place, pruned folders, lemmas by the corpus, and the retry queue as a stream."""

import datetime
import os

import pytest

from threadloom.functions import text as T
from threadloom.operators import crawl
from threadloom.plans import queries
from threadloom.sources import sinks
from threadloom.streaming import retries


def test_closure_and_its_bound(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (7, 8), (1, None)], "a long, b long")
    start = spark.createDataFrame([(0,), (0,)], "page long")
    assert sorted(map(tuple, crawl.reachable(links, start).collect())) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]
    with pytest.raises(RuntimeError):
        crawl.reachable(links, start, 2)
    assert crawl.reachable(links, start.limit(0)).count() == 0


def test_only_touched_folders_are_written(spark, tmp_path):
    path = f"{tmp_path}/stage"
    rows = spark.createDataFrame([(i, f"f{i % 3}", i % 2, "old") for i in range(60)], "_id long, forum string, page int, labels_v2 string")
    rows.write.partitionBy("forum", "page").parquet(path)

    def files():
        return {os.path.relpath(os.path.join(d, x), path) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}

    before = files()
    changes = spark.createDataFrame([(4, "new"), (10, "newer"), (999, "nobody")], "_id long, labels_v2 string")
    touched = sinks.update_partitions(spark, path, changes, "_id")
    assert [tuple(r) for r in touched.collect()] == [("f1", 0)]
    kept, folder = before & files(), os.path.join("forum=f1", "page=0")
    assert kept == {f for f in before if not f.startswith(folder)} and files() - before
    found = {r["_id"]: r["labels_v2"] for r in spark.read.parquet(path).collect()}
    assert found == {i: {4: "new", 10: "newer"}.get(i, "old") for i in range(60)}
    sinks.update_partitions(spark, path, changes.limit(0), "_id")
    assert spark.read.parquet(path).count() == 60


def test_a_batch_replaces_all_that_it_wrote(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "forum string, page int, raw_content string")
    sinks.append_stage(rows, str(tmp_path), "raw", 1)
    sinks.append_stage(rows.where("page = 2"), str(tmp_path), "raw", 2)
    sinks.append_stage(rows.where("page = 1"), str(tmp_path), "raw", 1)  # a replay with fewer folders
    found = spark.read.parquet(f"{tmp_path}/raw").select("forum", "page", "raw_content", "batch").collect()
    assert sorted(map(tuple, found)) == [("f", 1, "a", "b1"), ("f", 2, "b", "b2")]


def test_a_joined_table_names_the_folders_that_are_read(spark, sf_dir):
    plan = queries.pruned_join(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters" in plan


def test_lemmas_by_the_corpus(spark):
    words = "cats cat boxes box bigger big running run ns n as a flies fly men man class glasses glass baking bake X-rays the"
    tokens = spark.createDataFrame([(w,) for w in words.split() * 2] + [("",), (None,)], "token string")
    exceptions = spark.createDataFrame([("men", "human")], "form string, lemma string")
    found = {r["form"]: r["lemma"] for r in T.corpus_lemmas(tokens, exceptions).collect()}
    assert found == {"cats": "cat", "boxes": "box", "flies": "fly", "glasses": "glass", "baking": "bake", "as": "a", "men": "human"}
    assert "bigger" not in found  # its base by the rules is no word of this corpus


def test_the_queue_drains(spark, tmp_path):
    """States as in batch; a failed URL is due once after its wait, one that was answered or gave up never."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "url string, attempt int, is_external boolean, status int, error string, at timestamp"
    batches = [
        [("a", 1, False, 503, None, at(0)), ("b", 1, False, 200, None, at(0)), ("c", 1, True, None, "timeout", at(1)), ("e", 4, False, 500, None, at(1))],
        [("z", 1, False, 200, None, at(300)), ("d", 1, True, 404, None, at(299))],
        [("a", 2, False, 200, None, at(301)), ("z", 1, True, 200, None, at(700))],
        [("c", 4, True, 503, None, at(701)), ("z", 2, True, 200, None, at(1500))],
    ]
    rows = []
    for number, some in enumerate(batches):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/attempts")
        rows += some
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/attempts")
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, retries.PROVIDER)
    try:
        retries.store(retries.drained(stream), f"{tmp_path}/said", f"{tmp_path}/checkpoint")
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    said = spark.read.parquet(f"{tmp_path}/said")
    batch = crawl.attempt_state(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, retries.last_states(said).collect())) == sorted(map(tuple, batch.select("url", "is_external", "attempts", "state").collect()))
    due = [(r["url"], r["attempts"], r["due"]) for r in said.where("kind = 'due'").orderBy("due", "url").collect()]
    assert due == [("c", 1, at(11)), ("d", 1, at(309))]  # a was answered in the micro-batch that would have brought it up


def test_urls_of_a_group_share_its_calls(spark, tmp_path, monkeypatch):
    """URLs of one group: null keys, timers of several, one that is answered, one that comes again after it was due."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "url string, attempt int, is_external boolean, status int, error string, at timestamp"
    batches = [
        [("a", 1, False, 503, None, at(0)), ("b", 1, False, 503, None, at(5)), (None, 1, False, 503, None, at(6)), ("n", 1, None, 503, None, at(7)), ("a", 1, True, 200, None, at(1))],
        [("z", 1, False, 200, None, at(300))],
        [("z", 2, False, 200, None, at(301))],
        [("b", 2, False, 503, None, at(299)), ("n", 4, None, 503, None, at(299)), ("z", 1, True, 200, None, at(700))],
        [("z", 2, True, 200, None, at(1500))],
    ]
    rows = [r for some in batches for r in some]
    for some in batches:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/attempts")
    monkeypatch.setattr(retries, "GROUPS", 1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/attempts")
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, retries.PROVIDER)
    try:
        retries.store(retries.drained(stream), f"{tmp_path}/said", f"{tmp_path}/checkpoint")
        states = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/checkpoint").count()
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    said = spark.read.parquet(f"{tmp_path}/said")
    batch = crawl.attempt_state(spark.createDataFrame(rows, schema)).select("url", "is_external", "attempts", "state")
    order = lambda found: sorted(map(tuple, found), key=str)
    assert order(retries.last_states(said).collect()) == order(batch.collect())
    due = order((r["url"], r["is_external"], r["attempts"], r["due"]) for r in said.where("kind = 'due'").collect())
    assert due == order([("a", False, 1, at(10)), ("b", False, 1, at(15)), (None, False, 1, at(16)), ("n", None, 1, at(17)), ("b", False, 2, at(309))])
    assert states == 1  # one for the group, not one for each URL
