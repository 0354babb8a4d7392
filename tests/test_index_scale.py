"""What the index tables cost: no shuffle for postings, one for ranks and merges, nothing computed twice or unasked."""

import re

import pytest
from pyspark.sql import functions as F

from textloom import Engine
from textloom.functions import analysis
from textloom.functions.stemming import language_of, stem
from textloom.operators import index as ix
from textloom.operators import kv
from textloom.streaming import ingest

DATA = "/root/testdata/sf0.001"
ROWS = [(1, "running runs the run Программы программа run"), (2, None), (3, ""), (4, "the and"), (5, "b a b a b"), (None, "lost words")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def want(rows, profile):
    found = {}
    for i, text in rows:
        for p, t in enumerate(analysis.analyze(text or "", profile)):
            found.setdefault((t, i), []).append(p)
    return {k: (p, len(p)) for k, p in found.items()}


@pytest.mark.parametrize("profile", analysis.PROFILES)
def test_postings_of_rows_need_no_shuffle(spark, profile):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    got = ix.postings(docs, profile)
    assert "Exchange" not in plan(got)
    assert {(r.term, r.doc_id): (r.positions, r.tf) for r in got.collect()} == want(ROWS, profile)


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "red"), (1, "red blue"), (2, "red")], "doc_id bigint, text string")
    got = {(r.term, r.doc_id): (r.positions, r.tf) for r in ix.postings(docs).collect()}
    assert got == {("red", 1): ([0, 0], 2), ("blue", 1): ([1], 1), ("red", 2): ([0], 1)}


def test_stems_of_arrays(spark):
    words = [["running", "runs"], [], ["программы", "running"]]
    got = spark.createDataFrame([(w,) for w in words], "w array<string>").coalesce(1).select(analysis.stems(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [[stem(t, language_of(t)) for t in w] for w in words]


def test_a_table_is_computed_once_to_be_written(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(1000, numPartitions=4).rdd.map(lambda r: (seen.add(1), (f"t{r.id % 7}", r.id))[1])
    ix.write_table(spark.createDataFrame(rows, "term string, doc_id bigint"), f"{tmp_path}/t", "term")
    assert seen.value == 1000 and spark.read.parquet(f"{tmp_path}/t").distinct().count() == 1000


def test_ranks_take_one_shuffle_before_the_sort(spark, tmp_path):
    spark.createDataFrame([(t, i, i % 5 + 1) for t in "abc" for i in range(100)], "term string, doc_id bigint, tf int").write.parquet(f"{tmp_path}/tf")
    tf = spark.read.parquet(f"{tmp_path}/tf")
    for df in (ix.champions(tf), ix.tiers(tf)):
        p = plan(df)
        assert p.count("Exchange ") == 1 and "Join" not in p and p.rfind("Sort [") < p.find("Exchange ")


def test_derived_tables_are_written_when_asked_for(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    e = Engine(spark, docs).save(f"{tmp_path}/e", ())
    names = lambda: sorted(p.name for p in (tmp_path / "e" / "gen-0").iterdir() if p.is_dir())
    assert names() == ["docs", "postings"]
    assert e.derive("champions").champions.count() > 0 and names() == ["champions", "docs", "postings"]
    assert e.derive("corpus_stats").corpus_stats.first() == Engine.load(spark, f"{tmp_path}/e").corpus_stats.first()
    assert names() == ["champions", "corpus_stats", "docs", "postings", "vocab"]


def test_merging_store_shuffles_once_a_write(spark, tmp_path, monkeypatch):
    store, plans = kv.MergingStore(spark, f"{tmp_path}/m"), []
    put = store._put
    monkeypatch.setattr(store, "_put", lambda rows, name: (plans.append(plan(rows)), put(rows, name)))
    rows = [(f"k{i % 3}", i // 2) for i in range(60)]
    for part in (rows[:40], rows[20:]):
        store.append(spark.createDataFrame(part, kv.MEMBERS))
    store.compact()
    assert [len(re.findall(r"Exchange \w+", p)) for p in plans] == [1, 1, 1]
    assert sorted(map(tuple, store.rows().collect())) == sorted(set(rows))


def test_one_streamed_batch_is_not_merged(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a red fox"), (2, "red red")], "doc_id bigint, text string")
    ix.write_table(ix.postings(docs), f"{tmp_path}/p/batch=0", "term")
    one = ingest.read_postings(spark, f"{tmp_path}/p")
    held = {(r.term, r.doc_id): (r.positions, r.tf) for r in one.collect()}
    assert "Exchange" not in plan(one) and held == {("red", 1): ([0], 1), ("fox", 1): ([1], 1), ("red", 2): ([0, 1], 2)}
    ix.write_table(ix.postings(docs.filter("doc_id = 2")), f"{tmp_path}/p/batch=1", "term")
    assert {(r.term, r.doc_id): (r.positions, r.tf) for r in ingest.read_postings(spark, f"{tmp_path}/p").collect()} == held
