"""Fixtures, models in plain Python, and behaviour that SQL can't show."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom import Engine
from textloom.functions import analysis
from textloom.functions.stemming import stem
from textloom.functions.stopwords import ENGLISH, RUSSIAN
from textloom.operators import dates, kv
from textloom.plans import query as q
from textloom.sources import textdir
from textloom.streaming import ingest

TEXTS = {
    "a_hello.txt": "Привет мир! Студент любит программирование и алгоритмы. Структуры данных и поиск.",
    "b_english.md": "Hello world! It talks about search engines, inverted index, and boolean queries.",
    "c_science.txt": "Мир программирования большой. Алгоритмы, структуры данных. Привет всем, кто изучает computer science.",
    "d_file.py": "Привет! Этот файл не про программирование. Отвлечься от алгоритмов.",
    "e_thing.txt": "Алгоритмы и структуры важная часть программирования.",
    "skipped.bin": "hello",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("docs")
    for name, text in TEXTS.items():
        (top / name).write_bytes(text.encode() + (b"\xff\n" if name[0] == "b" else b""))
    return top


@pytest.fixture(scope="module")
def engines(spark, folder, tmp_path_factory):
    build = lambda profile: Engine.from_folder(spark, str(folder), profile=profile).save(str(tmp_path_factory.mktemp(profile)))
    return {p: build(p) for p in analysis.PROFILES}


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_lists():
    assert len(ENGLISH) == 153 and len(RUSSIAN) == 151


def test_queries_on_files(engines):
    e = engines["surface"]
    assert e.n_docs == 5 and ids(e.term("Привет")) == [0, 2, 3]
    assert ids(e.query("привет AND мир")) == [0, 2] and ids(e.query("NOT привет")) == [1, 4]
    assert ids(e.query("the")) == [] and ids(e.query("NOT the")) == [0, 1, 2, 3, 4]
    assert ids(e.phrase("hello world")) == [1] and ids(e.phrase("структуры данных")) == [0, 2]
    assert ids(e.phrase("алгоритмы структуры")) == [0, 2, 4] and ids(e.phrase("the and")) == []
    assert ids(e.prefix("структ")) == [0, 2, 4] and ids(e.wildcard("при*т")) == [0, 2, 3]
    assert [r["term"] for r in e.wildcard_terms("*ts").collect()] == [] and [r["term"] for r in e.wildcard_terms("*orl*").collect()] == ["world"]
    assert e.ranked("hello", mode="exact").first()["doc_id"] == 1 and e.ranked("hello").first()["doc_id"] == 1
    assert e.ranked("the").count() == 0 and e.show(1).first()["head"].startswith("Hello") and e.list().count() == 5


def test_stems_unite_forms(engines):
    e = engines["stemmed"]
    assert ids(e.term("алгоритмы")) == [0, 2, 3, 4] and ids(e.wildcard("*ритм")) == [0, 2, 3, 4]


def test_add_skips_known_files(spark, folder, engines, tmp_path):
    (tmp_path / "new.txt").write_text("hello again")
    e = engines["surface"].add(str(tmp_path))
    assert ids(e.term("hello")) == [1, 5] and e.counts == {"added": 1, "skipped": 0, "failed": 0}
    again = e.add(str(folder))
    assert again.n_docs == 6 and again.counts == {"added": 0, "skipped": 5, "failed": 0}


def test_deltas_of_a_saved_engine(spark, folder, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "new.txt").write_text("hello hello fresh world")
    e = Engine.from_folder(spark, str(folder)).save(f"{tmp_path}/index")
    assert e.stats().first()["runs"] == 1 and e.corpus_stats.first()["docs"] == 5
    e = e.add(f"file://{tmp_path}/new").flush()
    assert e.stats().first()["runs"] == 2 and ids(e.term("hello")) == [1, 5] and ids(e.phrase("fresh world")) == [5]
    loaded = Engine.load(spark, f"{tmp_path}/index")
    assert loaded.n_docs == 6 and loaded.ranked("hello", mode="exact").count() == 2 and loaded.vocab.filter("term = 'hello'").first()["df"] == 2
    (tmp_path / "index" / "gen-0" / "delta-00000009" / "postings").mkdir(parents=True)  # a delta that was cut off
    assert Engine.load(spark, f"{tmp_path}/index").n_docs == 6
    whole = e.compact()
    assert whole.stats().first()["runs"] == 1 and whole.n_docs == 6 and ids(whole.term("hello")) == [1, 5] and whole.champions.filter("term = 'hello'").count() == 2
    assert sorted(map(tuple, whole.postings.select("term", "doc_id", "tf").collect())) == sorted(map(tuple, Engine(spark, whole.docs).tf.select("term", "doc_id", "tf").collect()))
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["gen-1"]


def test_rebuild_reads_the_files_again(spark, tmp_path):
    top = tmp_path / "docs"
    top.mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three")):
        (top / name).write_text(text)
    e = Engine.from_folder(spark, f"file://{top}").set_meta(2, date="20240101")
    (top / "a.txt").write_text("changed")
    (top / "b.txt").unlink()
    e = e.rebuild()
    assert ids(e.docs) == [0, 2] and ids(e.term("changed")) == [0] and ids(e.query("DATE[20240101,20240101]")) == [2]


def test_ids_are_dense_over_many_partitions(spark):
    rows = spark.range(400_000, numPartitions=16).select(F.sha1(F.col("id").cast("string")).alias("path"))
    got = textdir.numbered(rows, "path", 5).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).first()
    assert (got["n"], got["a"], got["z"]) == (400_000, 5, 400_004)
    few = [r["path"] for r in textdir.numbered(rows.limit(500), "path").orderBy("doc_id").collect()]
    assert few == sorted(few)


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from textloom.scratch import shared_root

    none = N(get=lambda *a: None)
    cluster = N(conf=none, sparkContext=N(master="yarn", getConf=lambda: none))
    with pytest.raises(RuntimeError):
        shared_root(cluster)


def test_boolean_ignores_other_columns(spark, engines):
    docs = engines["surface"].docs.withColumn("f0", F.lit(1)).withColumn("_has0", F.lit(1)).withColumn("term", F.lit("x"))
    from textloom.operators import search

    assert ids(search.boolean(docs, engines["surface"].tf, "hello OR мир")) == [0, 1, 2]


def test_postings_invariants(engines):
    p = engines["surface"].postings
    ordered = F.array_sort(F.array_distinct("positions"))
    assert p.filter((F.size("positions") != F.col("tf")) | (ordered != F.col("positions"))).count() == 0


def test_all_parts_and_repeated_query_words(engines):
    e = engines["surface"]
    assert ids(e.query("zzz_hello", all_parts=True)) == [1] and ids(e.query("zzz_hello")) == []
    assert e.ranked("hello hello world", mode="exact").first()["doc_id"] == 1


def test_stemmer():
    english = {"caresses": "caress", "ponies": "poni", "running": "run", "generously": "generous", "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "consistency": "consist", "knightly": "knight", "kneeling": "kneel", "cries": "cri", "happy": "happi", "enjoy": "enjoy"}
    russian = {"алгоритмов": "алгоритм", "программирования": "программирован", "важная": "важн", "книги": "книг", "вавиловка": "вавиловк", "валяется": "валя", "важнейшие": "важн", "падаль": "падал"}
    assert {w: stem(w, "english") for w in english} == english
    assert {w: stem(w, "russian") for w in russian} == russian


@pytest.mark.parametrize("bad", ["", "a b", "(a", "a)", "AND a", "a OR", "NOT", "()"])
def test_malformed_queries(bad):
    with pytest.raises(ValueError):
        q.parse(bad)


def test_loose_operators():
    assert q.parse("notebook") == q.Word("notebook") and q.parse("notebook", True) == q.Not(q.Word("ebook"))


TREES = st.recursive(st.sampled_from(["red", "green", "blue"]), lambda t: st.one_of(st.tuples(st.just("NOT"), t), st.tuples(t, st.sampled_from(["AND", "OR"]), t)), max_leaves=6)


@given(TREES, st.sets(st.sampled_from(["red", "green", "blue"])))
@settings(max_examples=80, deadline=None)
def test_parser_matches_sets(tree, held):
    text = lambda t: t if isinstance(t, str) else f"NOT ({text(t[1])})" if t[0] == "NOT" else f"({text(t[0])} {t[1]} {text(t[2])})"
    truth = lambda t: t in held if isinstance(t, str) else not truth(t[1]) if t[0] == "NOT" else truth(t[0]) and truth(t[2]) if t[1] == "AND" else truth(t[0]) or truth(t[2])

    def run(t):
        if isinstance(t, q.Word):
            return t.text in held
        if isinstance(t, q.Not):
            return not run(t.arg)
        return run(t.left) and run(t.right) if t.op == "AND" else run(t.left) or run(t.right)

    assert run(q.parse(text(tree))) == truth(tree)


@given(st.text(alphabet="ab*", min_size=1, max_size=6), st.text(alphabet="ab", max_size=6))
@settings(max_examples=150, deadline=None)
def test_grams_never_lose_a_match(pattern, word):
    if re.match(analysis.wildcard_regex(pattern), word) and word:
        padded = f"${word}$"
        own = {padded[i : i + 3] for i in range(len(padded) - 2)}
        assert set(analysis.pattern_grams(pattern)) <= own


def test_date_predicates(spark):
    rows = [(0, "20240101", "20200101", None), (1, "20240131", "20201231", "20211231"), (2, "20240201", "20210101", "20220101"), (3, None, "20240101", None), (4, "20231231", None, "20230101")]
    docs = spark.createDataFrame(rows, "doc_id long, date string, start_date string, end_date string")
    assert ids(docs.filter(dates.date_range("20240101", "20240131"))) == [0, 1]
    assert ids(docs.filter(dates.appeared("20200101", "20201231"))) == [0, 1]
    assert ids(docs.filter(dates.valid("20220101", "20231231"))) == [0, 2]
    assert docs.limit(1).select(dates.previous_day(F.lit("20240301"))).first()[0] == "20240229"
    assert dates.set_meta(docs, 3, date="20240115").filter("date = '20240115'").count() == 1
    assert dates.parse_assignments("date=20240101 end=null") == {"date": "20240101", "end_date": None}
    with pytest.raises(ValueError):  # after the end that is stored
        dates.set_meta(docs, 4, start_date="20240101")
    with pytest.raises(KeyError):
        dates.set_meta(docs, 99, date="20240101")
    for bad in ("date=1", "x=20240101", "start=20240101 end=20230101"):
        with pytest.raises(ValueError):
            dates.parse_assignments(bad)
    assert dates.violations(docs).count() == 0


def test_store(spark, tmp_path):
    s = kv.Store(spark, f"file://{tmp_path}/kv", memtable_limit=5, max_deltas=3)
    for k, v in (("alice", b"1"), ("bob", b"2"), ("carol", b"3"), ("bob", b"22"), ("dave", b"4")):
        s.put(k, v)
    s.flush()
    pairs = lambda df: [(r["key"], bytes(r["value"]).decode()) for r in df.collect()]
    assert s.get("bob") == b"22" and pairs(s.scan("b", "d", 10)) == [("bob", "22"), ("carol", "3")]
    s.delete("carol")
    s.flush()
    s.put("zero", b"\x00")
    assert s.get("carol") is None and s.get("zero") == b"\x00"
    assert pairs(s.scan("a", "y", 50)) == [("alice", "1"), ("bob", "22"), ("dave", "4")]
    s.compact()
    again = kv.Store(spark, f"file://{tmp_path}/kv")
    assert pairs(again.scan("a", "y")) == [("alice", "1"), ("bob", "22"), ("dave", "4")] and again.stats()["runs"] == 1
    again.append(spark.createDataFrame([("eve", b"5", False), ("bob", None, True)], "key string, value binary, is_delete boolean"))
    assert again.get("bob") is None and again.get("eve") == b"5"


def test_interrupted_compaction_loses_nothing(spark, tmp_path):
    s = kv.Store(spark, f"file://{tmp_path}/kv")
    s.put("a", b"1")
    s.put("b", b"2")
    s.compact()
    (tmp_path / "kv" / "gen-2" / "delta-1").mkdir(parents=True)  # the next one was cut off before its _DONE
    again = kv.Store(spark, f"file://{tmp_path}/kv")
    assert again.get("a") == b"1" and again.get("b") == b"2" and again.stats()["runs"] == 1
    again.put("a", b"3")
    again.compact()
    assert kv.Store(spark, f"file://{tmp_path}/kv").get("a") == b"3"


def test_merging_store(spark, tmp_path):
    s = kv.MergingStore(spark, f"file://{tmp_path}/m", max_deltas=2)
    s.put("x", {1, 2})
    s.flush()
    s.put("x", {2, 3})
    s.put("y", {7})
    held = lambda df: sorted(r["member"] for r in df.collect())
    assert held(s.get("x")) == [1, 2, 3] and held(s.get("z")) == []
    s.append(spark.createDataFrame([("x", 9), ("x", 9)], kv.MEMBERS))
    s.flush()
    assert s.stats()["runs"] == 1  # more than max_deltas: merged
    again = kv.MergingStore(spark, f"file://{tmp_path}/m")
    assert held(again.get("x")) == [1, 2, 3, 9] and [r["key"] for r in again.keys().collect()] == ["x", "y"] and again.rows().count() == 5
    assert [tuple(r) for r in again.scan("x", "x").collect()] == [("x", m) for m in (1, 2, 3, 9)]


def test_batched_reads(spark):
    log = spark.createDataFrame([(f"k{i:03d}", b"v", i, i % 5 == 0) for i in range(50)], kv.SCHEMA)
    assert kv.get_many(log, spark.createDataFrame([("k001",), ("k005",), ("none",)], "key string")).count() == 1
    got = kv.scan_many(log, spark.createDataFrame([("k01", "k019"), ("k030", "k03~")], "low string, high string"), limit=3, prefix=2).collect()
    assert sorted((r["low"], r["key"]) for r in got) == [("k01", "k011"), ("k01", "k012"), ("k01", "k013"), ("k030", "k031"), ("k030", "k032"), ("k030", "k033")]
    assert kv.keys(log).count() == 40


@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.integers(0, 3).map(float)), max_size=40))
@settings(max_examples=8, deadline=None)
def test_percentiles(spark, values):
    from textloom.operators import stats

    got = {r["p"]: r["value"] for r in stats.percentiles(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()}
    held = sorted(v for v in values if v is not None)
    assert got == {float(p): held[int(p / 100 * (len(held) - 1))] for p in (50, 95, 99) if held}


def test_percentiles_of_many_values(spark, monkeypatch):
    from textloom.operators import stats

    monkeypatch.setattr(stats, "FEW", 10)
    rows = spark.range(30_000).select((F.col("id") * F.col("id") % 7919).cast("double").alias("x"))
    held = sorted(r["x"] for r in rows.collect())
    assert {r["p"]: r["value"] for r in stats.percentiles(rows, "x").collect()} == {float(p): held[int(p / 100 * 29_999)] for p in (50, 95, 99)}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "tion ing"), (2, "ing")], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    ingest.stream_postings(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert ingest.read_postings(spark, f"{tmp_path}/out").filter("term = 'ing'").count() == 2
    merged = Engine(spark, spark.createDataFrame([(9, "ing")], "doc_id long, text string")).add_stream(f"{tmp_path}/out")
    assert ids(merged.filter("term = 'ing'")) == [1, 2, 9]


def test_streamed_writes_reach_the_store(spark, tmp_path):
    spark.createDataFrame([("a", "1", 1, False), ("b", "2", 2, False), ("a", None, 3, True)], "key string, value string, seq long, is_delete boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, value string, seq long, is_delete boolean").parquet(f"{tmp_path}/in")
    ingest.stream_kv(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert ingest.read_kv(spark, f"{tmp_path}/out").count() == 3
    s = kv.Store(spark, f"file://{tmp_path}/kv")
    assert s.append_stream(f"file://{tmp_path}/out") == 3 and s.append_stream(f"file://{tmp_path}/out") == 0
    assert s.get("a") is None and s.get("b") == b"2" and s.seq == 3
    s.compact()
    assert s.append_stream(f"file://{tmp_path}/out") == 3 and s.get("a") is None and s.get("b") == b"2"


def test_ids_follow_paths(spark, folder):
    rows = textdir.documents(spark, str(folder)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(5)) and [r["path"] for r in rows] == sorted(r["path"] for r in rows)
