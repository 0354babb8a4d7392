"""Each operator against brute force, SQL or an exact round trip, and on odd rows."""

import hashlib
import html
import math
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import same
from textloom.llm import lcs, op01_toxicity, op02_mixing, op03_simhash, op04_topk, op05_chat, op06_language, op07_html, op08_tokens, op09_decontaminate, op10_substrings, queries
from textloom.llm.common import Scratch, bounded_sample
from textloom.llm.components import components
from textloom.llm.trees import Boosted, Isotonic

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, "no id here at all", "en", None, 1), (4, "same words once more", "en", "b", 2),
    (5, "same words once more", "en", "b", 2), (5, "same words once more", "en", "b", 2), (6, "x" * 5000 + " " + "long text " * 3000, "fr", "b", 9), (7, "1234 !!! ...", None, "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long rows, and a column whose name clashes with internal ones."""
    return spark.createDataFrame(ODD, DOC).withColumn("tie", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("score", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLE[name], DATA)


# op1
def test_toxicity(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out]
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.7
    model = op01_toxicity.fit(docs, labels)
    assert op01_toxicity.score(odd, model).count() == len(ODD) and op01_toxicity.score(none, model).count() == 0
    assert 0 <= op01_toxicity.fit(docs, labels.limit(0)).score(["any", None, ""])[1] <= 1


def test_toxicity_of_held_out_documents(spark):
    """No word is given: what the labels outside the fold teach is enough for the fold."""
    d = "/root/testdata/sf0.1"
    got = queries.toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    pos, neg = got[got.toxic == 1], got[got.toxic == 0]
    wins = (pos.score.to_numpy()[:, None] > neg.score.to_numpy()[None, :]).mean()
    assert len(pos) > 80 and wins > 0.98 and pos.predicted.mean() > 0.88 and neg.predicted.mean() < 0.01


def test_repeated_ids_teach_once(spark):
    rows = [(i % 40, f"text {i} " + ("vile " * 5 if i % 2 else "calm")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (op01_toxicity.fit(x, labels).score(["so vile", "calm", None, ""]) for x in (docs, docs.union(docs).repartition(7)))
    assert (one == two).all() and one[2] == one[3]


def test_lexicon_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    texts = [(" ".join([*(f"common{j}" for j in rng.choice(30, 5, replace=False)), *(["vile"] if i % 10 == 0 else [])]), int(i % 10 == 0)) for i in range(400)]
    rows = spark.createDataFrame(texts, "text string, toxic int")
    one, many = (op01_toxicity.learn_lexicon(rows.repartition(n)) for n in (1, 50))
    assert one == many and "vile" in one.strong and not any(w.startswith("common") for w in one.strong | one.weak)


def test_hidden_spellings():
    flags = op01_toxicity.Flags(op01_toxicity.Lexicon(frozenset({"idiot"}), frozenset()))
    assert flags["idiot,"] & op01_toxicity.HIT and flags["1d1ot"] & op01_toxicity.HIDDEN and flags["id.i.ot"] & op01_toxicity.HIDDEN
    assert op01_toxicity.features("you i d i o t now", flags)[-1] > 0


@pytest.mark.parametrize("at", [0, 30, 37, 200])
def test_spelled_words_are_found_at_any_offset(at):
    flags = op01_toxicity.Flags(op01_toxicity.Lexicon(frozenset({"idiot", "foolish*"}), frozenset()))
    run = lambda s: op01_toxicity.features(" ".join(s), flags)[-1]
    assert run("z" * at + "idiot") == run("z" * at + "idiot" + "z" * 9) == math.log1p(1) and run("z" * at + "idio") == 0


@given(st.lists(st.tuples(st.floats(-5, 5), st.booleans()), min_size=1, max_size=60))
@settings(max_examples=40, deadline=None)
def test_isotonic_is_monotone(rows):
    x, y = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
    assert (np.diff(Isotonic().fit(x, y).predict(np.sort(x))) >= -1e-12).all()


def test_trees_learn_a_conjunction():
    x = np.random.default_rng(1).random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    assert ((Boosted().fit(x, y).raw(x) > 0) == (y == 1)).mean() > 0.98


# op2
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_targets(sizes):
    got = op02_mixing.targets([(f"s{i}", n) for i, n in enumerate(sizes)])
    assert math.isclose(sum(got.values()), 1.5 * sum(sizes), rel_tol=1e-9, abs_tol=1e-6)
    assert all(got[f"s{i}"] <= 2 * n + 1e-9 for i, n in enumerate(sizes))


def test_mixing(spark, odd, none):
    assert op02_mixing.mix(none, Scratch(spark)).count() == 0
    rows = op02_mixing.mix(odd, Scratch(spark)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")).alias("source"))
    taken = op02_mixing.take(docs, Scratch(spark))
    assert taken.columns == docs.columns
    counts = lambda df, n: {(r["doc_id"], r["source"]): r["n"] for r in df.groupBy("doc_id", "source").agg(n.alias("n")).filter("n > 0").collect()}
    assert counts(taken, F.count(F.lit(1))) == counts(op02_mixing.mix(docs, Scratch(spark)), F.sum("copies"))
    by = op02_mixing.mix(docs, Scratch(spark)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["w"]) <= r["m"] for r in by)


def test_mixing_of_repeated_rows(spark):
    """Null and repeated ids, and equal rows, are told apart; an id in two sources counts for each."""
    rows = [(None, f"w{i} x y z", "a", i) for i in range(1000)] + [(7, "same text again", "b", i) for i in range(900)] + [(i % 9, f"t{i} u v", s, i) for i in range(300) for s in ("c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(5)
    out = op02_mixing.mix(docs, Scratch(spark))
    by = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("size").alias("m")).collect()
    assert len(by) == 4 and all(abs(r["t"] - r["w"]) <= r["m"] for r in by) and out.filter("taken > 2 * size").count() == 0
    taken = op02_mixing.take(docs, Scratch(spark))
    words = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum(op02_mixing.size(F.col("text"))).alias("n")).collect()}
    assert words == {r["source"]: r["t"] for r in by} and taken.groupBy("row", "source").count().filter("count > 2").count() == 0
    again = op02_mixing.mix(docs.repartition(3), Scratch(spark))
    assert sorted((r["source"], r["t"]) for r in again.groupBy("source").agg(F.sum("taken").alias("t")).collect()) == sorted((r["source"], r["t"]) for r in by)


# op3
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(fps):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    return label


@given(st.text(max_size=80))
@settings(max_examples=80, deadline=None)
def test_fingerprint(text):
    assert op03_simhash.fingerprint(text.encode("utf-8", "ignore")) == brute_fingerprint(text.encode("utf-8", "ignore").decode())


@pytest.mark.parametrize("crowded", [128, 1])
def test_links(spark, crowded):
    """Chains and balls of near fingerprints, with the finer table off and on."""
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 64, n)) for b in base for n in (0, 1, 2, 3, 4, 2, 1)} | {0, 1, 3, 7, 15, 31})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    s = Scratch(spark)
    roots = {r["node"]: r["root"] for r in components(op03_simhash.links(df, s, crowded), s).collect()}
    want = brute_classes(fps)
    mine = [roots.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps]
    assert all((want[i] == want[j]) == (mine[i] == mine[j]) for i in range(len(fps)) for j in range(i))


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=2))
@settings(max_examples=200, deadline=None)
def test_near_fingerprints_share_a_cell(fp, bits):
    """The lattice argument behind the join key, and the bound that every pivot's distance obeys."""
    other = fp
    for b in bits:
        other ^= 1 << b
    cell = lambda x: [(x.bit_count() - (x ^ p).bit_count() + op03_simhash.BLOCK) // 2 for p in op03_simhash.BLOCKS]

    def sent(x):
        at = cell(x)
        return {tuple(at), *(tuple(at[:i] + [at[i] + s] + at[i + 1 :]) for i in range(16) for s in (1, -1) if 0 <= at[i] + s <= op03_simhash.BLOCK)}

    assert sent(fp) & sent(other)
    far = op03_simhash.table(np.array([fp, other], np.uint64)).astype(int)
    assert (abs(far[0] - far[1]) <= 2).all()


def test_cells_give_the_links_of_brute_force(spark):
    """Cells of all sizes, on fingerprints crowded into few bits so that cells overlap."""
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**13, 240, dtype=np.uint64) << np.uint64(20))
    links = {tuple(sorted(e)) for e in op03_simhash.cell_links(fps)}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    s = Scratch(spark)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components(op03_simhash.links(df, s), s).collect()}
    want = brute_classes([int(f) for f in fps])
    mine = [roots.get(int(f), int(f)) for f in fps]
    assert len(set(zip(want, mine, strict=True))) == len(set(want)) == len(set(mine))


def test_simhash_query(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    fps = [brute_fingerprint(t) for t in docs.text]
    label = brute_classes(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.simhash(spark, DATA).collect()}
    first = {}
    for i, k in sorted(zip(docs.doc_id, label, strict=True)):
        first.setdefault(k, i)
    assert got == {i: (f"{f:016x}", first[k]) for i, f, k in zip(docs.doc_id, fps, label, strict=True)}
    rows = op03_simhash.classes(odd, Scratch(spark)).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["fp"] == 0} == {1}
    assert op03_simhash.classes(none, Scratch(spark)).count() == 0


# op4
def test_topk_odd(spark):
    schema = "vec_id long, embedding array<float>, v int"
    rows = [(0, [1.0, 0.5], 1), (100, [float("nan"), 1.0], 1), (200, None, 1), (300, [None, 1.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (None, [1.0, 1.0], 1), (3, [-1.0, 0.0], 1)]
    got = op04_topk.search(spark.createDataFrame(rows, schema), Scratch(spark), k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 2)]
    assert op04_topk.search(spark.createDataFrame([], schema), Scratch(spark)).count() == 0
    big = [(0, [], 1), (5, [], 1), (100, [3e38, 1.0], 1), (7, [3e38, -1.0], 1), (8, [-3e38, 0.0], 1), (9, [1e-3, 2.0], 1), (200, [1.0, 1.0], 1)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in op04_topk.search(spark.createDataFrame(big, schema), Scratch(spark)).collect()}
    assert got[0, 1] == (5, 0) and (0, 2) not in got and got[100, 1] == (7, op04_topk.LIMIT) and got[100, 4] == (8, -op04_topk.LIMIT) and got[200, 1][1] == op04_topk.LIMIT
    assert got[200, 3] == (9, 1024 + 2048 * 1024) and len(got) == 9


@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=6), st.sampled_from([1, 2**20]))
@settings(max_examples=60, deadline=None)
def test_products_are_exact(rows, scale):
    a = np.array(rows, np.int64)
    a[0] *= scale
    want = [[max(-op04_topk.LIMIT, min(op04_topk.LIMIT, sum(int(x) * int(y) for x, y in zip(q, v)))) for v in a] for q in a]
    assert op04_topk.products(a, a).tolist() == want


# op5
def test_events(spark):
    rows = [
        (1, 0, "message", None, "user", "a <b> \\l"), (1, 1, "start", "m", "assistant", "He"), (1, 2, "delta", "m", None, "llo"), (1, 3, "regenerate", "m", None, None),
        (1, 4, "delta", "m", None, "Hi "), (1, 5, "delta", "m", None, "</turn>\n"), (1, 7, "start", "x", "assistant", "gone"), (1, 8, "delete", "x", None, None),
        (1, 9, "start", "y", "assistant", "old"), (1, 10, "edit", "y", None, "new"), (1, 11, "delta", "y", None, "er"), (1, 12, "message", None, None, None),
        (2, None, "message", None, "assistant", "t"), (2, None, "message", None, "assistant", "t"), (None, 1, "message", None, "u>\n", "z"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, op string, msg_id string, role string, text string").withColumn("turns", F.lit(1))
    back = {r["conv_id"]: r for r in op05_chat.read_back(op05_chat.render(op05_chat.reconstruct(events))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "a <b> \\l"), ("assistant", "Hi </turn>\n"), ("assistant", "newer"), ("", "")]
    assert back[1]["loss_text"] == "Hi </turn>\nnewer" and back[1]["formatted"].count("</turn>") == 4
    assert back[2]["loss_text"] == "tt" and [tuple(t) for t in back[None]["turns"]] == [("u>\n", "z")]
    assert op05_chat.render(op05_chat.reconstruct(events.limit(0))).count() == 0


def test_chat_hashes(spark):
    got = {r["conv_id"]: r for r in queries.chat(spark, DATA).collect()}[-7]
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{queries.TRICKY}\nassistant\n{queries.TRICKY}\n".encode()).hexdigest()


# op6
def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all() and held.rejected.mean() < 0.05
    model = op06_language.fit(docs)
    rows = op06_language.classify(odd, model).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 7)} == {"und"}
    assert op06_language.accepted(odd, model).columns == odd.columns
    assert op06_language.classify(none, op06_language.fit(none)).count() == 0


def test_language_without_ids(spark):
    """Rows of one id or none teach like any others, and copies of a text once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.when(F.col("lang") != "en", None).otherwise(8).cast("long"))
    model = op06_language.fit(docs.union(docs))
    assert sorted(model.dictionaries) == ["de", "en", "es", "fr"] and model.dictionaries == op06_language.fit(docs.repartition(9)).dictionaries
    assert all(1000 < len(d) < 1.05 * op06_language.DICTIONARY for d in model.dictionaries.values())
    long = spark.createDataFrame([(1, "abc " * 200_000, "xx")], "doc_id long, text string, lang string")
    assert len(op06_language.fit(long).dictionaries["xx"]) <= op06_language.DICTIONARY


# op7
def test_html(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas()
    got = {r["page_id"]: r for r in queries.html(spark, DATA).collect()}
    for r in pages.itertuples():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", body)).split())
        assert got[r.page_id]["text"] == want and got[r.page_id]["n_chars"] == len(want)


def test_page_differencing(spark):
    page = lambda body: f"<body><div>Site name</div><div class='cookie-notice'>We use</div>{body}<div>Legal line</div></body>"
    rows = [
        (1, "http://a.b/x/1", page("<p>One &amp; only</p><p>Two</p>"), 0), (2, "http://a.b/x/2", page("<p>Other  text</p><div id=comments>Nice</div>"), 0), (3, None, None, 0),
        (4, "http://a.b/x/2?z", "", 0), (5, "http://c.d/", "<article><header><h1>T</h1>by</header>b<script>x</script><form>f</form><!-- c --></article><aside>s</aside>", 0), (6, "http://c.d/", "<p>cut <b", 0),
        (7, "http://e.f/1", "<div>Top</div><article><p>Brand</p><p>Mine</p><p>Quote</p><p>End one</p></article>", 0),
        (8, "http://e.f/2", "<div>Top</div><article><p>Brand</p><p>Yours</p><p>Quote</p><p>End two</p></article>", 0), (1, "http://a.b/x/1", page("<p>One &amp; only</p><p>Two</p>"), 0),
    ]
    got = [(r["page_id"], r["text"]) for r in op07_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, key int"), Scratch(spark)).collect()]
    assert sorted(got) == [(1, "One & only Two"), (1, "One & only Two"), (2, "Other text"), (3, ""), (4, ""), (5, "T b"), (6, "cut"), (7, "Mine Quote End one"), (8, "Yours Quote End two")]
    assert op07_html.extract(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark)).count() == 0


def brute_deleted(own, near):
    """Differencing by the textbook table: lengths of common subsequences of all beginnings."""
    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    lines, kinds, sizes = own
    for other in near:
        kept = list(range(len(lines)))
        for i in range(len(lines)):  # a line is shared if the rest has a shorter common subsequence
            less = [x for x in kept if x != i]
            if common([lines[x] for x in less], other) == common([lines[x] for x in kept], other):
                kept = less
        if sum(sizes[i] for i in kept if kinds[i]) <= 0.8 * sum(n for n, k in zip(sizes, kinds) if k):
            return kept
    return []


def test_differencing_is_the_brute_force_one_on_any_partitions(spark):
    """Pages of one host without containers, their order and the table by brute force; equal at 1, 8 and 64 partitions."""
    rng = np.random.default_rng(4)
    chrome = ["Site", "Menu a", "Menu b", "Legal", "Contact"]
    rows = []
    for i in range(90):
        body = [f"text {i} {j}" for j in range(rng.integers(3, 6))] if i % 7 else rows[-1][3] if rows else ["first"]
        top = chrome[: rng.integers(2, 4)]
        rows.append((i, f"http://h.i/{i // 10}/{i}", "".join(f"<div>{t}</div>" for t in [*top, *body, *chrome[3:]]), body))
    docs = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = [sorted((r["page_id"], r["text"]) for r in op07_html.extract(docs.repartition(n), Scratch(spark)).collect()) for n in (1, 8, 64)]
    assert got[0] == got[1] == got[2]
    key = lambda r: (r[1].removeprefix("http://h.i"), hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest())
    order = sorted(rows, key=key)
    parsed = [op07_html.lines(r[2]) for r in order]
    table = [("h.i", key(r)[0], p[0]) for r, p in zip(order, parsed, strict=True)]
    want = []
    for i, r in enumerate(order):
        gone = set(brute_deleted(parsed[i], op07_html.nearest(table, i)))
        want.append((r[0], " ".join(t for j, (_, t) in enumerate(op07_html.blocks(r[2])) if j not in gone)))
    assert got[0] == sorted(want) and sum("Site" in t for _, t in want) < 5


def test_partners_beyond_any_number_of_copies(spark):
    """Pages between more copies than a page's neighbourhood, or a block of the pairing, holds: exact and near copies, and families of them by turns."""
    rng = np.random.default_rng(7)
    page = lambda body: "".join(f"<div>{t}</div>" for t in ["Site", "Menu", *body, "Legal"])
    rows = []
    for host, runs in (("a.b", (40, 0, 25, 60)), ("c.d", (12,)), ("e.f", (150, 1)), ("g.h", (90,))):
        urls = iter(range(1000))
        for run, n in enumerate(runs):
            for i in range(n):
                body = [f"a long line of article {run if host != 'g.h' else i % 3 // 2} numbered {j}" for j in range(8)]
                if i % 3:  # a near copy: some lines of its own, in places of its own
                    body[rng.integers(8)] = f"changed {i % 5}" * rng.integers(1, 3)
                rows.append((len(rows), f"http://{host}/{'xy'[run % 2]}/{next(urls):03}", page(body)))
            rows.append((len(rows), f"http://{host}/{'xy'[run % 2]}/{next(urls):03}", page([f"own words {host} {run}"] if host != "c.d" else [])))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], r[1], r[0]))
    parsed = [op07_html.lines(r[2]) for r in order]
    table = [(r[1].split("/")[2], r[1][len("http://a.b") :], p[0]) for r, p in zip(order, parsed, strict=True)]
    want, alone = [], 0
    for i, r in enumerate(order):
        own = Counter(parsed[i][0])
        size_of = dict(zip(parsed[i][0], parsed[i][2], strict=True))
        near = sorted((-len(commonprefix([table[i][1], t[1]])), abs(i - j), j, t[2]) for j, t in enumerate(table) if j != i and t[0] == table[i][0])
        partner = next((x for *_, x in near if sum(size_of[h] * n for h, n in (own & Counter(x)).items()) <= 0.8 * sum(parsed[i][2])), None)
        alone += partner is None
        gone = set(brute_deleted(parsed[i], [] if partner is None else [partner]))
        want.append((r[0], " ".join(t for j, (_, t) in enumerate(op07_html.blocks(r[2])) if j not in gone)))
    assert alone == sum("Site" in t for _, t in want) == 1
    for size in ((), (8,), (11,), (64,)):
        got = [(r["page_id"], r["text"]) for r in op07_html.extract(docs, Scratch(spark), *size).collect()]
        assert sorted(got) == sorted(want)


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.sampled_from([1 << 28, 20]))
@settings(max_examples=150, deadline=None)
def test_common_subsequences(a, b, table):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    old, lcs.TABLE = lcs.TABLE, table
    try:
        x = [a[i] for i in sorted(lcs.shared(a, b))]
    finally:
        lcs.TABLE = old
    rest = iter(b)
    assert len(x) == t[-1][-1] and all(c in rest for c in x)


def test_repeated_lines_are_aligned_fast():
    import time

    began = time.time()
    assert len(lcs.shared(["x"] * 10_000, ["x"] * 9_000 + ["y"])) == 9_000
    assert len(lcs.shared(["x", "y"] * 5_000, ["y", "x", "x"] * 3_000)) >= 6_000 and time.time() - began < 2


# op8
@given(st.lists(st.integers(0, 60), max_size=900))
@settings(max_examples=40, deadline=None)
def test_code_round_trip(ids):
    ids = np.array([i * i for i in ids], np.uint32)
    counts = np.bincount(ids, minlength=3601)
    lengths = op08_tokens.code_lengths(counts)
    assert lengths.max(initial=0) <= op08_tokens.LIMIT and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    payload, marks = op08_tokens.pack(ids, lengths, op08_tokens.codes(lengths))
    assert (op08_tokens.unpack(payload, len(ids), marks, op08_tokens.decode_table(lengths)) == ids).all()


def test_limited_lengths():
    lengths = op08_tokens.code_lengths(np.array([2**i for i in range(40)]))
    assert lengths.max() == op08_tokens.LIMIT and sum(2.0 ** -int(n) for n in lengths) == 1


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(queries.TOKENIZER), 0, []
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_tokens(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    assert sorted(map(tuple, queries.tokens(spark, DATA).collect())) == brute_tokens([(r["doc_id"], r["text"]) for r in docs])
    got = op08_tokens.read(*op08_tokens.write(odd, queries.TOKENIZER, Scratch(spark))).orderBy("start").collect()
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r) for r in got] == brute_tokens([(r[0], r[1]) for r in want])
    assert op08_tokens.read(*op08_tokens.write(none, queries.TOKENIZER, Scratch(spark))).count() == 0


@given(st.text(alphabet="ab'DonT éÉßİΣς1<|endoftext|>\n\t.,!?日", max_size=60))
@settings(max_examples=100, deadline=None)
def test_keys_encode_like_the_text(text):
    from tokenizers import Tokenizer

    w = op08_tokens.words(queries.TOKENIZER)
    assert np.frombuffer(next(w.batch(pa.array([text])))[0].as_py(), "<u4").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_keep_each_key_once():
    w = op08_tokens.Words(queries.TOKENIZER)
    texts = [f"{x} {x.title()} {x.upper()}, {x}." for x in ("river", "stone", "élan", "straße")] + [None, ""]
    for _ in range(2):
        found = [np.frombuffer(x.as_py(), "<u4").tolist() for part in w.batch(pa.array(texts)) for x in part]
        assert found == [w.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    # STRASSE, is what upper() makes of straße; the empty key stands for runs without marks
    assert sorted(w) == sorted(["", ",", ".", "river", "stone", "élan", "straße", "strasse"]) and w.light is not w.tokenizer


@pytest.mark.parametrize("limit", [0, 3, 800_000])
def test_words_of_every_letter(limit, monkeypatch):
    monkeypatch.setattr(op08_tokens.Words, "LIMIT", limit)
    w = op08_tokens.Words(queries.TOKENIZER)
    texts = [f"{c} x{c}y {c}{c.upper()}.,! .{c} {c}'s <{c}> A{c}\u0301 {c * 70}" for c in map(chr, [*range(0x250), 0x3A3, 0x65E5, 0x1F600])]
    for _ in range(2):
        found = [np.frombuffer(x.as_py(), "<u2").tolist() for part in w.batch(pa.array(texts), "<u2") for x in part]
        assert found == [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(w) <= limit and len(w.starts) == len(w) + 1 and w.starts[-1] == len(w.ids)


def test_kept_keys_take_little_memory():
    w, n = op08_tokens.Words(queries.TOKENIZER), 40_000
    letters = np.random.default_rng(1).integers(97, 123, (n, 9), dtype=np.uint8)
    texts = pa.array([" ".join(x.tobytes().decode() for x in part) for part in np.array_split(letters, 8)])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for row in range(len(texts)):
        assert sum(map(len, w.batch(texts[row : row + 1]))) == 1
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(w) > 0.99 * n and held < 100 * len(w)


def test_keys_of_equal_hash(monkeypatch):
    monkeypatch.setattr(op08_tokens.xxhash, "xxh3_64_intdigest", len)
    w = op08_tokens.Words(queries.TOKENIZER)
    for texts in (["tree rain tree 12 a,b a.b"], ["snow rain 34 tree !?"], ["hail hail's 12 snow", "rain"]):
        found = [np.frombuffer(x.as_py(), "<u4").tolist() for part in w.batch(pa.array(texts)) for x in part]
        assert found == [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(set(map(len, w))) == len(w) == len(w.starts) - 1


def test_flat_rows():
    raw = [b"ab", b"", b"cdef", b"gh"]
    for kind in (pa.binary(), pa.large_binary()):
        for start in range(5):
            ids, stops = op08_tokens.flat(pa.array(raw, kind)[start:], "<u2")
            assert ids.tobytes() == b"".join(raw[start:]) and stops.tolist() == np.cumsum([0, *(len(r) // 2 for r in raw[start:])]).tolist()


# op9
def test_masks_meet_every_window_with_two_substitutions():
    masks, window = op09_decontaminate.MASKS, op09_decontaminate.WINDOW
    lost = window - math.ceil(op09_decontaminate.SIMILARITY * window)
    assert lost == 2
    for changed in combinations(range(window), lost):
        placed = ({s + j for j, c in enumerate(m) if c == "1"} for m in masks for s in range(window - len(m) + 1))
        assert any(not p & set(changed) for p in placed), changed


@pytest.mark.parametrize("n", range(1, 13))
def test_short_items_are_found_with_every_substitution(n):
    """All substitutions up to the stated share, at any place of a text; one more is too many."""
    item = [f"word{i}" for i in range(n)]
    index = op09_decontaminate.Index([(1, " ".join(item))])
    lost = n - math.ceil(0.8 * n - 1e-9)
    for k in range(lost + 2):
        for changed in combinations(range(n), min(k, n)):
            text = " ".join(["a", "b", *("other" if i in changed else w for i, w in enumerate(item)), "c"])
            assert bool(index.overlaps(text)) == (len(changed) <= lost), changed


def test_overlaps_with_substitutions_by_brute_force():
    """Random texts over few words, items of all lengths: every window that agrees in 80 % is found, and no other."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(14)]
    for _ in range(60):
        items = [(i, " ".join(rng.choice(words, rng.integers(1, 22)))) for i in range(6)]
        text = list(rng.choice(words, 60))
        t = items[3][1].split()
        at = int(rng.integers(0, 60 - len(t)))
        text[at : at + len(t)] = ["x" if rng.random() < 0.15 else w for w in t]
        want = set()
        for i, item in items:
            w = item.split()
            n = min(13, len(w))
            if any(sum(w[a + k] == text[b + k] for k in range(n)) >= 0.8 * n - 1e-9 for a in range(len(w) - n + 1) for b in range(len(text) - n + 1)):
                want.add(i)
        assert {r[0] for r in op09_decontaminate.Index(items).overlaps(" ".join(text))} == want


def test_decontamination(spark, odd, none):
    item = " ".join(f"word{i}" for i in range(30))
    swapped = " ".join("other" if i % 9 == 4 else f"Word{i}," for i in range(30))
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny item", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, f"a b c {item} d", 0), (2, f"q {swapped}", 0), (3, " ".join(f"word{i}" for i in range(0, 30, 2)), 0), (4, None, 0), (5, "tiny item", 0)], "doc_id long, text string, item_id int")
    got = {r["doc_id"]: (r["item_id"], r["start"]) for r in op09_decontaminate.overlaps(docs, bench).collect()}
    assert got == {1: (1, 3), 2: (1, 1), 5: (4, 0)}
    assert sorted(r["doc_id"] for r in op09_decontaminate.clean(docs, bench).collect()) == [3, 4]
    assert op09_decontaminate.overlaps(odd, bench.limit(0)).count() == 0 and op09_decontaminate.overlaps(none, bench).count() == 0
    assert op09_decontaminate.clean(odd, bench).count() == len(ODD)


def test_all_verbatim_leaks_are_found(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    grams = {tuple(w[i : i + 13]) for t in bench.text for w in [t.lower().split()] for i in range(len(w) - 12)}
    want = {r.doc_id for r in docs.itertuples() if any(tuple(w[i : i + 13]) in grams for w in [r.text.lower().split()] for i in range(len(w) - 12))}
    got = {r["doc_id"] for r in queries.decontaminate(spark, "/root/testdata/sf0.01").collect()}
    assert want <= got and len(got) <= len(want) + 3


# op10
@given(st.binary(max_size=200))
@settings(max_examples=40, deadline=None)
def test_gear(data):
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(op10_substrings.GEAR[b])) % 2**32
        want.append(h)
    assert op10_substrings.gear(np.frombuffer(data, np.uint8)).tolist() == want


def test_substrings(spark, odd, none):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    rows = []
    for i in range(60):
        passage = text(60)
        rows += [(2 * i, f"{text(20 + i)} {passage} {text(9)}"), (2 * i + 1, f"{text(3 + 2 * i)}\n{passage}")]
    rows += [(1000 + i, text(80)) for i in range(60)] + [(2000, text(40) + " same" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    found = op10_substrings.shared_passages(docs, Scratch(spark))
    got = {r["doc_id"]: r["first_doc_id"] for r in found.collect()}
    assert {d for d in got if d >= 1000} == {2000} and len(got) == 121 and all(v == k - k % 2 for k, v in got.items() if k < 1000)
    cut = {r["doc_id"]: r["text"] for r in op10_substrings.remove_repeats(docs, op10_substrings.repeats(docs, Scratch(spark))).collect()}
    assert len(cut) == len(rows) and all(cut[d] == t for d, t in rows if (d % 2 == 0 or d >= 1000) and d < 2000)
    assert all(len(cut[d].split()) == 3 + d - 1 for d, _ in rows if d % 2 and d < 1000) and 40 < len(cut[2000].split()) < 200
    op10_substrings.shared_passages(odd, Scratch(spark)).collect()
    assert op10_substrings.shared_passages(none, Scratch(spark)).count() == 0


def test_every_long_passage_is_found_to_its_ends(spark):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))
    passages = [text(51) for _ in range(57)] + ["same " * 80, "one two " * 40, "a " * 80]
    rows, want = [], {}
    for i, p in enumerate(passages):
        rows += [(2 * i, f"{text(20 + i)} {p} {text(9)}"), (2 * i + 1, f"{text(3 + 2 * i)}\n{p}")]
        want |= {2 * i: (20 + i, len(p.split()), 2 * i), 2 * i + 1: (3 + 2 * i, len(p.split()), 2 * i)}
    found = op10_substrings.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    got = {r["doc_id"]: (r["start"], r["n_words"], r["first_doc_id"]) for r in found}
    assert len(found) == len(got) == 120 and all(got[i] == want[i] for i in range(114))
    # a passage that repeats one or two words agrees with itself everywhere; its ends may be a few words short
    assert all(got[i][2] == want[i][2] and got[i][1] >= want[i][1] - 6 for i in range(114, 120))


def test_every_word_of_a_repeat_stays_somewhere(spark):
    """The second part of a passage whose first part came earlier, repeats within a text, null ids."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    a, b, c, d = (text(80) for _ in range(4))
    rows = [(5, a), (9, f"{a} {b}"), (10, f"{' '.join(a.split()[40:])} {b}"), (20, f"{c} {text(9)} {c} {text(9)} {c}"), (None, f"{d} {text(5)}"), (None, f"{text(5)} {d}"), (5, a), (30, None), (31, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("cuts", F.lit(0))
    found = op10_substrings.repeats(docs, Scratch(spark))
    got = sorted(((r["doc_id"], r["n_words"]) for r in op10_substrings.shared_passages(docs, Scratch(spark)).collect()), key=repr)
    assert got == sorted([(5, 80), (9, 160), (10, 120), (20, 80), (20, 80), (20, 80), (None, 80), (None, 80)], key=repr)
    left = op10_substrings.remove_repeats(docs, found)
    assert left.columns == docs.columns and left.count() == len(rows)
    kept = [r["text"] for r in left.collect()]
    assert kept.count(a) == 2 and sum(b in (t or "") for t in kept) == 1  # document 5 stands twice and is one
    assert sum(c in (t or "") for t in kept) == 1 and sum((t or "").count(d) for t in kept) == 1 and sum((t or "").count(c) for t in kept) == 1


def test_places_are_held_in_parts(monkeypatch):
    words = [b"%d" % i for i in range(300)]
    text, places = b" ".join(words).decode(), [{"at": i, "side": i % 2} for i in range(300)]
    spans = [{"island": 1, "doc": 2, "first": 50, "end": 290}, {"island": 2, "doc": 2, "first": 3, "end": 10}]
    monkeypatch.setattr(op10_substrings, "HELD", 100, raising=False)
    found = list(op10_substrings._beside([pa.RecordBatch.from_pylist([{"row": 7, "text": text, "places": places}, {"row": 8, "text": None, "places": places[:1]}])]))
    assert max(b.num_rows for b in found) <= 100 // op10_substrings.BESIDE
    want = [(7, i, i % 2, words[i : i + 36] if i % 2 else words[max(0, i - 36) : i][::-1]) for i in range(300)] + [(8, 0, 0, [])]
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == want
    found = list(op10_substrings._windows(48)([pa.RecordBatch.from_pylist([{"row": 7, "text": text, "places": spans}])]))
    assert max(b.num_rows for b in found) <= 100
    digest = lambda k: xxhash.xxh3_64_intdigest(b" ".join(words[k : k + 48]))
    want = [(7, 1, 2, k, digest(k)) for k in range(14, 253)]
    assert [(r["row"], r["island"], r["doc"], r["at"], r["window"] % 2**64) for b in found for r in b.to_pylist()] == want


def test_passages_over_several_partners(spark):
    """Two pieces from different places aren't a passage; a passage whose pieces stand in earlier texts is one where two later texts share it."""
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    rows, piece = [], lambda t, a, z: " ".join(t.split()[a:z])
    for i in range(0, 200, 10):
        p, q, r = text(60), text(40), text(40)
        rows += [(i, f"{text(20)} {piece(p, 0, 40)} {text(20)}"), (i + 1, f"{text(20)} {piece(p, 20, 60)} {text(20)}"), (i + 2, f"{text(7)} {p} {text(30)}"), (i + 3, f"{text(30)} {p} {text(7)}")]
        rows += [(i + 4, f"{text(20)} {q} {text(20)}"), (i + 5, f"{text(20)} {r} {text(20)}"), (i + 6, f"{text(9)} {q} {r} {text(9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_words"]) for r in op10_substrings.shared_passages(docs, Scratch(spark)).collect()}
    assert got == {i + k: (n, 60) for i in range(0, 200, 10) for k, n in ((2, 7), (3, 30))}
    left = {r["doc_id"]: len(r["text"].split()) for r in op10_substrings.remove_repeats(docs, op10_substrings.repeats(docs, Scratch(spark))).collect()}
    assert all(left[i + k] == len(t.split()) for i in range(0, 200, 10) for k, t in ((k, dict(rows)[i + k]) for k in (0, 1, 4, 5, 6)))


def test_passages_of_documents_by_brute_force(spark):
    """Documents with a stretch of 50 words that stands elsewhere are found, those without one of 48 aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    words = {r.doc_id: (r.text or "").encode().split() for r in docs.itertuples()}

    def holders(n):
        seen = {}
        for i, w in words.items():
            for k in range(len(w) - n + 1):
                seen.setdefault(hash(tuple(w[k : k + n])), []).append(i)
        return {i for v in seen.values() if len(v) > 1 for i in v}

    got = {r["doc_id"] for r in queries.substrings(spark, "/root/testdata/sf0.01").collect()}
    assert holders(50) <= got <= holders(48)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_runs_of_chunks(pieces):
    """Equal sequences of chunks have equal digests wherever they stand, and runs end at the first chunk that fills them."""
    digest = np.array([hash((d, n)) & (2**63 - 1) for d, n in pieces], np.int64)
    size = np.array([n for _, n in pieces], np.int64)
    end = np.cumsum(size)
    a, z, h = op10_substrings.run_digests(digest, np.zeros(len(pieces), np.int64), end - size, end)
    want = {i: next((j for j in range(i, len(pieces)) if size[i : j + 1].sum() >= op10_substrings.RUN_WORDS), None) for i in range(len(pieces))}
    assert {int(i): int(j) for i, j in zip(a, z)} == {i: j for i, j in want.items() if j is not None}
    by = {}
    for i, j, x in zip(a, z, h):
        by.setdefault(tuple(pieces[i : j + 1]), set()).add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


@given(st.lists(st.sampled_from(["a", "bc", "def", "a"]), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_chunks_are_bounded(words):
    assert max(np.diff(op10_substrings.chunks(" ".join(words).encode())[2])) <= op10_substrings.VIEW


def test_sample_is_bounded(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("k"))
    assert all(120 < r["n"] < 280 for r in bounded_sample(rows, "k", 200).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect())


# pipeline
def test_stages_on_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
        rows = stage(spark, odd, DATA)
        assert name == "token ids" or rows.columns == odd.columns
        assert rows.count() == len(ODD) or name != "token ids"
    one = [(r["doc_id"], r["text"]) for r in p.one_of_each(spark, odd, DATA).collect()]
    texts = [t for _, t in one]
    assert len(one) == 5 and (4, "same words once more") in one and texts.count("no id here at all") == 1 and sum(i in (1, 2, 3) for i, _ in one) == 1
    assert p.uncontaminated(spark, odd, DATA).count() == len(ODD)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, steps = docs, {}
    s = Scratch(spark)
    for name, stage in p.STAGES[:-1]:
        kept = s.save(stage(spark, kept, DATA))
        assert kept.columns == docs.columns
        steps[name] = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    first, second, third, fourth = steps.values()
    assert len(first) > 0.9 * docs.count()
    label = brute_classes([brute_fingerprint(t) for _, t in first])
    low = {}
    for (i, _), k in zip(first, label, strict=True):
        low[k] = min(i, low.get(k, i))
    assert sorted(i for i, _ in second) == sorted(low.values())
    assert {i for i, _ in third} <= {i for i, _ in second} and {i for i, _ in fourth} <= {i for i, _ in third}
    got = sorted(tuple(r) for r in p.run(spark, DATA).collect())
    ids = sorted(fourth, key=lambda r: r[0])
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted((b[0], b[2], b[3]) for b in brute_tokens(ids)) and {g[1] for g in got} == {b[1] for b in brute_tokens(ids)}
