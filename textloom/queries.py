"""The registered queries of the engine and their SQL twins, over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.engine import Engine
from textloom.functions import analysis
from textloom.functions.stopwords import ALL
from textloom.operators import dates, kv, ranked, search, stats
from textloom.operators import index as ix
from textloom.scratch import Scratch
from textloom.streaming import ingest

TOP, LEVELS, SMALL_R = 10, (16, 64), 4
RANKED = "tion ing ea"
LOW_DF = "thanedble anea ierai"
#: A key whose newest write is a value, and one whose newest write deletes it, in the tables of scale 0.01.
LIVE, DELETED = "00000009", "00000008"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return ix.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


_ENGINES: dict[tuple, Engine] = {}


def engine(spark: SparkSession, d: str, profile: str = "surface", *tables: str) -> Engine:
    """The saved engine over a folder's documents: built once a session from the whole table, again if its files change.

    Queries are about the index, as they are for users; ``index_build`` is the query that makes all of one. Of the derived
    tables those are written, once a session, that a query names.
    """
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    key = (sc.applicationId, profile, d, status.getModificationTime(), fs.getContentSummary(p).getLength())
    if key not in _ENGINES:
        scratch = Scratch(spark)
        _ENGINES[key] = Engine(spark, _docs(spark, d), profile).save(scratch.path("engine"), ())
    return _ENGINES[key].derive(*tables)


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with dates derived from the id, as the test tables have none."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    start = F.expr("date_add(date'2020-01-01', cast(doc_id % 1461 as int))")
    end = F.expr("date_add(date'2020-01-01', cast(doc_id % 1461 + 30 + doc_id % 400 as int))")
    return _docs(spark, d).select(
        "doc_id", "text", day(start).alias("date"),
        F.when(F.col("doc_id") % 7 != 0, day(start)).alias("start_date"),
        F.when(F.col("doc_id") % 5 != 0, day(end)).alias("end_date"),
    )


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).postings


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).tf


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, "surface", "vocab").vocab


def _norms(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, "surface", "norms").norms


def _built(spark: SparkSession, d: str) -> DataFrame:
    """A new engine, all its tables written; its corpus statistics."""
    return Engine(spark, _docs(spark, d)).save(Scratch(spark).path("engine")).corpus_stats


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The postings in two deltas that share documents: every other position of each (term, doc_id)."""
    rows = _postings(spark, d)
    half = lambda odd: rows.select("term", "doc_id", F.filter("positions", lambda p: p % 2 == odd).alias("positions")).filter(F.size("positions") > 0)
    return half(0), half(1)


def _rejoined(spark: SparkSession, d: str) -> DataFrame:
    even, odd = _halves(spark, d)
    return ix.merge_postings(even.unionByName(odd)).select("term", "doc_id", F.array_join("positions", ",").alias("positions"), "tf")


def _merging(spark: SparkSession, d: str) -> DataFrame:
    """The term sets of two deltas put into a merging store and compacted."""
    store = kv.MergingStore(spark, Scratch(spark).path("merging"))
    for part in _halves(spark, d):
        store.append(part.select(F.col("term").alias("key"), F.col("doc_id").alias("member")))
    store.compact()
    return store.rows()


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream, their postings appended by batches and read back merged."""
    scratch = Scratch(spark)
    table = f"{d}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{d}/documents.parque[t]").select("doc_id", "text")
    out = scratch.path("streamed")
    ingest.stream_postings(stream, out, scratch.path("progress")).awaitTermination()
    return ingest.read_postings(spark, out).select("term", "doc_id", "tf")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """events as a key-value log: the user is the key, the event id the order, an error deletes."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), F.col("props").cast("binary").alias("value"),
        F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_delete"),
    )


def _text_values(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.col("value").cast("string"))


def _bool(expr: str, dated: bool = False, profile: str = "surface") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d, profile)
        return search.boolean(_dated(spark, d) if dated else e.docs, e.tf, expr, profile)

    return run


def _ranked(exact: bool, text: str, r: int = 32) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d, "surface", "norms", *(() if exact else ("champions", "tiers")))
        out = ranked.top_exact(e.tf, e.norms, e.n_docs, text, TOP) if exact else ranked.top_inexact(e.tf, e.norms, e.n_docs, text, TOP, r, LEVELS, "surface", e.champions, e.tiers)
        return out.withColumn("score", F.round("score", 6))

    return run


def _stemmed(s: SparkSession, d: str) -> DataFrame:
    return engine(s, d, "stemmed", "vocab").vocab.select("term", "df")


def _positional(s: SparkSession, d: str) -> DataFrame:
    p = _postings(s, d)
    two = search.positional_intersect(p.filter("term = 'de'"), p.filter("term = 'la'"), 2)
    return two.select("doc_id", F.size("positions").alias("n"))


def _sets(op: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: op(search.term_docs(_tf(s, d), "tion"), search.term_docs(_tf(s, d), "ing"))


def _intervals(s: SparkSession, d: str) -> DataFrame:
    """Orders as validity intervals: from the order date to the last shipment, open while status is O."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    last = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    o = s.read.parquet(f"{d}/orders.parquet").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = o.select("o_orderkey", F.lit(None).cast("string").alias("date"), day("o_orderdate").alias("start_date"), F.when(F.col("o_orderstatus") != "O", day("ship")).alias("end_date"))
    return rows.filter(dates.valid("19970101", "19970131")).select("o_orderkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "index_build": _built,
    "tokenize_tf": lambda s, d: ix.term_frequencies(_docs(s, d)),
    "tokenize_positions": lambda s, d: analysis.occurrences(_docs(s, d)),
    "vocab_df": lambda s, d: _vocab(s, d).select("term", "df"),
    "postings_positions": lambda s, d: ix.postings(_docs(s, d)).select("term", "doc_id", F.array_join("positions", ",").alias("positions"), "tf"),
    "term_lookup": lambda s, d: search.term_docs(_tf(s, d), "tion"),
    "bool_and": _bool("tion AND ing"),
    "bool_or": _bool("thanedble OR ierai"),
    "bool_not": _bool("NOT tion"),
    "bool_nested": _bool("(tion AND NOT ing) OR (ea AND NOT NOT anea)"),
    "bool_stop_word": _bool("NOT the AND tion"),
    "and_terms": lambda s, d: search.and_terms(_tf(s, d), "tion ing ea"),
    "or_terms": lambda s, d: search.or_terms(_tf(s, d), ["thanedble", "ierai"]),
    "set_union": _sets(search.union),
    "set_intersect": _sets(search.intersect),
    "set_except": _sets(search.subtract),
    "set_complement": lambda s, d: search.complement(_docs(s, d), search.term_docs(_tf(s, d), "tion")),
    "phrase_two": lambda s, d: search.phrase(_postings(s, d), "attion thanedble"),
    "phrase_three": lambda s, d: search.phrase(_postings(s, d), "attion thanedble anea"),
    "phrase_repeat_word": lambda s, d: search.phrase(_postings(s, d), "en en"),
    "positional_exact_k": _positional,
    "prefix_docs": lambda s, d: search.prefix_docs(_tf(s, d), "Tiona"),
    "prefix_terms": lambda s, d: search.prefix_terms(_vocab(s, d), "tiona"),
    "wildcard_middle": lambda s, d: search.wildcard_docs(_tf(s, d), "th*ble"),
    "wildcard_suffix": lambda s, d: search.wildcard_terms(_vocab(s, d), "*ingtion", None, engine(s, d, "surface", "grams").grams),
    "wildcard_short_no_gram": lambda s, d: search.wildcard_terms(_vocab(s, d), "t*g"),
    "kgram_index": lambda s, d: engine(s, d, "surface", "grams").grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_terms")),
    "date_range": lambda s, d: _dated(s, d).filter(dates.date_range("20200301", "20200430")).select("doc_id"),
    "date_exact": lambda s, d: _dated(s, d).filter(F.col("date") == "20200315").select("doc_id"),
    "appeared_range": lambda s, d: _dated(s, d).filter(dates.appeared("20200301", "20200430")).select("doc_id"),
    "valid_interval": lambda s, d: _dated(s, d).filter(dates.valid("20200601", "20200731")).select("doc_id"),
    "valid_orders": _intervals,
    "date_and_term": _bool("VALID[20200601,20200731] AND tion AND NOT DATE[20200401,20200430]", dated=True),
    "idf_table": lambda s, d: _vocab(s, d).select("term", F.round("idf", 6).alias("idf")),
    "doc_norms": lambda s, d: _norms(s, d).select("doc_id", F.round("norm", 6).alias("norm")),
    "champions_r32": lambda s, d: ix.champions(_tf(s, d), 32),
    "tiers_16_64": lambda s, d: ix.tiers(_tf(s, d), LEVELS),
    "ranked_exact": _ranked(True, RANKED),
    "ranked_inexact": _ranked(False, RANKED),
    "ranked_inexact_topup": _ranked(False, LOW_DF, SMALL_R - 3),
    "champions_saved": lambda s, d: engine(s, d, "surface", "champions").champions.select("term", "rank", "doc_id"),
    "corpus_stats": lambda s, d: engine(s, d, "surface", "corpus_stats").corpus_stats,
    "positional_merge": _rejoined,
    "merge_compaction": _merging,
    "streamed_postings": _streamed,
    "kv_get_latest": lambda s, d: _text_values(kv.get(_log(s, d), LIVE)),
    "kv_get_deleted": lambda s, d: _text_values(kv.get(_log(s, d), DELETED)),
    "kv_get_many": lambda s, d: _text_values(kv.get_many(_log(s, d), _log(s, d).filter("seq % 10 = 0").select("key").distinct())),
    "kv_keys": lambda s, d: kv.keys(_log(s, d)),
    "kv_range_scan": lambda s, d: _text_values(kv.scan(_log(s, d), "00000010", "00000120", 64)),
    "kv_compact": lambda s, d: _text_values(kv.current(_log(s, d))),
    "kv_newest_window": lambda s, d: _text_values(kv.newest(_log(s, d))).select("key", "seq", "value", "is_delete"),
    "kv_merging_scan": lambda s, d: kv.merged(_tf(s, d), "tiona", "tionb").select("term", F.array_join("doc_ids", ",").alias("doc_ids")),
    "list_docs": lambda s, d: _docs(s, d).select("doc_id").orderBy("doc_id"),
    "show_doc": lambda s, d: _docs(s, d).filter("doc_id = 7").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 20), "\n").alias("head")),
    "stats": lambda s, d: _docs(s, d).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")),
    "bench_percentiles": lambda s, d: stats.percentiles(s.read.parquet(f"{d}/events.parquet"), "value"),
    "stemmed_vocab": _stemmed,
    "stemmed_bool": _bool("tions AND ings", profile="stemmed"),
}

_STOPS = ", ".join(f"'{w}'" for w in sorted(ALL))
_K = f"""
l AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zа-яё]+') ts FROM documents),
t AS (SELECT doc_id, unnest(ts) term, generate_subscripts(ts, 1) - 1 raw_pos FROM l),
k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY raw_pos) - 1 AS pos FROM t WHERE term NOT IN ({_STOPS})),
p AS (SELECT term, doc_id, count(*)::INT tf FROM k GROUP BY ALL),
n AS (SELECT count(*) n FROM documents),
v AS (SELECT term, count(*) df, ln(((SELECT n FROM n) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM p GROUP BY term),
nm AS (SELECT doc_id, sqrt(sum(((1 + ln(tf)) * idf) ** 2)) norm FROM p JOIN v USING (term) GROUP BY doc_id)
"""
_D = """
d AS (SELECT doc_id, strftime(DATE '2020-01-01' + (doc_id % 1461)::INT, '%Y%m%d') AS date,
  CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2020-01-01' + (doc_id % 1461)::INT, '%Y%m%d') END AS start_date,
  CASE WHEN doc_id % 5 <> 0 THEN strftime(DATE '2020-01-01' + (doc_id % 1461 + 30 + doc_id % 400)::INT, '%Y%m%d') END AS end_date
  FROM documents)
"""
_LOG = "lg AS (SELECT lpad(user_id::VARCHAR, 8, '0') AS key, props AS value, event_id AS seq, event_type = 'error' AS is_delete FROM events)"
_CUR = "c AS (SELECT key, arg_max(value, seq) AS value, max(seq) AS seq, arg_max(is_delete, seq) AS gone FROM lg GROUP BY key)"


def _k(body: str, *more: str) -> str:
    return f"WITH {_K}{''.join(', ' + m for m in more)} {body}"


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM p WHERE term = '{term}')"


def _terms_sql(text: str) -> str:
    rows = ", ".join(f"('{t}', {i})" for i, t in enumerate(dict.fromkeys(analysis.analyze(text))))
    return f"""q AS (SELECT term, ord, idf FROM (VALUES {rows}) x(term, ord) JOIN v USING (term)),
qn AS (SELECT sqrt(sum(idf ** 2)) qn FROM q)"""


def _ranked_sql(text: str, candidates: str = "") -> str:
    more = [_terms_sql(text)]
    where = ""
    if candidates:
        more.append(candidates)
        where = "WHERE doc_id IN (SELECT doc_id FROM cand)"
    return _k(
        f"""SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, round(sum((1 + ln(tf)) * idf * idf) / (any_value(norm) * any_value(qn)), 12) score, min(ord) first_ord
FROM p JOIN q USING (term) JOIN nm USING (doc_id) CROSS JOIN qn {where} GROUP BY doc_id) ORDER BY score.score DESC, first_ord, doc_id LIMIT {TOP}""".replace("score.score", "round(score, 12)"),
        *more,
    )


def _candidates_sql(r: int) -> str:
    a, b = LEVELS[0], sum(LEVELS)
    return f"""rk AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id DESC) rn FROM p WHERE term IN (SELECT term FROM q)),
lv AS (SELECT doc_id, min(CASE WHEN rn <= {r} THEN -1 WHEN rn <= {a} THEN 0 WHEN rn <= {b} THEN 1 ELSE 2 END) lev FROM rk GROUP BY doc_id),
cu AS (SELECT x.lev, (SELECT count(*) FROM lv WHERE lev <= x.lev) upto FROM (VALUES (-1), (0), (1), (2)) x(lev)),
pick AS (SELECT CASE WHEN (SELECT upto FROM cu WHERE lev = -1) >= {TOP} THEN -1
  ELSE coalesce((SELECT min(lev) FROM cu WHERE lev >= -1 AND upto >= {2 * TOP}), 2) END AS lev),
cand AS (SELECT doc_id FROM lv WHERE lev <= (SELECT lev FROM pick))"""


def _phrase_sql(*terms: str) -> str:
    joins = " ".join(f"JOIN k k{i} ON k{i}.doc_id = k0.doc_id AND k{i}.pos = k0.pos + {i} AND k{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return _k(f"SELECT DISTINCT k0.doc_id FROM k k0 {joins} WHERE k0.term = '{terms[0]}'")


_GRAMS = """pd AS (SELECT term, '$' || term || '$' AS w FROM v),
g AS (SELECT DISTINCT term, CASE WHEN length(w) < 3 THEN w ELSE substr(w, i, 3) END AS gram
  FROM (SELECT term, w, unnest(range(1, greatest(length(w) - 1, 2))) i FROM pd))"""

ORACLE: dict[str, str] = {
    "tokenize_tf": _k("SELECT term, doc_id, tf FROM p"),
    "tokenize_positions": _k("SELECT doc_id, pos::INT AS pos, term FROM k"),
    "vocab_df": _k("SELECT term, df FROM v"),
    "postings_positions": _k("SELECT term, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions, count(*)::INT AS tf FROM k GROUP BY term, doc_id"),
    "term_lookup": _k("SELECT doc_id FROM p WHERE term = 'tion'"),
    "bool_and": _k(f"SELECT doc_id FROM documents WHERE {_has('tion')} AND {_has('ing')}"),
    "bool_or": _k(f"SELECT doc_id FROM documents WHERE {_has('thanedble')} OR {_has('ierai')}"),
    "bool_not": _k(f"SELECT doc_id FROM documents WHERE NOT {_has('tion')}"),
    "bool_nested": _k(f"SELECT doc_id FROM documents WHERE ({_has('tion')} AND NOT {_has('ing')}) OR ({_has('ea')} AND {_has('anea')})"),
    "bool_stop_word": _k(f"SELECT doc_id FROM documents WHERE {_has('tion')}"),
    "and_terms": _k(f"SELECT doc_id FROM documents WHERE {_has('tion')} AND {_has('ing')} AND {_has('ea')}"),
    "or_terms": _k(f"SELECT doc_id FROM documents WHERE {_has('thanedble')} OR {_has('ierai')}"),
    "set_union": _k(f"SELECT doc_id FROM documents WHERE {_has('tion')} OR {_has('ing')}"),
    "set_intersect": _k(f"SELECT doc_id FROM documents WHERE {_has('tion')} AND {_has('ing')}"),
    "set_except": _k(f"SELECT doc_id FROM documents WHERE {_has('tion')} AND NOT {_has('ing')}"),
    "set_complement": _k(f"SELECT doc_id FROM documents WHERE NOT {_has('tion')}"),
    "phrase_two": _phrase_sql("attion", "thanedble"),
    "phrase_three": _phrase_sql("attion", "thanedble", "anea"),
    "phrase_repeat_word": _phrase_sql("en", "en"),
    "positional_exact_k": _k("SELECT b.doc_id, count(*)::INT AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = 'de' AND b.term = 'la' GROUP BY b.doc_id"),
    "prefix_docs": _k("SELECT DISTINCT doc_id FROM p WHERE starts_with(term, 'tiona')"),
    "prefix_terms": _k("SELECT term FROM v WHERE starts_with(term, 'tiona')"),
    "wildcard_middle": _k("SELECT DISTINCT doc_id FROM p WHERE regexp_full_match(term, 'th.*ble')"),
    "wildcard_suffix": _k("SELECT term FROM v WHERE regexp_full_match(term, '.*ingtion')"),
    "wildcard_short_no_gram": _k("SELECT term FROM v WHERE regexp_full_match(term, 't.*g')"),
    "kgram_index": _k("SELECT gram, count(*) AS n_terms FROM g GROUP BY gram", _GRAMS),
    "date_range": f"WITH {_D} SELECT doc_id FROM d WHERE date BETWEEN '20200301' AND '20200430'",
    "date_exact": f"WITH {_D} SELECT doc_id FROM d WHERE date = '20200315'",
    "appeared_range": f"WITH {_D} SELECT doc_id FROM d WHERE start_date BETWEEN '20200301' AND '20200430'",
    "valid_interval": f"WITH {_D} SELECT doc_id FROM d WHERE start_date <= '20200731' AND (end_date IS NULL OR end_date >= '20200601')",
    "valid_orders": """SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
WHERE strftime(o_orderdate, '%Y%m%d') <= '19970131' AND (o_orderstatus = 'O' OR ship IS NULL OR strftime(ship, '%Y%m%d') >= '19970101')""",
    "date_and_term": _k(f"SELECT doc_id FROM d WHERE start_date <= '20200731' AND (end_date IS NULL OR end_date >= '20200601') AND {_has('tion')} AND NOT (date BETWEEN '20200401' AND '20200430')", _D),
    "idf_table": _k("SELECT term, round(idf, 6) AS idf FROM v"),
    "doc_norms": _k("SELECT doc_id, round(norm, 6) AS norm FROM nm"),
    "champions_r32": _k("SELECT term, rn::INT AS rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id DESC) rn FROM p) WHERE rn <= 32"),
    "tiers_16_64": _k("SELECT term, (CASE WHEN rn <= 16 THEN 0 WHEN rn <= 80 THEN 1 ELSE 2 END)::INT AS tier, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id DESC) rn FROM p)"),
    "ranked_exact": _ranked_sql(RANKED),
    "ranked_inexact": _ranked_sql(RANKED, _candidates_sql(32)),
    "ranked_inexact_topup": _ranked_sql(LOW_DF, _candidates_sql(SMALL_R - 3)),
    "kv_get_latest": f"WITH {_LOG}, {_CUR} SELECT key, value, seq FROM c WHERE NOT gone AND key = '{LIVE}'",
    "kv_get_deleted": f"WITH {_LOG}, {_CUR} SELECT key, value, seq FROM c WHERE NOT gone AND key = '{DELETED}'",
    "kv_get_many": f"WITH {_LOG}, {_CUR} SELECT key, value, seq FROM c WHERE NOT gone AND key IN (SELECT key FROM lg WHERE seq % 10 = 0)",
    "kv_keys": f"WITH {_LOG}, {_CUR} SELECT key FROM c WHERE NOT gone",
    "index_build": _k("SELECT (SELECT n FROM n) AS docs, (SELECT count(*) FROM v) AS terms, (SELECT count(*) FROM p) AS postings"),
    "corpus_stats": _k("SELECT (SELECT n FROM n) AS docs, (SELECT count(*) FROM v) AS terms, (SELECT count(*) FROM p) AS postings"),
    "champions_saved": _k("SELECT term, rn::INT AS rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id DESC) rn FROM p) WHERE rn <= 32"),
    "positional_merge": _k("SELECT term, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions, count(*)::INT AS tf FROM k GROUP BY term, doc_id"),
    "merge_compaction": _k("SELECT term AS key, doc_id AS member FROM p"),
    "streamed_postings": _k("SELECT term, doc_id, tf FROM p"),
    "kv_range_scan": f"WITH {_LOG}, {_CUR} SELECT key, value, seq FROM c WHERE NOT gone AND key BETWEEN '00000010' AND '00000120' ORDER BY key LIMIT 64",
    "kv_compact": f"WITH {_LOG}, {_CUR} SELECT key, value, seq FROM c WHERE NOT gone",
    "kv_newest_window": f"WITH {_LOG}, {_CUR} SELECT key, seq, value, gone AS is_delete FROM c",
    "kv_merging_scan": _k("SELECT term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM p WHERE term >= 'tiona' AND term <= 'tionb' GROUP BY term"),
    "list_docs": "SELECT doc_id FROM documents",
    "show_doc": "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10)) AS head FROM documents WHERE doc_id = 7",
    "stats": "SELECT count(*) AS docs, sum(strlen(text))::BIGINT AS bytes FROM documents",
    "bench_percentiles": """SELECT p::DOUBLE AS p, (SELECT list(value ORDER BY value) FROM events WHERE value IS NOT NULL)[(floor(p / 100.0 * ((SELECT count(value) FROM events) - 1)))::INT + 1] AS value
FROM (VALUES (50), (95), (99)) x(p)""",
}

