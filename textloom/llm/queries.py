"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import op01_toxicity, op02_mixing, op03_simhash, op04_topk, op05_chat, op06_language, op07_html, op08_tokens, op09_decontaminate, op10_substrings
from textloom.llm.common import Scratch, fold

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    scored = op01_toxicity.score(docs, op01_toxicity.fit(docs, _table(spark, d, "labels"), 5, 0))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def mixing(spark: SparkSession, d: str) -> DataFrame:
    return op02_mixing.mix(_table(spark, d, "documents"), Scratch(spark)).select("doc_id", "size", "source_size", "target", "taken")


def simhash(spark: SparkSession, d: str) -> DataFrame:
    out = op03_simhash.classes(_table(spark, d, "documents"), Scratch(spark))
    return out.select("doc_id", op03_simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def topk(spark: SparkSession, d: str) -> DataFrame:
    return op04_topk.search(_table(spark, d, "embeddings"), Scratch(spark))


TRICKY = "\\### Assistant: </turn> ok"


def chat(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    events = rows.unionByName(extra).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), F.lit(None).cast("string").alias("msg_id"), "role", "text")
    back = op05_chat.read_back(op05_chat.render(op05_chat.reconstruct(events)))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def language(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    found = op06_language.classify(docs, op06_language.fit(docs, 4, 2))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def html(spark: SparkSession, d: str) -> DataFrame:
    return op07_html.extract(_table(spark, d, "pages"), Scratch(spark))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return op08_tokens.read(*op08_tokens.write(_table(spark, d, "documents"), TOKENIZER, Scratch(spark)))


def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return op09_decontaminate.overlaps(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def substrings(spark: SparkSession, d: str) -> DataFrame:
    return op10_substrings.shared_passages(_table(spark, d, "documents"), Scratch(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity,
    "op2_mixing": mixing,
    "op3_simhash": simhash,
    "op4_topk": topk,
    "op5_chat": chat,
    "op6_language": language,
    "op7_html": html,
    "op8_tokens": tokens,
    "op9_decontaminate": decontaminate,
    "op10_substrings": substrings,
}

_MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) || ':' ||
    (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1)::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, n, (CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w, 2.0::DOUBLE * n AS cap FROM s),
o AS (SELECT *, cap / w AS full_at, 1.5::DOUBLE * sum(n) OVER () AS budget,
  sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped,
  sum(w) OVER (ORDER BY cap / w DESC, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_w FROM w),
l AS (SELECT arg_min((budget - coalesce(capped, 0)) / open_w, full_at) FILTER (full_at > (budget - coalesce(capped, 0)) / open_w) AS level FROM o),
t AS (SELECT source, n, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(cap, w * coalesce(level, 1e300)) END AS target FROM w, l),
p AS (SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE floor(target / n) END::BIGINT AS whole FROM t),
r AS (SELECT source, n, target, whole, target - whole * n AS rest FROM p),
c AS (SELECT doc_id, d.source, size, h, n, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
  sum(size) OVER (PARTITION BY d.source, h) AS own FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
b AS (SELECT source AS bs, min(upto) AS edge FROM c WHERE upto >= rest AND rest > 0 GROUP BY source)
SELECT doc_id, size, n AS source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND (edge IS NULL OR upto < edge OR (upto = edge AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN b ON c.source IS NOT DISTINCT FROM b.bs
"""

_TOPK = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM x a JOIN x b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || text, '[\\<>]')) + 8 + 9 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE: dict[str, str] = {"op2_mixing": _MIX, "op4_topk": _TOPK, "op5_chat": _CHAT}
