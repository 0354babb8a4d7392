"""tf-idf cosine ranking: exact top-k and the champion-list / tier variant."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import analysis
from textloom.operators import index as ix


def idf(n_docs: int, df: int) -> float:
    return math.log((n_docs + 1) / (df + 1)) + 1


def query_weights(tf: DataFrame, n_docs: int, text: str, profile: str = "surface") -> tuple[list[tuple[str, int, float, float]], float]:
    """(term, order, idf, query weight) of the query's terms that have postings, and the query's norm.

    One small aggregation: at most as many rows as the query has terms reach the driver.
    """
    counts = Counter(analysis.analyze(text, profile))
    if not counts:
        return [], 0.0
    df = {r["term"]: r["df"] for r in tf.filter(F.col("term").isin(*counts)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    rows = [(t, i, idf(n_docs, df[t]), (1 + math.log(c)) * idf(n_docs, df[t])) for i, (t, c) in enumerate(counts.items()) if t in df]
    return rows, math.sqrt(sum(w * w for *_, w in rows))


def score(tf: DataFrame, norms: DataFrame, weights: list[tuple[str, int, float, float]], query_norm: float) -> DataFrame:
    """(doc_id, score, first_ord): cosine of each document that holds a query term.

    Scores are rounded to 12 places: the order of a distributed sum is not fixed, and ties must be.
    """
    w, order = F.lit(0.0), F.lit(len(weights))
    for term, i, idf_t, w_q in weights:
        here = F.col("term") == term
        w, order = F.when(here, (1 + F.log("tf")) * idf_t * w_q).otherwise(w), F.when(here, F.lit(i)).otherwise(order)
    rows = tf.filter(F.col("term").isin(*[t for t, *_ in weights])).select("doc_id", w.alias("w"), order.alias("ord"))
    dots = rows.groupBy("doc_id").agg(F.sum("w").alias("dot"), F.min("ord").alias("first_ord"))
    cosine = F.round(F.col("dot") / (F.col("norm") * query_norm), 12)
    return dots.join(norms.filter(F.col("norm") > 0), "doc_id").select("doc_id", cosine.alias("score"), "first_ord")


def _top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "first_ord", "doc_id").limit(k).select("doc_id", "score")


def _nothing(tf: DataFrame) -> DataFrame:
    return tf.select("doc_id", F.lit(0.0).alias("score")).limit(0)


def top_exact(tf: DataFrame, norms: DataFrame, n_docs: int, text: str, k: int = 10, profile: str = "surface") -> DataFrame:
    """(doc_id, score) of the k best documents; ties by first matching query term, then doc_id."""
    weights, norm = query_weights(tf, n_docs, text, profile)
    return _top(score(tf, norms, weights, norm), k) if norm else _nothing(tf)


def top_inexact(
    tf: DataFrame, norms: DataFrame, n_docs: int, text: str, k: int = 10, r: int = 32, sizes: tuple[int, ...] = (16, 64), profile: str = "surface",
    champions: DataFrame | None = None, tiers: DataFrame | None = None,
) -> DataFrame:
    """Like top_exact, but only over candidates: the champions of the query's terms and, if those
    are fewer than k, the documents of as many tiers as it takes to reach 2k.

    Saved champion and tier tables are read by term; without them they are made of the query's terms only.
    """
    weights, norm = query_weights(tf, n_docs, text, profile)
    if not norm:
        return _nothing(tf)
    asked = F.col("term").isin(*[t for t, *_ in weights])
    own = tf.filter(asked)
    lists = ix.champions(own, r) if champions is None else champions.filter(asked & (F.col("rank") <= r))
    candidates = lists.select("doc_id").distinct()
    if candidates.limit(k).count() < k:
        levels = ix.tiers(own, sizes) if tiers is None else tiers.filter(asked)
        first = levels.select("doc_id", "tier").unionByName(candidates.withColumn("tier", F.lit(-1))).groupBy("doc_id").agg(F.min("tier").alias("tier"))
        size = {row["tier"]: row["n"] for row in first.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
        total, level = size.get(-1, 0), -1
        while total < 2 * k and level < len(sizes):
            level += 1
            total += size.get(level, 0)
        candidates = first.filter(F.col("tier") <= level).select("doc_id")
    return _top(score(tf, norms, weights, norm).join(candidates, "doc_id", "left_semi"), k)
