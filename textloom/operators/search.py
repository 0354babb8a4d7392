"""Boolean, phrase, prefix, wildcard and positional search over postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import analysis
from textloom.plans import query as q


def term_docs(postings: DataFrame, term: str) -> DataFrame:
    return postings.filter(F.col("term") == term).select("doc_id")


def boolean(docs: DataFrame, postings: DataFrame, expr: str, profile: str = "surface", loose_operators: bool = False, all_parts: bool = False) -> DataFrame:
    """(doc_id) of the documents that satisfy the expression.

    All word leaves are read in one scan of the postings and turned into flags by one
    aggregation on doc_id; the documents drive the join, so NOT also finds documents without
    postings. A leaf that analyzes to nothing (a stop word) matches no document. A leaf that
    analyzes to several terms uses the first, or any of them if ``all_parts``. Of docs only the id
    and the dates are read, so other columns may have any name.
    """
    tree = q.parse(expr, loose_operators)
    leaves = {w: (t if all_parts else t[:1]) for w in q.words_of(tree) for t in [analysis.analyze(w, profile)]}
    terms = sorted({t for ts in leaves.values() for t in ts})
    flag = {t: f"_has{i}" for i, t in enumerate(terms)}
    base = docs.select("doc_id", *[c for c in ("date", "start_date", "end_date") if c in docs.columns])
    if terms:
        flags = postings.filter(F.col("term").isin(*terms)).groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(f) for t, f in flag.items()))
        base = base.join(flags, "doc_id", "left")
    has = lambda w: reduce(lambda a, b: a | b, [F.coalesce(F.col(flag[t]), F.lit(False)) for t in leaves[w]], F.lit(False))
    return base.filter(q.to_column(tree, has)).select("doc_id")


def and_terms(postings: DataFrame, text: str, profile: str = "surface") -> DataFrame:
    """Documents that hold every term of the text; no terms give none."""
    terms = sorted(set(analysis.analyze(text, profile)))
    if not terms:
        return postings.select("doc_id").limit(0)
    rows = postings.filter(F.col("term").isin(*terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return rows.filter(F.col("n") == len(terms)).select("doc_id")


def or_terms(postings: DataFrame, words: list[str], profile: str = "surface") -> DataFrame:
    """Documents that hold any of the words; one stop word among them empties the result."""
    found = [analysis.analyze(w, profile)[:1] for w in words]
    if not all(found):
        return postings.select("doc_id").limit(0)
    return postings.filter(F.col("term").isin(*[f[0] for f in found])).select("doc_id").distinct()


def phrase(postings: DataFrame, text: str, profile: str = "surface") -> DataFrame:
    """Documents that hold the terms of the text at consecutive positions.

    Stop words vanish on both sides. Each occurrence votes for the start it implies
    (position minus offset in the phrase); a start with a vote for every offset is a match. One
    shuffle, whatever the length; repeated words count for each of their offsets.
    """
    terms = analysis.analyze(text, profile)
    if not terms:
        return postings.select("doc_id").limit(0)
    if len(terms) == 1:
        return term_docs(postings, terms[0])
    where: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        where.setdefault(t, []).append(i)
    offsets = F.lit(None).cast("array<int>")
    for t, at in where.items():
        offsets = F.when(F.col("term") == t, F.array(*map(F.lit, at))).otherwise(offsets)
    votes = (
        postings.filter(F.col("term").isin(*where))
        .select("doc_id", F.explode("positions").alias("pos"), offsets.alias("offsets"))
        .select("doc_id", "pos", F.explode("offsets").alias("ord"))
    )
    starts = votes.groupBy("doc_id", (F.col("pos") - F.col("ord")).alias("start")).agg(F.count_distinct("ord").alias("n"))
    return starts.filter(F.col("n") == len(terms)).select("doc_id").distinct()


def positional_intersect(left: DataFrame, right: DataFrame, k: int = 1) -> DataFrame:
    """(doc_id, positions): positions p of ``right`` with p - k in ``left``, documents with none left out."""
    a = left.select("doc_id", F.transform("positions", lambda p: p + k).alias("wanted"))
    both = right.select("doc_id", "positions").join(a, "doc_id")
    return both.select("doc_id", F.array_intersect("positions", "wanted").alias("positions")).filter(F.size("positions") > 0)


def prefix_terms(vocab: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Terms that start with the prefix, ascending; the predicate reaches the scan."""
    found = vocab.filter(F.col("term").startswith(prefix.lower())).select("term").orderBy("term")
    return found if limit is None else found.limit(limit)


def prefix_docs(postings: DataFrame, prefix: str) -> DataFrame:
    return postings.filter(F.col("term").startswith(prefix.lower())).select("doc_id").distinct()


def wildcard_terms(vocab: DataFrame, pattern: str, limit: int | None = None, grams: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Terms that match a ``*`` pattern, ascending.

    A pattern with only a trailing star is a prefix. If a gram table is given and the pattern
    has whole grams, candidates must hold all of them; otherwise the vocabulary is scanned with
    the regular expression.
    """
    pattern = pattern.lower()
    if pattern.endswith("*") and "*" not in pattern[:-1]:
        return prefix_terms(vocab, pattern[:-1], limit)
    source, need = vocab.select("term"), analysis.pattern_grams(pattern, k)
    if grams is not None and need:
        held = grams.filter(F.col("gram").isin(*need)).groupBy("term").agg(F.count_distinct("gram").alias("n"))
        source = held.filter(F.col("n") == len(need)).select("term")
    found = source.filter(F.col("term").rlike(analysis.wildcard_regex(pattern))).distinct().orderBy("term")
    return found if limit is None else found.limit(limit)


def wildcard_docs(postings: DataFrame, pattern: str) -> DataFrame:
    """Documents with a term that matches; the pattern is tested in the postings scan itself."""
    pattern = pattern.lower()
    if pattern.endswith("*") and "*" not in pattern[:-1]:
        return prefix_docs(postings, pattern[:-1])
    return postings.filter(F.col("term").rlike(analysis.wildcard_regex(pattern))).select("doc_id").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").join(b.select("doc_id"), "doc_id", "left_semi").distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").join(b.select("doc_id"), "doc_id", "left_anti").distinct()


def complement(docs: DataFrame, a: DataFrame) -> DataFrame:
    return subtract(docs, a)
