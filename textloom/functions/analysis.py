"""The analyzer as Column expressions.

A text is lower-cased, cut into runs of Latin a-z and Cyrillic letters, freed of stop words,
and (in the ``stemmed`` profile) stemmed by the language of each token. Positions are counted
after stop words are gone. English words can't contain Cyrillic letters and the lists don't
overlap, so one membership test serves both languages.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.stemming import language_of, stem
from textloom.functions.stopwords import ALL

TOKEN = "[a-zа-яё]+"
PROFILES = ("surface", "stemmed")


def tokens(text: Column) -> Column:
    """array<string> of all tokens, stop words included; null text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def language(token: Column) -> Column:
    """'russian' if the token holds a Cyrillic letter, else 'english'."""
    return F.when(token.rlike("[а-яё]"), F.lit("russian")).otherwise(F.lit("english"))


def content_tokens(text: Column) -> Column:
    """Tokens without stop words, in order."""
    return F.filter(tokens(text), lambda t: ~t.isin(*sorted(ALL)))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, term) of each surface token that is not a stop word."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(content_tokens(F.col(text_col))).alias("pos", "term"))


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term) like occurrences without positions: stop words go after the tokens are exploded,
    in generated code instead of a lambda."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return rows.filter(~F.col("term").isin(*sorted(ALL)))


def analyze(text: str, profile: str = "surface") -> list[str]:
    """The analyzer for query strings, on the driver."""
    found = [t for t in re.findall(TOKEN, text.lower()) if t not in ALL]
    return [stem(t, language_of(t)) for t in found] if profile == "stemmed" else found


def with_stems(rows: DataFrame, term_col: str = "term") -> DataFrame:
    """Replace surface terms by stems.

    The stemmer is the one Python function of the engine. It runs once per distinct word
    (not per occurrence), and the result is joined back on the word; AQE broadcasts the
    vocabulary if it is small and splits hot words if it isn't.
    """
    @F.pandas_udf("string")
    def stem_udf(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stem(w, language_of(w)))

    vocabulary = rows.select(term_col).distinct().withColumn("stem", stem_udf(F.col(term_col)))
    return rows.join(vocabulary, term_col).withColumn(term_col, F.col("stem")).drop("stem")


def stems(tokens: Column) -> Column:
    """The stem of each token of an array, in its place: the stemmer runs once per distinct word of an Arrow batch."""
    @F.arrow_udf("array<string>")
    def stems_udf(rows: pa.Array) -> pa.Array:
        words = rows.flatten().dictionary_encode()
        known = pa.array([stem(w, language_of(w)) for w in words.dictionary.to_pylist()], pa.string())
        starts = pa.array([0, *pc.cumulative_sum(pc.list_value_length(rows)).to_pylist()], pa.int32())
        return pa.ListArray.from_arrays(starts, known.take(words.indices))

    return stems_udf(tokens)


def kgrams(term: Column, k: int = 3) -> Column:
    """Distinct k-grams of ``$term$``; a padded term shorter than k is its own only gram."""
    padded = F.concat(F.lit("$"), term, F.lit("$"))
    n = F.length(padded)
    grams = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(padded, i, F.lit(k)))
    return F.when(n < k, F.array(padded)).otherwise(F.array_distinct(grams))


def pattern_grams(pattern: str, k: int = 3) -> list[str]:
    """The k-grams that every match of a ``*`` pattern must hold."""
    parts = pattern.split("*")
    parts[0], parts[-1] = ("$" + parts[0] if parts[0] else ""), (parts[-1] + "$" if parts[-1] else "")
    if len(parts) == 1:
        parts = [f"${pattern}$"]
    return sorted({p[i : i + k] for p in parts for i in range(len(p) - k + 1)})


def wildcard_regex(pattern: str) -> str:
    """Anchored regular expression of a pattern in which only ``*`` is special."""
    return "^" + ".*".join(re.escape(p) for p in pattern.lower().split("*")) + "$"
