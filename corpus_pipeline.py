"""A corpus pipeline over documents: each stage works on what the stage before it kept.

language ID -> SimHash near-dedup -> benchmark decontamination -> source mixing -> token ids.
All stages but the last return the columns of documents. Rows with nulls, empty texts, repeated or missing ids go
through every stage as its docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import op02_mixing, op03_simhash, op06_language, op08_tokens, op09_decontaminate
from textloom.llm.common import Scratch
from textloom.llm.queries import TOKENIZER


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compresses clearly best. Null texts, those without letters and those whose best two
    languages are equal or nearly so go; ids don't matter, and repeated rows share their fate."""
    return op06_language.accepted(docs, op06_language.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the smallest id's, null ids last. Repeated rows are near copies of each other."""
    return op03_simhash.keep_one(docs, Scratch(spark))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item; null texts share none, and each row is judged by its text alone."""
    return op09_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: a row for each copy, none for those left out. Repeated ids are taken row by
    row, null sources are a source, and which of rows equal in id, source and text is taken makes no difference."""
    return op02_mixing.take(docs, Scratch(spark))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the written token files; a null text has the end id only, null
    ids come first, and rows of equal id are in the order of a hash of their text."""
    return op08_tokens.read(*op08_tokens.write(docs, TOKENIZER, Scratch(spark)))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources", mixed),
    ("token ids", token_ids),
]
#: Compression and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; a stage's table goes once the next one is written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name.split()[0].lower())
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
