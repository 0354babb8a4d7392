"""Inverted index tables: postings, vocabulary, k-grams, norms, champions, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import analysis


def spread(table: DataFrame) -> DataFrame:
    """A table as it was read, in at least as many partitions as the session has cores: a file of one row group
    would else be tokenized by one task. Larger tables are left alone; meant for plain scans, whose number of
    partitions is known without running anything."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def one_row_each(docs: DataFrame) -> bool:
    """Whether no doc_id is in two rows: one pass over the ids, run at once."""
    return docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def row_postings(docs: DataFrame, profile: str = "surface") -> DataFrame:
    """The postings of each row by itself, without a shuffle: tokens are sorted with their positions, and runs of a term cut out.

    explode_outer, as explode would make the optimizer compute the arrays a second time in a filter.
    """
    tokens = analysis.content_tokens(F.col("text"))
    rows = docs.select("doc_id", (analysis.stems(tokens) if profile == "stemmed" else tokens).alias("tokens"))
    rows = rows.select("doc_id", F.sort_array(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))).alias("a"))
    starts = "filter(if(size(a) > 0, sequence(0, size(a) - 1), array()), i -> i = 0 or get(a, i).term <> get(a, i - 1).term)"
    run = "transform(slice(a, i + 1, coalesce(get(at, n + 1), size(a)) - i), x -> x.pos)"
    runs = F.expr(f"transform(at, (i, n) -> struct(get(a, i).term as term, {run} as positions))")
    rows = rows.select("doc_id", "a", F.expr(starts).alias("at")).select("doc_id", F.explode_outer(runs).alias("r")).filter("r is not null")
    return rows.select("r.term", "doc_id", "r.positions", F.size("r.positions").alias("tf"))


def postings(docs: DataFrame, profile: str = "surface") -> DataFrame:
    """(term, doc_id, positions, tf), positions ascending; tf is their number. Rows of one doc_id count as one document."""
    if one_row_each(docs):
        return row_postings(docs, profile)
    rows = analysis.occurrences(docs)
    if profile == "stemmed":
        rows = analysis.with_stems(rows)
    return rows.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count(F.lit(1)).cast("int").alias("tf"))


def term_frequencies(docs: DataFrame, profile: str = "surface") -> DataFrame:
    """(term, doc_id, tf): postings without positions; counts combine before the shuffle."""
    rows = analysis.terms(docs)
    if profile == "stemmed":
        rows = analysis.with_stems(rows)
    return rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def merge_postings(rows: DataFrame) -> DataFrame:
    """Postings of several deltas as one table: positions of a (term, doc_id) that is in more than one are united."""
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions"))))
    both = rows.groupBy("term", "doc_id").agg(places.alias("positions"))
    return both.withColumn("tf", F.size("positions").cast("int"))


def vocabulary(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with the smoothed idf ln((N+1)/(df+1)) + 1."""
    idf = F.log((F.lit(float(n_docs)) + 1) / (F.col("df") + 1)) + 1
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf)


def grams(vocab: DataFrame, k: int = 3) -> DataFrame:
    """(gram, term)."""
    return vocab.select(F.explode(analysis.kgrams(F.col("term"), k)).alias("gram"), "term")


def doc_norms(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, norm): root of the sum of squared (1 + ln tf) * idf.

    The vocabulary side has one row per term, so a hot term only lengthens the postings side,
    which AQE splits. Squares are summed in a fixed order to keep the result reproducible.
    """
    weight = (1 + F.log("tf")) * F.col("idf")
    rows = tf.join(vocab.select("term", "idf"), "term").select("doc_id", "term", (weight * weight).alias("w2"))
    return rows.groupBy("doc_id").agg(F.sqrt(F.sum("w2")).alias("norm"))


def _by_weight() -> Window:
    # within a term the weight grows strictly with tf
    return Window.partitionBy("term").orderBy(F.desc("tf"), F.desc("doc_id"))


def champions(tf: DataFrame, r: int = 32) -> DataFrame:
    """(term, rank, doc_id): the r postings of most weight, ties to the larger doc_id.

    Rows are dealt by term before they are sorted, so that a task sorts what AQE puts into a partition and not
    what a file split holds, whose rows grow with the table until a split is full.
    """
    ranked = tf.select("term", "doc_id", "tf").repartition("term").withColumn("rank", F.row_number().over(_by_weight()))
    return ranked.filter(F.col("rank") <= r).select("term", "rank", "doc_id")


def tiers(tf: DataFrame, sizes: tuple[int, ...] = (16, 64)) -> DataFrame:
    """(term, tier, doc_id): tier i holds the next sizes[i] postings by weight, the last tier the rest.

    One shuffle and one sort rank all rows; a task streams the ranks of a term, whose rows are one per document at most.
    """
    sizes = tuple(sizes) or (16, 64)
    tier, upto = F.lit(len(sizes)), sum(sizes)
    ranked = tf.select("term", "doc_id", "tf").withColumn("rank", F.row_number().over(_by_weight()))
    for i in reversed(range(len(sizes))):
        tier = F.when(F.col("rank") <= upto, F.lit(i)).otherwise(tier)
        upto -= sizes[i]
    return ranked.select("term", tier.alias("tier"), "doc_id")


def write_table(df: DataFrame, path: str, key: str, dealt: bool = False) -> None:
    """Dealt by key and sorted by it, with a Parquet bloom filter on it; AQE splits the rows of a hot key over files.

    Dealing needs no sample, for which a range partitioning would compute the table twice. A table that is dealt
    by key already stays as it is.
    """
    by = [key, *[c for c in ("doc_id",) if c in df.columns and c != key and not dealt]]
    (
        (df if dealt else df.hint("rebalance", key))
        .sortWithinPartitions(*by)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .parquet(path)
    )
