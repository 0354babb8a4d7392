"""Folders of text files as a documents table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.scratch import Scratch

SUFFIXES = ("txt", "md", "py")
SCHEMA = "doc_id bigint, path string, text string, date string, start_date string, end_date string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = (content.as_py() or b"").decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text])], ["path", "text"])


def read(spark: SparkSession, path: str, any_suffix: bool = False) -> DataFrame:
    """(path, text) of the .txt, .md and .py files below a folder, or of one file; bad bytes are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if not any_suffix:
        files = files.filter(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$"))
    return files.mapInArrow(_decode, "path string, text string")


def numbered(rows: DataFrame, key: str | list[str], first: int = 0, name: str = "doc_id") -> DataFrame:
    """rows with dense ids from ``first`` in the order of ``key``, one column or several.

    Rows are range-partitioned by the key, sorted, and written once to the shared folder, each with its
    partition and its place there; ids come from that table, so sizes and rows can't stem from two
    different partitionings. A partition's offset is the count of those before it (one number per
    partition on the driver); no task ever sees all rows.
    """
    by = [key] if isinstance(key, str) else key
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    table = Scratch(rows.sparkSession).save(placed, "numbered")
    part = F.shiftrightunsigned("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in table.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    start, at = [], first
    for p, n in sizes:
        start.append((p, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(start, "_part bigint, _offset bigint")
    place = F.col("_place").bitwiseAND((1 << 33) - 1)
    # one row per partition of the table: bounded, whatever the rows
    return table.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + place).drop("_part", "_offset", "_place")


def _undated(rows: DataFrame) -> DataFrame:
    empty = {c: F.lit(None).cast("string") for c in ("date", "start_date", "end_date")}
    return rows.withColumns(empty).select("doc_id", "path", "text", *empty)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The folder as a documents table, ids by path order, dates null."""
    return _undated(numbered(read(spark, path), "path"))


def new_documents(spark: SparkSession, known: DataFrame, path: str, any_suffix: bool = False) -> DataFrame:
    """Documents below the path whose path isn't known yet, with ids after the largest known one."""
    top = known.agg(F.max("doc_id")).first()[0]
    fresh = read(spark, path, any_suffix).join(known.select("path"), "path", "left_anti")
    return _undated(numbered(fresh, "path", 0 if top is None else top + 1))


def reread(spark: SparkSession, docs: DataFrame, folders: list[str]) -> DataFrame:
    """docs with the text that their files below the folders hold now; a document whose file is gone is left out."""
    found = None
    for f in folders:
        rows = read(spark, f, any_suffix=True)
        found = rows if found is None else found.union(rows)
    return docs.drop("text").join(found.dropDuplicates(["path"]), "path").select(*docs.columns) if folders else docs
