"""Shared pieces: tables cut from their lineage, folds, word patterns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.scratch import Scratch, shared_root

__all__ = ["Scratch", "bounded_sample", "fold", "release_memory", "released", "shared_root"]

#: A word of the mixing and near-duplicate contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, by: str, limit: int, key: str = "doc_id") -> DataFrame:
    """At most about ``limit`` rows for each value of ``by``, chosen by a hash of the key.

    Two light passes over (key, by): counts give each value a hash threshold, then a filter
    applies it. Nothing is sorted, and the choice does not depend on partitioning.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, limit / n))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(unit < share)


def release_memory() -> None:
    """Give the freed memory of a Python worker back to the system, as idle workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with what its task held, its last batch included, given back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole
