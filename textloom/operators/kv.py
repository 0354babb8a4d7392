"""Log-structured key-value table: newest write wins, deletes are a flag, never a value.

A store is a Parquet folder of generations; each holds deltas that flush() or append() wrote:

    <path>/gen-<n>/delta-<seq>/    rows sorted by key, complete once Spark's _SUCCESS is there
    <path>/gen-<n>/_DONE           written last by a compaction

The current generation is the largest with _DONE (0 needs none). ``compact`` writes the current view
to the next generation and then its _DONE, a file that is created once and never rewritten, so an
interruption at any point leaves the old generation readable and whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, value binary, seq bigint, is_delete boolean"
MEMBERS = "key string, member bigint"


def current(log: DataFrame) -> DataFrame:
    """(key, value, seq) of each live key: newest seq wins, deleted keys are gone.

    One aggregation with map-side combine, so many versions of a hot key meet as one row per task.
    """
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "is_delete"), "seq").alias("last"), F.max("seq").alias("seq"))
    return last.filter(~F.col("last.is_delete")).select("key", F.col("last.value").alias("value"), "seq")


def get(log: DataFrame, key: str) -> DataFrame:
    """At most one row (key, value, seq); the key filter reaches the scan."""
    return current(log.filter(F.col("key") == key))


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, seq) of each of the keys that is live: a batch of point reads as one semi-join before the fold."""
    return current(log.join(keys.select("key"), "key", "left_semi"))


def scan(log: DataFrame, low: str, high: str, limit: int | None = 64) -> DataFrame:
    """(key, value, seq) for low <= key <= high ascending; deleted keys don't count toward the limit."""
    found = current(log.filter(F.col("key").between(low, high))).orderBy("key")
    return found if limit is None else found.limit(limit)


def scan_many(log: DataFrame, ranges: DataFrame, limit: int = 64, prefix: int = 3) -> DataFrame:
    """(low, high, key, value, seq): the first ``limit`` live keys of each range whose ends share ``prefix`` characters.

    A batch of short scans is one join on the common beginning; the rank becomes a group limit before the
    shuffle. Ranges whose ends differ earlier belong to ``scan``, and are refused by an error.
    """
    r = ranges.select("low", "high", F.when(F.substring("low", 1, prefix) == F.substring("high", 1, prefix), F.substring("low", 1, prefix)).otherwise(F.raise_error("a range spans several prefixes")).alias("_p"))
    found = current(log).withColumn("_p", F.substring("key", 1, prefix)).join(r, "_p").filter(F.col("key").between(F.col("low"), F.col("high")))
    rank = F.row_number().over(Window.partitionBy("low", "high").orderBy("key"))
    return found.withColumn("_n", rank).filter(F.col("_n") <= limit).select("low", "high", "key", "value", "seq")


def keys(log: DataFrame) -> DataFrame:
    """(key) of all live keys, ascending."""
    return current(log).select("key").orderBy("key")


def merged(postings: DataFrame, low: str | None = None, high: str | None = None, limit: int | None = None) -> DataFrame:
    """(term, doc_ids): all values of a key merged, over an inclusive key range, ascending.

    Values are made distinct as rows first, so only a key's own set is gathered; whole tables are merged
    by ``merge_members``, which never gathers.
    """
    rows = postings
    if low is not None:
        rows = rows.filter(F.col("term") >= low)
    if high is not None:
        rows = rows.filter(F.col("term") <= high)
    rows = rows.select("term", "doc_id").distinct()
    if limit is not None:  # keys first, so that no value beyond the limit is gathered
        rows = rows.join(rows.select("term").distinct().orderBy("term").limit(limit), "term", "left_semi")
    return rows.groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids")).orderBy("term")


def merge_members(deltas: DataFrame) -> DataFrame:
    """(key, member): the union of all deltas' sets. A set stays rows, so a hot key spreads over tasks."""
    return deltas.select("key", "member").distinct()


def newest(log: DataFrame) -> DataFrame:
    """Newest row per key; the plan for logs whose values are too large to aggregate.

    The rank filter is a group limit before and after the shuffle: a hot key sends one row per task.
    """
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


class _Folder:
    """Generations and deltas below a path that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.gen = max([0, *(int(m[1]) for p in self._children(self.path) if (m := re.search(r"/gen-(\d+)$", p)) and self._exists(f"{p}/_DONE"))])

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def _children(self, path: str) -> list[str]:
        return sorted(s.getPath().toString() for s in self.fs.listStatus(self._path(path))) if self._exists(path) else []

    def _dir(self) -> str:
        return f"{self.path}/gen-{self.gen}"

    def _deltas(self) -> list[str]:
        return [p for p in self._children(self._dir()) if "/delta-" in p and self._exists(f"{p}/_SUCCESS")]

    def _put(self, rows: DataFrame, name: str) -> None:
        rows.write.option("parquet.bloom.filter.enabled#key", "true").mode("overwrite").parquet(name)

    def _next(self, view: DataFrame, delta: str) -> None:
        """Write the view, each partition sorted by key, as the next generation, make it current, delete the others."""
        new = f"{self.path}/gen-{self.gen + 1}"
        self._put(view.sortWithinPartitions("key"), f"{new}/{delta}")
        self.fs.create(self._path(f"{new}/_DONE"), True).close()
        self.gen += 1
        for p in self._children(self.path):
            if (m := re.search(r"/gen-(\d+)$", p)) and int(m[1]) < self.gen:
                self.fs.delete(self._path(p), True)

    def stats(self) -> dict[str, int]:
        """Number of deltas and their bytes on disk."""
        found = self._deltas()
        return {"runs": len(found), "bytes": sum(self.fs.getContentSummary(self._path(p)).getLength() for p in found)}


class Store(_Folder):
    """A key-value store: writes are held until a flush, reads see them at once."""

    def __init__(self, spark: SparkSession, path: str, memtable_limit: int = 50_000, max_deltas: int = 8):
        super().__init__(spark, path)
        self.limit, self.max_deltas = memtable_limit, max_deltas
        self.pending: dict[str, tuple[bytes | None, int, bool]] = {}
        top = self._log().agg(F.max("seq")).first()[0]
        self.seq = 0 if top is None else top

    def _log(self) -> DataFrame:
        found = self._deltas()
        return self.spark.read.schema(SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)

    def log(self) -> DataFrame:
        """All writes, flushed or not."""
        if not self.pending:
            return self._log()
        rows = [(k, v, s, d) for k, (v, s, d) in self.pending.items()]
        return self._log().union(self.spark.createDataFrame(rows, SCHEMA))

    def put(self, key: str, value: bytes) -> None:
        self._write(key, value, False)

    def delete(self, key: str) -> None:
        self._write(key, None, True)

    def _write(self, key: str, value: bytes | None, is_delete: bool) -> None:
        self.seq += 1
        self.pending[key] = (value, self.seq, is_delete)
        if len(self.pending) >= self.limit:
            self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        rows = [(k, v, s, d) for k, (v, s, d) in sorted(self.pending.items())]
        self._put(self.spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{self._dir()}/delta-{self.seq:020d}")
        self.pending = {}
        if len(self._deltas()) > self.max_deltas:
            self.compact()

    def append(self, rows: DataFrame) -> None:
        """Bulk write of (key, value, is_delete): the distributed path; the batch gets one block of seq."""
        self.flush()
        order = F.monotonically_increasing_id() + (self.seq + 1)
        out = rows.select("key", F.col("value").cast("binary").alias("value"), order.alias("seq"), "is_delete")
        self._put(out.repartitionByRange("key").sortWithinPartitions("key"), f"{self._dir()}/delta-{self.seq + 1:020d}")
        self.seq = self._log().agg(F.max("seq")).first()[0] or self.seq

    def append_stream(self, path: str) -> int:
        """Add the batches of a ``stream_kv`` sink that are complete and not in the store yet; returns how many rows.

        Streamed rows carry their own seq, which orders them against each other and the store's writes.
        """
        self.flush()
        fs_rows, done = 0, {p.rsplit("-", 1)[-1] for p in self._deltas() if "/delta-s-" in p}
        for p in self._children(path):
            if (m := re.search(r"/batch=(\d+)$", p)) and self._exists(f"{p}/_SUCCESS") and m[1] not in done:
                rows = self.spark.read.schema(SCHEMA).parquet(p)
                self._put(rows, f"{self._dir()}/delta-s-{m[1]}")
                fs_rows += rows.count()
        top = self._log().agg(F.max("seq")).first()[0]
        self.seq = max(self.seq, top or 0)
        return fs_rows

    def get(self, key: str) -> bytes | None:
        row = get(self.log(), key).first()
        return None if row is None else bytes(row["value"])

    def scan(self, low: str, high: str, limit: int | None = 64) -> DataFrame:
        return scan(self.log(), low, high, limit)

    def compact(self) -> None:
        self.flush()
        self._next(current(self._log()).select("key", "value", "seq", F.lit(False).alias("is_delete")).repartitionByRange("key"), f"delta-{self.seq:020d}")


class MergingStore(_Folder):
    """A store of sets: a put adds members to a key's set, a read is the union over all deltas.

    Members are rows, not values, so merging is a distinct and no set has to fit one row.
    """

    def __init__(self, spark: SparkSession, path: str, memtable_limit: int = 50_000, max_deltas: int = 8):
        super().__init__(spark, path)
        self.limit, self.max_deltas, self.pending = memtable_limit, max_deltas, set()

    def rows(self) -> DataFrame:
        """(key, member) of all deltas and pending puts, maybe repeated."""
        found = self._deltas()
        out = self.spark.read.schema(MEMBERS).parquet(*found) if found else self.spark.createDataFrame([], MEMBERS)
        return out.union(self.spark.createDataFrame(sorted(self.pending), MEMBERS)) if self.pending else out

    def put(self, key: str, members: set[int]) -> None:
        self.pending.update((key, m) for m in members)
        if len(self.pending) >= self.limit:
            self.flush()

    def _name(self) -> str:
        return f"{self._dir()}/delta-{max([0, *(int(p.rsplit('-', 1)[-1]) for p in self._deltas())]) + 1:020d}"

    def append(self, rows: DataFrame) -> None:
        """Bulk put of (key, member) rows."""
        self._put(merge_members(rows).sortWithinPartitions("key"), self._name())

    def flush(self) -> None:
        if self.pending:
            self._put(self.spark.createDataFrame(sorted(self.pending), MEMBERS).coalesce(1), self._name())
            self.pending = set()
        if len(self._deltas()) > self.max_deltas:
            self.compact()

    def get(self, key: str) -> DataFrame:
        """(member) of a key, distinct; an unknown key has none."""
        return merge_members(self.rows().filter(F.col("key") == key)).select("member")

    def scan(self, low: str, high: str) -> DataFrame:
        """(key, member), merged, for low <= key <= high."""
        return merge_members(self.rows().filter(F.col("key").between(low, high))).orderBy("key", "member")

    def keys(self) -> DataFrame:
        """(key), distinct, ascending."""
        return self.rows().select("key").distinct().orderBy("key")

    def compact(self) -> None:
        """Merge all deltas into one generation."""
        rows, self.pending = self.rows(), set()
        self._next(merge_members(rows), f"delta-{1:020d}")
