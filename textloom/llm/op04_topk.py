"""Exact top-k search by distributed histogram selection.

All vectors are scored against a block of queries; each task sends a histogram of its scores per
query, and the summed histograms locate the bucket of every query's kth best score. That bucket is
refined until it is one score wide. A last pass keeps the scores above the kth and, of those equal
to it, the smallest ids. A task's histogram ends at its own kth best score: the global kth can't
be lower, so a task sends at most k buckets a query.

Queries go in blocks of ``block`` vectors, the only thing that is sent to all tasks. Scores are
exact: products run in float64 while a bound shows that they stay below 2^53, in int64 below 2^63;
vectors beyond that run in Python integers, each for itself. A score is a long: beyond ``LIMIT`` either
way it counts as LIMIT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch

STEP = 11  # bits that a round of refinement adds
LIMIT = 1 << 60


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): vectors as whole numbers floor(scale * x), without those that are null or hold a null or non-finite component.

    Components beyond 2^62 either way count as 2^62. An empty vector is one of no components.
    """
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray | None:
    """Vectors of the given width; None if there are none."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    return None


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products, queries by vectors, as int64 within LIMIT."""
    top = int(np.abs(q).max(initial=0)) * q.shape[1]
    each = np.abs(v).max(1, initial=0)
    if top * int(each.max(initial=0)) < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    wide = np.array([top * int(x) >= 2**63 for x in each], bool)
    out = np.zeros((len(q), len(v)), np.int64)
    out[:, ~wide] = q @ v[~wide].T
    if wide.any():
        exact = q.astype(object) @ v[wide].astype(object).T
        out[:, wide] = np.minimum(np.maximum(exact, -LIMIT), LIMIT).astype(np.int64)
    return np.clip(out, -LIMIT, LIMIT)


class _Pass:
    """Scores of one block of queries over the rows of a task."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row ids and scores; a query's own rows score the least number."""
        width = self.q.shape[1]
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids, column = part.column("vec_id").to_numpy(), part.column("v")
                m = _matrix(column, width)
                if m is None:  # vectors of other lengths can't be compared with these queries
                    same = np.array([len(x) == width for x in column])
                    ids, column = ids[same], column.filter(pa.array(same))
                    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
                s = products(self.q, m)
                s[self.ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
                yield ids, s


class _Histogram(_Pass):
    """(query, bucket, n) of the scores in [low, high) of each query, in buckets of 2^shift."""

    def __init__(self, ids, q, k, low, high, shift):
        super().__init__(ids, q, k)
        self.low, self.high, self.shift = low, high, shift

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)
        for _, s in self.scored(batches):
            for i, row in enumerate(s):
                row = row[(row >= self.low[i]) & (row < self.high[i])]
                if len(row):
                    b = np.concatenate([held[i][0], (row - self.low[i]) >> self.shift[i]])
                    n = np.concatenate([held[i][1], np.ones(len(row), np.int64)])
                    b, at = np.unique(b, return_inverse=True)
                    n = np.bincount(at, n).astype(np.int64)
                    keep = np.cumsum(n[::-1])[::-1] - n < self.k  # buckets down to this task's own kth
                    held[i] = b[keep], n[keep]
        q = np.repeat(np.arange(len(held)), [len(b) for b, _ in held])
        b, n = (np.concatenate([h[x] for h in held]) for x in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(n)], ["q", "b", "n"])


class _Filter(_Pass):
    """(query_id, vec_id, score) of the scores that reach the kth; of ties with it, the k smallest ids of the task."""

    def __init__(self, ids, q, k, kth):
        super().__init__(ids, q, k)
        self.kth = kth

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.iinfo(np.int64).min
        ties: dict[int, np.ndarray] = {}
        for ids, s in self.scored(batches):
            i, j = np.nonzero((s > self.kth[:, None]) & (s != least))
            yield self._batch(i, ids[j], s[i, j])
            for i in np.flatnonzero((s == self.kth[:, None]).any(1) & (self.kth != least)):
                ties[i] = np.sort(np.concatenate([ties.get(i, ids[:0]), ids[s[i] == self.kth[i]]]))[: self.k]
        for i, ids in ties.items():
            yield self._batch(np.full(len(ids), i), ids, np.full(len(ids), self.kth[i]))

    def _batch(self, i: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(ids.astype(np.int64)), pa.array(s.astype(np.int64))], ["query_id", "vec_id", "score"])


def _block(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Top-k rows of one block of queries, ranked."""
    spread = max((sum(abs(int(x)) for x in row) for row in q), default=0)
    top = rows.agg(F.max(F.expr("array_max(transform(v, x -> abs(x)))"))).first()[0] or 0
    reach = min(spread * int(top), LIMIT) + 1
    bits = max(1, (2 * reach).bit_length())
    n = len(ids)
    low, width, need = np.full(n, -reach, np.int64), np.full(n, bits, np.int64), np.full(n, k, np.int64)
    open_ = np.ones(n, bool)
    kth = np.full(n, np.iinfo(np.int64).min, np.int64)
    while open_.any():
        shift = np.maximum(width - STEP, 0)
        at = np.flatnonzero(open_)
        hist = rows.mapInArrow(_Histogram(ids[at], q[at], k, low[at], low[at] + (1 << width[at]), shift[at]), "q long, b long, n long")
        w = Window.partitionBy("q").orderBy(F.desc("b"))
        upto = hist.groupBy("q", "b").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        goal = rows.sparkSession.createDataFrame([(j, int(x)) for j, x in enumerate(need[at])], "q long, need long")
        found = upto.join(goal, "q")
        edge = found.filter(F.col("upto") >= F.col("need")).groupBy("q").agg(F.max(F.struct("b", "n", "upto")).alias("e"))
        seen = {r["q"]: r["e"] for r in edge.collect()}
        for j, i in enumerate(at):
            if j not in seen:  # fewer candidates than wanted: all are kept
                open_[i] = False
                kth[i] = -reach - 1
                continue
            e = seen[j]
            low[i] += int(e["b"]) << int(shift[j])
            need[i] -= e["upto"] - e["n"]
            width[i] = shift[j]
            if not shift[j]:
                open_[i], kth[i] = False, low[i]
    hits = rows.mapInArrow(_Filter(ids, q, k, kth), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, scratch: Scratch, every: int = 100, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``every``. Candidates are all rows of the query's length but
    those with the query's id; empty vectors score 0 against each other. Of repeated rows of a query's id,
    the one with the smallest vector asks; repeated candidates each take a rank. Rows without an id, and
    vectors that are null or hold a null or non-finite component, take no part; a query without candidates has no row.
    """
    rows = scratch.save(usable(vectors), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n = total[0] or 0
    parts = -(-n // block)
    out = None
    for p in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p) if parts > 1 else asked
        found = mine.orderBy("vec_id").collect()
        for width in sorted({len(r["v"]) for r in found}):
            own = [r for r in found if len(r["v"]) == width]
            ids, q = np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64).reshape(len(own), width)
            part = scratch.save(_block(rows, ids, q, k), "hits")
            out = part if out is None else out.union(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
