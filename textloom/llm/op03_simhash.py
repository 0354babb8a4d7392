"""SimHash near-duplicates by pivot distance tables.

Each text gets a 64-bit SimHash of its word shingles. Every distinct fingerprint gets a row of Hamming
distances to fixed reference fingerprints (pivots). By the triangle inequality two fingerprints
within ``RADIUS`` bits differ by at most RADIUS in each distance, and pairs with a larger coordinate
difference are never compared:

* Key pivots are the zero fingerprint and one pivot for each of 16 blocks of four bits, all ones there. A
  block's distance less the zero pivot's takes five values, and a differing bit moves one of the 16
  by one step. These quantized coordinates are a fingerprint's cell. Each fingerprint is sent to its
  cell and the cells one step away (33 at most): two fingerprints two steps apart meet in a cell between.
* Inside a cell, pairs are discarded by the difference of their distances to the zero pivot, then by the
  largest difference over ``DENSE`` random pivots, and survivors verified by their Hamming distance.

Only distinct fingerprints are joined, so any number of copies counts once. Cells beside a crowded one
(see ``crowded``) are split by a finer table with one key pivot per bit: coordinates then tell the
fingerprint itself, and a cell holds at most 65, all of them linked. A cell yields a spanning forest or, with
eight fingerprints or fewer, its links; never all pairs of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, released
from textloom.llm.components import components

RADIUS, WORDS, SEED = 2, 3, 42
BLOCK = 4
#: Key pivots: all ones in a block.
BLOCKS = [((1 << BLOCK) - 1) << at for at in range(0, 64, BLOCK)]
#: Dense pivots for the tests inside a cell.
DENSE = 32
PIVOTS = np.random.default_rng(20240607).integers(0, 2**64, DENSE, dtype=np.uint64)
#: Cells of up to so many fingerprints are compared pair by pair, larger ones breadth first.
FEW = 8


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The SimHash of a text's shingles; ASCII letters lower-cased, words cut at ASCII white space.

    Fewer words than a shingle are one feature; no words give zero.
    """
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts, ends = [0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        rest = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(fp)], [*rest, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(released(_fingerprints), "doc_id long, fp long")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(fp: Column, pivot: int) -> Column:
    """Hamming distance to a reference fingerprint."""
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)).cast("long")))


def coordinates(fp: Column) -> list[Column]:
    """The quantized distances to the key pivots, 0 to BLOCK each: how far a block's pivot is nearer than the zero pivot."""
    zero = distance(fp, 0)
    return [F.floor((zero - distance(fp, p) + BLOCK) / 2).cast("long") for p in BLOCKS]


def _cell(at: Column) -> Column:
    """The number of a cell, one digit for each coordinate of an array."""
    return F.aggregate(at, F.lit(0).cast("long"), lambda n, c: n * (BLOCK + 1) + c)


def _beside(cell: Column, at: Column) -> Column:
    """array<long>: the cell, and those one step away along a coordinate."""
    weights = F.array(*[F.lit((BLOCK + 1) ** (len(BLOCKS) - 1 - i)).cast("long") for i in range(len(BLOCKS))])
    up = F.filter(F.zip_with(at, weights, lambda c, w: F.when(c < BLOCK, cell + w)), lambda x: x.isNotNull())
    down = F.filter(F.zip_with(at, weights, lambda c, w: F.when(c > 0, cell - w)), lambda x: x.isNotNull())
    return F.concat(F.array(cell), up, down)


def table(fps: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to the dense pivots."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _near(fps: np.ndarray, zero: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) are linked: by zero pivot, dense pivots a few at a time, then exactly."""
    left = np.flatnonzero(np.abs(zero[i] - zero[j]) <= RADIUS)
    for k in range(0, DENSE, 8):
        a, b = fps[i[left]], fps[j[left]]
        p = PIVOTS[None, k : k + 8]
        apart = np.abs(np.bitwise_count(a[:, None] ^ p).astype(np.int8) - np.bitwise_count(b[:, None] ^ p).astype(np.int8)).max(1, initial=0)
        left = left[apart <= RADIUS]
    return left[np.bitwise_count(fps[i[left]] ^ fps[j[left]]) <= RADIUS]


def cell_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one cell.

    Breadth first: each fingerprint is compared with those not reached yet, first by the window of
    its distance to the zero pivot, then by its largest coordinate difference, then exactly.
    """
    zero = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(zero, kind="stable")
    fps, zero = fps[order], zero[order]
    far = table(fps)
    todo, out = np.arange(len(fps)), []
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            i = queue.pop()
            low, high = np.searchsorted(zero[todo], [zero[i] - RADIUS, zero[i] + RADIUS + 1])
            near = todo[low:high]
            near = near[np.abs(far[near] - far[i]).max(1, initial=0) <= RADIUS]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= RADIUS]
            if len(near):
                out += [(int(fps[i]), int(fps[j])) for j in near]
                queue += near.tolist()
                todo = np.setdiff1d(todo, near, assume_unique=True)
    return out


def _links_of(cell: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
    """(n, 2) arrays of linked fingerprints, for rows sorted by cell."""
    if len(fps) < 2:
        return
    new = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fps)]])
    size = ends - starts
    small = (size > 1) & (size <= FEW)
    zero = np.bitwise_count(fps).astype(np.int16)
    first, stop = starts[small], ends[small]
    for a in range(FEW - 1):
        for b in range(a + 1, FEW):
            here = first[first + b < stop]
            if not len(here):
                break
            i, j = here + a, here + b
            ok = _near(fps, zero, i, j)
            yield np.column_stack([fps[i[ok]], fps[j[ok]]])
        first, stop = first[first + a + 1 < stop], stop[first + a + 1 < stop]
    for k in np.flatnonzero(size > FEW):
        yield np.array(cell_links(fps[starts[k] : ends[k]]), np.uint64).reshape(-1, 2)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of all cells of a partition that is sorted by cell."""
    cell, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def batch(found: Iterator[np.ndarray]) -> pa.RecordBatch:
        a = np.concatenate([np.zeros((0, 2), np.uint64), *found])
        a = np.unique(np.sort(a.view(np.int64), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

    for b in batches:
        cell = np.concatenate([cell, b.column("cell").to_numpy()])
        fps = np.concatenate([fps, b.column("fp").to_numpy().view(np.uint64)])
        other = np.flatnonzero(cell != cell[-1]) if len(cell) else cell
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield batch(_links_of(cell[:cut], fps[:cut]))
            cell, fps = cell[cut:], fps[cut:]
    yield batch(_links_of(cell, fps))


def _fine(fps: DataFrame) -> DataFrame:
    """Edges among fingerprints by one key pivot per bit: those one step from a common cell are linked to its least."""
    steps = F.concat(F.array(F.lit(0).cast("long")), F.array(*[F.lit(_signed(1 << k)).cast("long") for k in range(64)]))
    sent = fps.select("fp", F.explode(F.transform(steps, lambda k: F.col("fp").bitwiseXOR(k))).alias("cell"))
    held = sent.groupBy("cell").agg(F.min("fp").alias("u"), F.array_distinct(F.collect_list("fp")).alias("all"))  # 65 at most
    return held.filter(F.size("all") > 1).select("u", F.explode("all").alias("v")).filter("u <> v")


def links(distinct: DataFrame, scratch: Scratch, crowded: int = 128) -> DataFrame:
    """(u, v): edges that connect exactly the fingerprints linked by chains of at most RADIUS bits.

    A cell gets fingerprints from itself and 32 others. If none of these holds more than ``crowded``, it has at
    most 33 x crowded; all cells beside a crowded one are split by the finer table.
    """
    homes = distinct.select("fp", F.array(*coordinates(F.col("fp"))).alias("at")).withColumn("home", _cell(F.col("at")))
    many = homes.groupBy("home", "at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded)
    many = scratch.save(many.select(F.explode(_beside(F.col("home"), F.col("at"))).alias("cell")).distinct(), "crowded")
    sent = homes.select("fp", F.explode(_beside(F.col("home"), F.col("at"))).alias("cell"))
    split = not many.isEmpty()
    kept = sent.join(many, "cell", "left_anti") if split else sent
    edges = kept.repartition("cell").sortWithinPartitions("cell").mapInArrow(released(_linked), "u long, v long")
    return edges.union(_fine(sent.join(many, "cell", "left_semi").select("fp").distinct())) if split else edges


def _named(rows: DataFrame, scratch: Scratch, crowded: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of rows (doc_id, fp)."""
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(scratch.save(links(distinct, scratch, crowded), "links"), scratch)
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return scratch.save(named.join(lowest, "root").select("fp", "root", "component_id"), "ids")


def classes(docs: DataFrame, scratch: Scratch, crowded: int = 128) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the smallest doc_id reachable by links, the document's own included. Texts
    without words have fingerprint zero and are linked like others. A row without doc_id gets its
    class's id (null if no row of the class has one). Repeated rows share fingerprint and class.
    """
    rows = scratch.save(fingerprints(docs), "fps")
    return rows.join(_named(rows, scratch, crowded), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, crowded: int = 128) -> DataFrame:
    """One row of each class, all columns unchanged: the smallest doc_id's (null last), of its texts the one with the least hash.

    Rows without an id and repeated rows are members of their class like any others; of rows equal in id and text, any one stays.
    """
    key = F.xxhash64(F.lit("row"), "doc_id", F.coalesce("text", F.lit(""))).alias("key")
    rows = scratch.save(docs.select("doc_id", key, "text").mapInArrow(released(_fingerprints), "doc_id long, key long, fp long"), "fps")
    named = rows.join(_named(rows, scratch, crowded).select("fp", "root"), "fp")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")).select(F.col("best.key").alias("key"))
    whole = docs.select(F.struct("*").alias("doc"), key).join(scratch.save(best, "best"), "key", "left_semi")
    return whole.dropDuplicates(["key"]).select("doc.*")
