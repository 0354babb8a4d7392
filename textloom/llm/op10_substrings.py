"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text (words joined by one space); at the end of a word where
it is the least of some ``VIEW`` successive word ends, a chunk ends. Cuts depend on nearby bytes
only, so chunks resist insertions before them, and none is longer than ``VIEW`` words, whatever the
text. Each chunk gets one digest, and only chunks whose digest occurs again, anywhere, go on:

* Successive repeated chunks of a text are joined to runs of at least ``RUN_WORDS`` words, which a short chunk
  alone (a common word) doesn't make. A run that occurs again has a partner, the first place that holds it (for
  the first place, the last one).
* Overlapping repeated runs of a text make a passage, extended word by word at both ends as far as it agrees with
  the partner of its outermost run. Passages of at least ``SPAN_WORDS`` words are repeats.
* A partner is one place of many, and runs of a passage may have different ones. A passage is settled if it agrees
  with one place in SPAN_WORDS words, or has a single partner and no other place. Of all others, every stretch of
  SPAN_WORDS words in the passage and BESIDE words around it is hashed, and those that occur again are repeats.

Equal texts are chunked as one text; that they are equal is a repeat of the whole.

A hash depends on 16 bytes (at most 7 words of a passage come before its first shared hash), so two
copies of a passage have the same cuts from the least of its first VIEW shared word ends to that of its last VIEW. These
are RUN_WORDS words or more apart, and the passage has a run, if it has 6 + 2 VIEW + RUN_WORDS = 50 words or more;
fewer than 3 VIEW words are left to either end.

Chunks and runs are counted with map-side combine, so the commonest passage is one row per task; the joins
that mark them and look up words have one row per digest or place on the right, so AQE can split the
commonest there. What follows is grouped by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, released

VIEW, RUN_WORDS, SPAN_WORDS = 12, 20, 48
#: These bits of the hash depend on 16 bytes.
CUT_MASK = 0xFFFF
#: Words beside a stretch that may belong to the passage.
BESIDE = 3 * VIEW
#: Words or windows that a task holds as Python objects.
HELD = 100_000
GEAR = np.random.default_rng(20240613).integers(0, 2**32, 256, dtype=np.uint32)
#: Stands for a null id, which comes last.
LAST = (1 << 63) - 1
#: An odd number has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] mod 2^32 at every byte, by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(h: np.ndarray) -> np.ndarray:
    """Where h is the least (the last of equal ones) of some VIEW successive values."""
    n = len(h)
    if n < VIEW:
        return np.zeros(0, np.int64)
    key = (h.astype(np.int64) << 32) | np.arange(n - 1, -1, -1)
    low = key[: n - VIEW + 1].copy()
    for k in range(1, VIEW):
        np.minimum(low, key[k : n - VIEW + 1 + k], out=low)
    at = n - 1 - (low & 0xFFFFFFFF)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def chunks(text: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The normalized text, and byte and word offsets of its chunk borders, both ends included."""
    data = b" ".join((text or b"").split())
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 32)
    cut = cuts(gear(raw)[ends] & np.uint32(CUT_MASK)) if len(ends) else ends
    words = len(ends) + 1 if data else 0
    return data, np.concatenate([[0], ends[cut] + 1, [len(data) + 1]]), np.concatenate([[0], cut + 1, [words]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, row, doc_id, first, size) of every chunk, doc_id left out; and a row of each text without digest, its words as ``first``."""
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for low in range(0, b.num_rows, 256):
            digests, counts, first, size, words = [], [], [], [], []
            for t in texts.slice(low, 256):
                data, at, word = chunks(t.as_py())
                edges = at.tolist() if data else [0]
                digests += [digest(data[x : y - 1]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                counts.append(len(edges) - 1)
                words.append(int(word[-1]))
                if data:
                    first.append(word[:-1])
                    size.append(np.diff(word))
            cat = lambda x: np.concatenate([np.zeros(0), *x]).astype(np.int32)
            n, which = len(counts), np.repeat(np.arange(low, low + len(counts)), counts)
            rows = pa.concat_arrays([b.column("row").take(pa.array(which)), b.column("row").slice(low, n)])
            ids = pa.concat_arrays([pa.nulls(len(which), pa.int64()), b.column("doc_id").slice(low, n)])
            found = pa.concat_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), pa.nulls(n, pa.int64())])
            starts, sizes = np.concatenate([cat(first), np.array(words, np.int32)]), np.concatenate([cat(size), np.zeros(n, np.int32)])
            yield pa.RecordBatch.from_arrays([found, rows, ids, pa.array(starts), pa.array(sizes)], ["digest", "row", "doc_id", "first", "size"])


def run_digests(digest: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk number, last chunk number, digest) of the shortest run of RUN_WORDS words or more from each chunk.

    Chunks come in the order of (row, first); a run goes on while one chunk ends where the next begins. Its digest
    is the sum of the chunks' digests times powers of BASE, brought to the power of its first chunk.
    """
    n = len(digest)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != end[:-1])])
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], n)[group]  # chunk after the stretch
    # a position that grows over all stretches, so that one search serves them all
    size = end - first
    at = np.concatenate([[0], np.cumsum(size)])
    stop = np.searchsorted(at, at[:-1] + RUN_WORDS)
    ok = np.flatnonzero(stop <= last)
    one = np.ones(1, np.uint64)
    power, back = (np.multiply.accumulate(np.concatenate([one, np.full(n, x, np.uint64)])) for x in (BASE, UNBASE))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest.view(np.uint64) * power[:n], dtype=np.uint64)])
    h = (total[stop[ok]] - total[ok]) * back[ok]
    return ok, stop[ok] - 1, h ^ (h >> np.uint64(29)) * np.uint64(BASE)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, doc, row, first, end) of a partition of repeated chunks, sorted by text and place; equal texts repeat places, which count once."""
    names = ("digest", "doc", "row", "first", "size")
    held = [np.zeros(0, np.int64)] * len(names)

    def of(digest, doc, row, first, size) -> pa.RecordBatch:
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1])]) if len(row) else np.zeros(0, bool)
        digest, doc, row, first, size = (x[new] for x in (digest, doc, row, first, size))
        a, z, h = run_digests(digest, row, first, first + size)
        ends = (first + size)[z].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[a]), pa.array(row[a]), pa.array(first[a].astype(np.int32)), pa.array(ends)], ["run", "doc", "row", "first", "end"])

    for b in batches:
        held = [np.concatenate([x, b.column(c).to_numpy().astype(np.int64)]) for x, c in zip(held, names, strict=True)]
        row = held[2]
        other = np.flatnonzero(row != row[-1]) if len(row) else row
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield of(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    yield of(*held)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[dict]]]:
    """Row, words and places of each text of a batch, one text at a time."""
    for d, t, places in zip(b.column("row"), b.column("text").cast(pa.binary()), b.column("places"), strict=True):
        yield d.as_py(), (t.as_py() or b"").split(), places.as_py()


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at, side, words): the words before (side 0, nearest first) or after (side 1) each place of a text."""

    def batch(out: list) -> pa.RecordBatch:
        row, at, side, near = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(side, pa.int32()), pa.array(near, pa.list_(pa.binary()))], ["row", "at", "side", "words"])

    for b in batches:
        out = []
        for d, words, places in _texts(b):
            for p in places:
                out.append((d, p["at"], p["side"], words[p["at"] : p["at"] + BESIDE] if p["side"] else words[max(0, p["at"] - BESIDE) : p["at"]][::-1]))
                if len(out) >= HELD // BESIDE:
                    yield batch(out)
                    out = []
        yield batch(out)


def _windows(n: int):
    """(row, island, doc, at, window): a digest of every n successive words of an unsettled passage with BESIDE words around it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, types = xxhash.xxh3_64_intdigest, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.uint64())

        def batch(out: list) -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)]
            return pa.RecordBatch.from_arrays([*cols[:4], cols[4].view(pa.int64())], ["row", "island", "doc", "at", "window"])

        for b in batches:
            out = []
            for d, words, places in _texts(b):
                for p in places:
                    low, high = max(0, p["first"] - BESIDE), min(len(words), p["end"] + BESIDE) - n + 1
                    while low < high:
                        stop = min(high, low + HELD - len(out))
                        out += [(d, p["island"], p["doc"], k, digest(b" ".join(words[k : k + n]))) for k in range(low, stop)]
                        low = stop
                        if len(out) >= HELD:
                            yield batch(out)
                            out = []
            yield batch(out)

    return of


def _settled(docs: DataFrame, spans: DataFrame, span_words: int, scratch: Scratch) -> DataFrame:
    """(row, island, at, again, wfirst): stretches of span_words words of unsettled passages (row, island, doc, first, end) that occur
    again. ``again`` if an earlier place holds them too, wfirst being that of the first place's text."""
    places = spans.groupBy("row").agg(F.collect_list(F.struct("island", "doc", "first", "end")).alias("places"))
    texts = docs.select(_row(), "text").join(scratch.save(places, "unsettled"), "row")
    found = scratch.save(texts.mapInArrow(released(_windows(span_words)), "row long, island long, doc long, at int, window long"), "windows")
    # equal texts repeat places, and two places differ in this hash
    place = F.xxhash64("row", "at")
    held = found.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.min(F.struct("doc", "row", "at")).alias("lead")).filter("a <> z")
    out = found.join(scratch.save(held.select("window", "lead"), "again"), "window")
    first = (F.col("row") == F.col("lead.row")) & (F.col("at") == F.col("lead.at"))
    return out.select("row", "island", "at", (~first).alias("again"), F.col("lead.doc").alias("wfirst")).distinct()


def _islands(pieces: DataFrame, *by: str) -> DataFrame:
    """pieces (first, end) with the number of the stretch that overlapping or adjoining ones of a group make up."""
    order = Window.partitionBy(*by).orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = pieces.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    return new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def _row() -> Column:
    return F.xxhash64(F.lit("text"), F.coalesce("text", F.lit(""))).alias("row")


def _grown(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """spans (row, island, first, end, p0, p1) with ``before`` and ``after``: words beyond either end that agree with that end's partner."""
    sides = [spans.select("row", "island", F.lit(i).alias("side"), F.col(at).alias("at"), F.col(f"p{i}.prow").alias("prow"), (F.col(at) - F.col(f"p{i}.delta")).cast("int").alias("pat")) for i, at in enumerate(("first", "end"))]
    ends = sides[0].unionByName(sides[1])
    places = ends.select("row", "at", "side").union(ends.select("prow", "pat", "side")).distinct()
    places = places.groupBy("row").agg(F.collect_list(F.struct("at", "side")).alias("places"))
    texts = docs.select(_row(), "text").join(scratch.save(places, "places"), "row")
    words = texts.mapInArrow(released(_beside), "row long, at int, side int, words array<binary>").dropDuplicates(["row", "at", "side"])
    words = scratch.save(words, "words")
    own = words.withColumnRenamed("words", "own")
    theirs = words.select(F.col("row").alias("prow"), F.col("at").alias("pat"), "side", F.col("words").alias("theirs"))
    differ = F.array_position(F.zip_with("own", "theirs", lambda x, y: x.eqNullSafe(y)), False)
    pairs = ends.join(own, ["row", "at", "side"]).join(theirs, ["prow", "pat", "side"])
    more = pairs.withColumn("more", F.when(differ > 0, differ - 1).otherwise(F.least(F.size("own"), F.size("theirs"))).cast("int"))
    more = more.groupBy("row", "island").agg(*(F.max(F.when(F.col("side") == i, F.col("more"))).alias(c) for i, c in enumerate(("before", "after"))))
    return spans.join(more, ["row", "island"], "left").na.fill(0, ["before", "after"])


def repeats(docs: DataFrame, scratch: Scratch, span_words: int = SPAN_WORDS) -> DataFrame:
    """(row, doc_id, start, stop, first_doc_id, cuts): every passage of span_words words or more that other places hold as well.

    A place comes before another by the smallest doc_id of its text (null last), then by a hash of the text, then by word.
    Places are in different texts or in one. ``cuts`` are the parts (start, stop) of the passage whose words stand in earlier
    places, the document first_doc_id being the one with the smallest id among those and itself. ``row`` is a hash of the
    text. Of documents equal in text the one with the smallest id has the passages, the others repeat it as a whole. Rows
    equal in id and text are one document, and so are those of one text without ids; null and empty texts have no chunks.
    """
    slim = docs.select("doc_id", "text")
    found = scratch.save(slim.select(_row(), "doc_id", "text").mapInArrow(released(_rows), "digest long, row long, doc_id long, first int, size int"), "chunks")
    ids = scratch.save(found.filter("digest is null").groupBy("row", "doc_id").agg(F.max("first").alias("n")), "ids")
    lead = scratch.save(ids.groupBy("row").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("docs"), F.max("n").alias("n")), "lead")
    chunk = found.filter("digest is not null").select("digest", "row", "first", "size")
    # two places of a digest differ in this hash
    place = F.xxhash64("row", "first")
    again = chunk.groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("z")).filter("a <> z").select("digest")
    marked = chunk.join(scratch.save(again, "digests"), "digest", "left_semi").repartition("row")
    doc = F.coalesce("keeper", F.lit(LAST)).alias("doc")
    marked = marked.join(lead.select("row", doc), "row").sortWithinPartitions("row", "first")
    run = scratch.save(marked.mapInArrow(released(_runs), "run long, doc long, row long, first int, end int"), "runs")
    scratch.drop(found)
    place = F.struct("doc", "row", "first")
    held = run.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("lead"), F.max(place).alias("tail")).filter("n > 1")
    at = run.join(scratch.save(held, "held"), "run")
    is_first = (F.col("row") == F.col("lead.row")) & (F.col("first") == F.col("lead.first"))
    other = F.when(is_first, F.col("tail")).otherwise(F.col("lead"))
    at = at.select("row", "doc", "first", "end", "n", is_first.alias("is_first"), other["row"].alias("prow"), (F.col("first") - other["first"]).alias("delta"), F.col("lead.doc").alias("lead"))
    at = _islands(at, "row")
    # the part of a passage that agrees with one place
    at = _islands(at.withColumnRenamed("island", "passage"), "row", "passage", "prow", "delta")
    one = Window.partitionBy("row", "passage", "prow", "delta", "island")
    at = at.withColumn("reach", F.max("end").over(one) - F.min("first").over(one)).withColumn("island", F.col("passage")).drop("passage")
    at = scratch.save(at, "places")
    partner = F.struct("prow", "delta", "is_first")
    place = F.struct("prow", "delta")
    spans = at.groupBy("row", "island").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), F.min_by(partner, "first").alias("p0"), F.max_by(partner, "end").alias("p1"), F.min("lead").alias("lead"),
        F.min("doc").alias("doc"), F.max("reach").alias("reach"), F.max("n").alias("n"), (F.min(place) == F.max(place)).alias("single"),
    )
    spans = _grown(slim, scratch.save(spans, "spans"), scratch).withColumn("start", F.col("first") - F.col("before")).withColumn("stop", F.col("end") + F.col("after"))
    long = F.col("stop") - F.col("start") >= span_words
    spans = scratch.save(spans.withColumn("settled", (F.col("reach") >= span_words) | (F.col("single") & (long | (F.col("n") == 2)))).filter(long | ~F.col("settled")), "grown")
    window = scratch.save(_settled(slim, spans.filter("not settled"), span_words, scratch), "settled")
    whole = window.groupBy("row", "island").agg(F.min("at").alias("w0"), (F.max("at") + span_words).alias("w1"), F.min("wfirst").alias("wfirst"))
    spans = spans.join(whole, ["row", "island"], "left").filter("settled or w0 is not null")
    # an unsettled passage reaches to its outermost stretch that occurs again
    bound = lambda grown, far, both: F.when(F.col("settled"), F.col(grown)).otherwise(both(far, F.col(grown)))
    spans = scratch.save(spans.select("row", "island", "first", "end", "start", "stop", "p0", "p1", F.least("lead", "wfirst").alias("lead"),
        bound("start", F.col("w0"), F.least).alias("from"), bound("stop", F.col("w1"), F.greatest).alias("to")), "passages")
    parts = _islands(at.filter("not is_first").select("row", F.col("island").alias("passage"), "first", "end"), "row", "passage")
    parts = parts.groupBy("row", F.col("passage").alias("island"), F.col("island").alias("part")).agg(F.min("first").alias("a"), F.max("end").alias("z"))
    parts = parts.join(spans.select("row", "island", "first", "end", "start", "stop", "p0", "p1"), ["row", "island"])
    start = F.when((F.col("a") == F.col("first")) & ~F.col("p0.is_first"), F.col("start")).otherwise(F.col("a"))
    stop = F.when((F.col("z") == F.col("end")) & ~F.col("p1.is_first"), F.col("stop")).otherwise(F.col("z"))
    parts = parts.select("row", "island", start.alias("start"), stop.alias("stop"))
    late = window.filter("again").select("row", F.col("island").alias("passage"), F.col("at").alias("first"), (F.col("at") + span_words).alias("end"))
    late = _islands(late, "row", "passage").groupBy("row", F.col("passage").alias("island"), F.col("island").alias("part")).agg(F.min("first").alias("start"), F.max("end").alias("stop"))
    cuts = parts.union(late.drop("part")).groupBy("row", "island").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    own = spans.join(cuts, ["row", "island"], "left").join(lead.select("row", "keeper"), "row")
    own = own.select("row", F.col("keeper").alias("doc_id"), F.col("from").alias("start"), F.col("to").alias("stop"), F.when(F.col("lead") != LAST, F.col("lead")).alias("first_doc_id"), F.coalesce("cuts", none).alias("cuts"))
    copies = ids.join(lead.filter((F.col("docs") > 1) & (F.col("n") >= span_words)).select("row", "keeper"), "row")
    whole = F.when(F.col("doc_id").eqNullSafe(F.col("keeper")), none).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("stop"))))
    return own.union(copies.select("row", "doc_id", F.lit(0), F.col("n"), "keeper", whole))


def shared_passages(docs: DataFrame, scratch: Scratch, span_words: int = SPAN_WORDS) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id): passages of span_words words or more of a document that occur again, there or elsewhere.

    start and n_words count words; overlapping repeats of a text are one passage, and first_doc_id is the smallest id of
    a document that holds an earlier or the first copy of part of it. A document without an id has rows with a null doc_id.
    Nulls, ties and repeated rows are as ``repeats`` says.
    """
    found = repeats(docs, scratch, span_words)
    spans = _islands(found.select("row", "doc_id", F.col("start").alias("first"), F.col("stop").alias("end"), "first_doc_id"), "row", "doc_id")
    out = spans.groupBy("row", "doc_id", "island").agg(F.min("first").alias("start"), F.max("end").alias("stop"), F.min("first_doc_id").alias("first_doc_id"))
    return out.select("doc_id", "start", (F.col("stop") - F.col("start")).alias("n_words"), "first_doc_id")


def remove_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without what ``repeats`` found to stand in earlier places, part by part.

    Each cut word stands in an earlier place as well, so the earliest copy of every word stays. A cut text keeps its other
    words, joined by single spaces; other texts, rows and columns are unchanged. Rows equal in id and text are one document.
    """
    cut_at = found.filter("size(cuts) > 0").groupBy("row", F.col("doc_id").alias("id")).agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "text", _row().alias("own"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists("cuts", lambda c: (i >= c["start"]) & (i < c["stop"])))
    joined = whole.join(cut_at, (F.col("own") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    joined = joined.select("doc", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, " ")).alias("text"))
    return joined.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
