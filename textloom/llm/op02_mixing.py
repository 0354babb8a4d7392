"""Mixing sources to target weights by hash-threshold histograms.

A row's hash decides when it is taken: a source's budget is a threshold on the hash, so the mix is
a filter and a larger budget always contains a smaller one. The threshold is found by a histogram of
sizes over (source, hash bucket); only the bucket that holds the boundary is refined, bucket by bucket,
down to single hash values. No document is sorted or ranked.

The hash is of the id, the text and a number that tells rows apart that are equal in id, source and
text, so a source of repeated or null ids is mixed as finely as any other. The tables of thresholds have
one row for each source; up to ``BROADCAST`` rows they are broadcast, beyond that joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, Scratch

HASH_BITS, STEP = 60, 12
WEIGHTS, BUDGET, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
#: Sources whose plan rows (some 50 bytes each) may be broadcast.
BROADCAST = 100_000


def size(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def text_key(doc_id: Column, text: Column) -> Column:
    """md5 of id and text as hex digits, which other engines can compute as well; null counts as empty."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def place(key: Column, number: Column) -> Column:
    """The 60-bit hash of a key and the row's number among equal ones."""
    hexes = F.substring(F.md5(F.concat(key, F.lit(":"), number.cast("string")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(hexes, 16, 10).cast("long")


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (source, key, ...) with ``number``: 0, 1, ... among rows of equal source and key.

    Rows that occur once, as a rule all, are not moved. Repeated ones are numbered within the tasks that
    hold them, and each task starts where those before it end, so a row that is a third of the table is
    numbered by many tasks.
    """
    group = F.xxhash64(F.lit("row"), "source", "key")
    rows = rows.withColumn("group", group)
    again = scratch.save(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group"), "again")
    if again.isEmpty():
        return rows.withColumn("number", F.lit(0).cast("long")).drop("group")
    once = rows.join(again, "group", "left_anti").withColumn("number", F.lit(0).cast("long"))
    more = scratch.save(rows.join(again, "group", "left_semi").withColumn("task", F.spark_partition_id()), "repeated")
    held = more.groupBy("group", "task").agg(F.count(F.lit(1)).alias("n"))  # at most one row a task for each group
    before = held.select("group", "task", (F.sum("n").over(Window.partitionBy("group").orderBy("task")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("group", "task").orderBy("key"))
    more = more.withColumn("inside", inside).join(before, ["group", "task"]).withColumn("number", F.col("before") + F.col("inside") - 1)
    return once.unionByName(more.drop("task", "inside", "before")).drop("group")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> dict[str | None, float]:
    """Words wanted of each source: ``budget`` times all words shared by weight, no source above ``cap``
    times its size, excess reshared by weight among the rest.

    Sources are weighted in code point order, null last. A source is full from the level
    cap * size / weight on; filling sources in the order of that level finds the common one.
    """
    order = sorted((s for s in sizes if s[0] is not None), key=lambda s: s[0]) + [s for s in sizes if s[0] is None]
    rows = [(name, float(n), weights[i % len(weights)]) for i, (name, n) in enumerate(order)]
    left, weight, level = budget * sum(n for _, n, _ in rows), sum(w for *_, w in rows), 0.0
    for _, n, w in sorted(rows, key=lambda r: cap * r[1] / r[2]):
        level = left / weight
        if cap * n / w > level:
            break
        left, weight = left - cap * n, weight - w
    else:
        level = float("inf")
    return {name: min(cap * n, w * level) if n else 0.0 for name, n, w in rows}


def _with(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """rows joined with a table of one row a source, null source included."""
    plan = rows.sparkSession.createDataFrame(table, schema)
    plan = F.broadcast(plan) if len(table) <= BROADCAST else plan
    return rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])


PLAN = "source string, source_size long, target double, whole int, bound long"


def plan(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> list[tuple]:
    """Rows of PLAN for a table (source, size, h): the driver sees one row a source and histogram round."""
    totals = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sizes = {r["source"]: r["n"] for r in totals}
    want = targets(list(sizes.items()), weights, budget, cap)
    whole = {s: int(want[s] // n) if n else 0 for s, n in sizes.items()}
    rest = {s: want[s] - whole[s] * n for s, n in sizes.items()}
    # every source starts with the whole hash range as its boundary bucket
    state = {s: (0, HASH_BITS, rest[s]) for s, n in sizes.items() if n and rest[s] > 0}
    done: dict = {s: 0 for s in sizes if s not in state}
    while state:
        inside = _with(slim.select("source", "size", "h"), [(s, *x) for s, x in state.items()], "source string, below long, width int, rest double")
        inside = inside.filter(F.expr("h >= below and h - below < shiftleft(1L, width)"))
        step = F.least(F.lit(STEP), F.col("width"))
        bucket = F.expr(f"shiftright(h - below, width - least({STEP}, width))")
        hist = inside.withColumn("step", step).withColumn("b", bucket).groupBy("source", "below", "width", "rest", "step", "b").agg(F.sum("size").alias("n"))
        w = Window.partitionBy("source").orderBy("b")  # at most 2^STEP rows each
        upto = hist.withColumn("upto", F.sum("n").over(w))
        edge = upto.groupBy("source").agg(
            F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("b", "n", "upto", "below", "width", "step", "rest"))).alias("e")
        )
        after = {}
        for r in edge.collect():
            s, e = r["source"], r["e"]
            if e is None:  # the rest is all there is, up to rounding
                done[s] = state[s][0] + (1 << state[s][1])
                continue
            width = e["width"] - e["step"]
            below, left = e["below"] + (e["b"] << width), e["rest"] - (e["upto"] - e["n"])
            if width == 0:
                done[s] = below + (1 if e["n"] - left < left else 0)
            else:
                after[s] = (below, width, left)
        state = after
    return [(s, int(n), float(want[s]), whole[s], int(done[s])) for s, n in sizes.items()]


def _slim(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, size, h) of every row, read from a table without texts."""
    rows = docs.select("doc_id", "source", size(F.col("text")).alias("size"), text_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = _numbered(scratch.save(rows, "sizes"), scratch)
    return scratch.save(rows.select("doc_id", "source", "size", place(F.col("key"), F.col("number")).alias("h")), "slim")


COPIES = "whole + CASE WHEN h < bound THEN 1 ELSE 0 END"


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """docs' (doc_id, source) with size, source_size, target, copies and taken = copies * size, a row for each row.

    A target of q whole source sizes and a rest takes every row q times and those below the rest's
    threshold once more; the boundary row is taken if that comes nearer to the target. Null texts and
    empty ones have size 0 and are taken as their hash says; null sources are a source of their own;
    repeated rows count each for itself, and which of equal ones is taken makes no difference.
    """
    slim = _slim(docs, scratch)
    out = _with(slim, plan(slim, weights, budget, cap), PLAN).withColumn("copies", F.expr(COPIES))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """The mix itself: each row of docs, all its columns, as often as it is taken.

    Texts are read again and filtered in place; only rows that are equal in id, source and text, if
    there are any, are shuffled.
    """
    table = plan(_slim(docs, scratch), weights, budget, cap)
    rows = docs.select(F.struct("*").alias("row"), "source", text_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = _numbered(rows, scratch).withColumn("h", place(F.col("key"), F.col("number")))
    taken = _with(rows, table, PLAN).filter(f"{COPIES} > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.expr(COPIES))).alias("copy")).select("row.*")
