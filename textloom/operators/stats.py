"""Nearest-rank percentiles of the benchmark harness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, FEW = 1024, 20_000


def _value_at(rows: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of a rank among numbers within [low, high], by histograms of the interval that holds it.

    A histogram is one aggregation of at most BUCKETS rows. Once few rows are left, their distinct values
    are counted exactly. An interval that no longer shrinks is one value.
    """
    value = F.col("v")
    while low < high:
        width = (high - low) / BUCKETS
        at = F.least(F.floor((value - low) / width), F.lit(BUCKETS - 1)).cast("int")
        held = {r["b"]: r for r in rows.filter(value.between(low, high)).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("l"), F.max("v").alias("h")).collect()}
        for b in sorted(held):
            if rank < held[b]["n"]:
                break
            rank -= held[b]["n"]
        low, high, n = held[b]["l"], held[b]["h"], held[b]["n"]
        if n <= FEW:
            for r in rows.filter(value.between(low, high)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect():
                if rank < r["n"]:
                    return r["v"]
                rank -= r["n"]
    return low


def percentiles(df: DataFrame, column: str, points: tuple[float, ...] = (50, 95, 99)) -> DataFrame:
    """(p, value): the element at index int(p/100 * (n-1)) of the sorted non-null numbers.

    The count fixes the ranks; each is located by refining histograms, so nothing is sorted and no task or
    driver holds more than a histogram or FEW values. NaN is left out like null.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "p double, value double")
    return df.sparkSession.createDataFrame([(float(p), float(_value_at(rows, int(p / 100 * (n - 1)), low, high))) for p in points], "p double, value double")
