"""Time headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the input and the cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from textloom.operators import kv  # noqa: E402
from textloom.queries import QUERIES, engine  # noqa: E402
from textloom.scratch import Scratch  # noqa: E402
from textloom.session import get_session  # noqa: E402

#: index_build tokenizes the whole corpus and writes every table; searches after it read a saved index, which the
#: first of them builds (outside its time, as the engine would have it on disk).
HEADLINE = (
    "index_build", "tokenize_tf", "postings_positions", "bool_and", "bool_nested", "phrase_three", "wildcard_middle", "prefix_docs", "date_and_term", "champions_r32", "tiers_16_64",
    "ranked_exact", "ranked_inexact", "kv_get_latest", "kv_range_scan", "kv_compact", "bench_percentiles",
)
#: The key-value workload of the harness: inserts, point reads (half of them misses), short scans.
KEYS, READS, SCANS, LIMIT = 200_000, 200_000, 50_000, 64


def key_values(spark: SparkSession) -> dict[str, float]:
    """Seconds of a bulk insert, of a batch of point reads and of a batch of short scans on one store."""
    key = lambda c: F.substring(F.conv(F.substring(F.sha1(c.cast("string")), 1, 15), 16, 36), 1, 16)
    rows = spark.range(KEYS).select(F.lower(key(F.col("id"))).alias("key"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("value"), F.lit(False).alias("is_delete")).dropDuplicates(["key"])
    store = kv.Store(spark, Scratch(spark).path("bench"))
    asked = spark.range(READS).select(F.lower(key(F.when(F.col("id") % 2 == 0, F.col("id") % KEYS).otherwise(F.col("id") + KEYS))).alias("key"))
    ranges = spark.range(SCANS).select(F.lower(key(F.col("id") * 3 % KEYS)).alias("low")).withColumn("high", F.concat("low", F.lit("~~~~")))
    out = {}
    for name, run in (
        ("kv_bench_insert", lambda: store.append(rows)),
        ("kv_bench_reads", lambda: kv.get_many(store.log(), asked.distinct()).write.format("noop").mode("overwrite").save()),
        ("kv_bench_scans", lambda: kv.scan_many(store.log(), ranges.distinct(), LIMIT).write.format("noop").mode("overwrite").save()),
    ):
        began = time.time()
        run()
        out[name] = round(time.time() - began, 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the JVM's compilers
    times = {}
    for name in HEADLINE:
        if times:
            engine(spark, folder)
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    times |= key_values(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
