"""Session construction with the settings the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; existing sessions are reused.

    ``conf`` keys use ``__`` for dots. On a cluster leave ``master`` unset and let
    spark-submit decide it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        base["spark.driver.memory"] = os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g")
        base["spark.sql.shuffle.partitions"] = "8"
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
