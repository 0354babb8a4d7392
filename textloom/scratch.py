"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local master; an error on a cluster,
    whose executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder.

    Tables that a lazy result still needs stay until ``close``, at the latest until the interpreter
    ends; loops drop those they have replaced at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_root(spark)}/textloom-{uuid.uuid4().hex}", {}
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        path, schema = self.path(name), df.schema
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def bytes_of(self, df: DataFrame) -> int:
        """Bytes on disk of a table saved here."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][0])
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, df: DataFrame) -> None:
        if found := self.paths.pop(id(df), None):
            self._delete(found[0])

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans up
            pass
        atexit.unregister(self.close)
