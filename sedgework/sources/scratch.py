"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a round's result as Parquet and reading it
again: the files are compressed and columnar, their sizes let adaptive execution choose a
broadcast or a shuffle for the next round, and they survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of our own, which is set there, if all runs on this machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sedgework-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Named tables of one run of an operator, kept until replaced, dropped or the end of the session."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sedgework-{label}-{uuid.uuid4().hex[:12]}"
        self._serial = 0
        self._at: dict[str, str] = {}
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return what reads it back; the former table of that name is dropped after the write."""
        self._serial += 1
        path = f"{self.root}/{name}-{self._serial}"
        df.write.parquet(path)
        old, self._at[name] = self._at.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if path := self._at.pop(name, None):
            self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
