"""Intermediate tables in the folder that executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may do without that setting: it gets a
    temporary folder, which the executors of a cluster would not share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Tables:
    """Tables of one call, written once and read any number of times; they live until the driver ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/folioscope/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        """Write ``df`` as Parquet and return a reader over it; this cuts the lineage."""
        df.write.mode(mode).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def has(self, name: str) -> bool:
        return self._files().exists(self._at(name))

    def remove(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self._files().delete(self._at(name), True)

    def _at(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)

    def _files(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self) -> None:
        self._files().delete(self._at(), True)

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended already
            self.drop()
