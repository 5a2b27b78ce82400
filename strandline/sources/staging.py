"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where that is unset and Spark runs in this process alone, as
    in tests, one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Steps:
    """The tables that a loop writes, each read again in place of its plan: lineage stays short, and a lost executor costs one step. They live as
    long as the application, as results are read lazily, unless they are dropped before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path, files = self._at("")
        files.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def __call__(self, df: DataFrame, name: str = "step") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes what was written so far."""
        path, files = self._at("")
        files.delete(path, True)
