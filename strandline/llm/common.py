"""Helpers that the text operators share: staging tables, row keys and word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is the session's setting; only where that is unset and Spark runs in this process alone, as in
    tests, a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation of what is before them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
        # Results are read lazily, so the tables live as long as the application.
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)

    def stage(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a staged table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 32) -> None:
    """Bounds what an Arrow batch holds, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text is divisible by folds. A null id is in no fold and counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int, bytes_per_class: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of texts with labels 0 or 1, in the order of a hash of the id, as (y, text, _upto), and the number of labelled ids by label.

    Of ids labelled twice the higher label counts. At most 2 * rows_per_class ids are drawn and sent to the scan of docs; of their texts
    those are kept whose bytes sum to at most bytes_per_class for a label. Texts of more than a 64th of that are no part of the sample,
    so that one long text doesn't take the place of all others.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    place = F.xxhash64(F.lit(seed), F.col("__id").cast("string"))
    drawn = [ids.where(F.col("y") == y).orderBy(place, "__id").limit(rows_per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn[0].union(drawn[1])), F.col("_id") == F.col("__id")).where(F.octet_length("text") <= bytes_per_class // 64)
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(place, "__id", "text").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_upto", upto).where(F.col("_upto") <= bytes_per_class).select("y", "text", "_upto"), totals
