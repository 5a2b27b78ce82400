"""Reading and writing triples, chunks, decisions and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import schemas


def read_triples(spark: SparkSession, path: str, schema: str = schemas.RAW_TRIPLE, pattern: str = "*.json") -> DataFrame:
    """Triples of all files below path, one array each, with _file. Files that don't parse, empty ones and records without relation give no row."""
    reader = spark.read.schema(f"{schema}, _corrupt STRING").options(multiLine=True, recursiveFileLookup=True, pathGlobFilter=pattern, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE")
    rows = reader.json(path).withColumn("_file", F.col("_metadata.file_path"))
    return rows.where("_corrupt IS NULL AND relation IS NOT NULL").drop("_corrupt")


def scan_triples(spark: SparkSession, path: str, schema: str = schemas.RAW_TRIPLE, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Triples of all files below path with _file and _index (from 1), which give their order, and faults: file, reason, index, a row for each file or record that gives none.

    Reasons of a file: empty (blanks, or an empty array), bad JSON, no array; of a record, with its index: no relation. A mark of byte order doesn't matter. Files of no byte at
    all are none to Spark's readers and have no row.
    """
    body = F.regexp_replace("text", "^\ufeff", "")
    rows = read_texts(spark, path, pattern).select("file", body.alias("text")).withColumn("v", F.try_parse_json("text"))
    records = F.from_json("text", "ARRAY<STRING>")  # each record as text, so that one of another form doesn't hide the others
    blank = F.trim(F.regexp_replace("text", r"\s", "")).isin("", "[]")
    array = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    rows = rows.withColumn("reason", F.when(blank, "empty").when(F.col("v").isNull(), "bad JSON").when(~array, "no array"))
    found = rows.where("reason IS NULL").select("file", F.posexplode(records).alias("_pos", "_record")).select("file", (F.col("_pos") + 1).alias("index"), F.from_json("_record", f"STRUCT<{schema}>").alias("t"))
    faults = rows.where("reason IS NOT NULL").select("file", "reason", F.lit(None).cast("int").alias("index"))
    faults = faults.unionByName(found.where("t.relation IS NULL").select("file", F.lit("no relation").alias("reason"), "index"))
    return found.where("t.relation IS NOT NULL").select("t.*", F.col("file").alias("_file"), F.col("index").alias("_index")), faults


def scan_counts(triples: DataFrame, faults: DataFrame) -> DataFrame:
    """outcome (accepted, or the reason of a fault), files, records of what scan_triples() returns; a fault of a whole file has no records."""
    good = triples.select(F.lit("accepted").alias("outcome"), F.col("_file").alias("file"), F.col("_index").alias("index"))
    every = good.unionByName(faults.withColumnRenamed("reason", "outcome"))
    return every.groupBy("outcome").agg(F.countDistinct("file").alias("files"), F.count("index").alias("records"))


def scan_documents(spark: SparkSession, path: str, pattern: str = "*.{pdf,json}") -> DataFrame:
    """path, length, modificationTime of all documents below path; their contents aren't read."""
    rows = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    return rows.select("path", "length", "modificationTime")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """file, text: each document below path as one text."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def append_new(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Appends the rows whose keys the table at path doesn't hold, and returns it: a store that a restarted job goes on with."""
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)
    rows.join(held.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def originals(validated: DataFrame) -> DataFrame:
    """The triple as it was before validation, where it is kept, else as it is; and whether it was kept."""
    has = F.col("original_raw_triple").isNotNull()
    pick = lambda f: F.coalesce(F.col(f"original_raw_triple.{f}"), F.col(f))
    name = lambda side: F.coalesce(F.col(f"original_raw_triple.{side}.name"), F.col(f"{side}.name"))
    kind = lambda side: F.coalesce(F.col(f"original_raw_triple.{side}.type"), F.col(f"{side}.type"))
    return validated.select(name("subject").alias("s_name"), kind("subject").alias("s_type"), pick("relation").alias("rel"), name("object").alias("o_name"), kind("object").alias("o_type"), has.alias("has_original"))


def chunk_windows(docs: DataFrame, id_col: str, text_col: str, size: int = 500, step: int = 450) -> DataFrame:
    """Overlapping windows of white-space tokens: id, chunk (from 1), n_tokens, text. A text without tokens has none."""
    tokens = F.filter(F.split(F.col(text_col), r"[ \t\n\x0B\f\r]+"), lambda t: t != "")
    rows = docs.select(F.col(id_col), tokens.alias("tokens")).where(F.size("tokens") > 0)
    starts = rows.select(id_col, "tokens", F.posexplode(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(step))).alias("pos", "start"))
    part = F.slice("tokens", F.col("start") + 1, F.lit(size))
    return starts.select(id_col, (F.col("pos") + 1).alias("chunk"), F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("text"))


def read_decisions(spark: SparkSession, path: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Decisions of all CSV files at path in the columns of MERGE_DECISION. With ``aliases`` the columns are found by name: the first of a column's names that the
    files have and that isn't empty counts; other columns are left out, missing ones are null. A mark of byte order before the header doesn't matter."""
    if aliases is None:
        return spark.read.csv(path, header=True, schema=schemas.MERGE_DECISION)
    rows = spark.read.csv(path, header=True)
    given = {c.lstrip("\ufeff"): F.col(f"`{c}`") for c in rows.columns}
    fields = [f.strip().split(" ") for f in schemas.MERGE_DECISION.split(",")]
    first = lambda name: F.coalesce(F.lit(None), *(F.nullif(F.trim(given[a]), F.lit("")) for a in (name, *aliases.get(name, [])) if a in given))
    return rows.select(*(first(name).try_cast(kind.lower()).alias(name) for name, kind in fields))


def write_csv(rows: DataFrame, path: str, mark: bool = False) -> None:
    """With header; missing values are empty. With ``mark`` a mark of byte order, which spreadsheets look for, stands before the header of each file."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(("\ufeff" if mark and i == 0 else "") + c) for i, c in enumerate(rows.columns)]
    rows.select(*texts).write.mode("overwrite").csv(path, header=True)


def backup(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Writes a graph as two tables and a manifest of counts, which it returns."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    manifest = spark.createDataFrame([(spark.read.parquet(f"{path}/nodes").count(), spark.read.parquet(f"{path}/edges").count())], "node_count LONG, rel_count LONG")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes by key and edges by (src, rel, dst); parallel edges of one type become one."""
    return spark.read.parquet(f"{path}/nodes").dropDuplicates(["id"]), spark.read.parquet(f"{path}/edges").dropDuplicates(["src", "rel", "dst"])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Declared and actual counts of a backup, and nodes without name or label."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    bad = F.sum((F.col("name").isNull() | F.col("label").isNull()).cast("long"))
    found = nodes.agg(F.count("*").alias("nodes"), F.coalesce(bad, F.lit(0)).alias("unnamed")).join(edges.agg(F.count("*").alias("edges")), how="cross")  # one row each
    return spark.read.schema("node_count LONG, rel_count LONG").json(f"{path}/manifest").join(found, how="cross")


def histograms(spark: SparkSession, path: str) -> DataFrame:
    """kind (label or relation), value, n of a backup's nodes and edges."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    count = lambda rows, kind, c: rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return count(nodes, "label", "label").unionByName(count(edges, "relation", "rel"))


def first_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
