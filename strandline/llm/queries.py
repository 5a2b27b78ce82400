"""The registered query of each operator: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import credential_links, deobfuscate, lattice_lm, line_rules, merkle, oracles, packing, phrase_index, pii_labels, simhash_gray, source_mix, spelling, token_shards, zstd_quality
from strandline.llm.common import bounded_batches, documents, held_out


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    train = ~held_out(F.col("doc_id"), 10)
    return lattice_lm.scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), train)


def op2_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = deobfuscate.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id"), 5))
    rows = deobfuscate.scored(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = line_rules.judged(documents(spark, sf_dir).select("doc_id", "text"), out="r").select("doc_id", "r.*")
    return rows.drop("cleaned")


def op4_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrase_index.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def counted(rows: DataFrame) -> DataFrame:
    """rows with n_spans, how many spans the column spans names."""
    return rows.withColumn("n_spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long"))


def op5_pii_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(pii_labels.personal_data(documents(spark, sf_dir)))


def op6_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5))
    rows = zstd_quality.scored(docs, zstd_quality.fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference", "rich_score")


def op7_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(credential_links.secrets(documents(spark, sf_dir)))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_mix.mixed(documents(spark, sf_dir), carry=["doc_id"])
    return rows.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_gray.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards.encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    placed, _ = packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return placed.drop("_row", "cut")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    altered = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, 1)  # null elsewhere
    told = F.when(altered.isNotNull(), merkle.leaf([altered if c == "n_chars" else F.col(c) for c in merkle.FIELDS]))
    rows = merkle.manifest(docs, told=told).withColumn("folded_root", merkle.folded(F.col("path"), F.col("told")))
    proof = F.sha2(F.array_join("path.sibling", ""), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_lm, op2_deobfuscate, op3_line_rules, op4_phrase_index, op5_pii_labels, op6_zstd_quality, op7_credential_links, op8_source_mix, op9_simhash_gray, op10_token_shards, op11_packing, op12_spelling_variants, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    """SQL has no lattices, Viterbi search, SimHash, zstandard, tokenizers or look-behind; tests/llm holds the other queries against brute force."""
    return {"op3_line_rules": oracles.OP3, "op4_phrase_index": oracles.OP4, "op12_spelling_variants": oracles.OP12, "op13_merkle_manifest": oracles.OP13}
