"""The accept-or-reject funnel over triples (name, type of subject and object, relation), and audits of its outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import ontology


def funnel(triples: DataFrame) -> DataFrame:
    """triples (s_name, s_type, rel, o_name, o_type, ...) with reject_reason, null where accepted.

    The checks come cheap first: components present, edge legal (the ontology is a hundred rows, sent to all tasks), row rules,
    then the group rule over all mentions of a name.
    """
    complete = F.col("s_name").isNotNull() & F.col("rel").isNotNull() & F.col("o_name").isNotNull() & (F.col("s_name") != "") & (F.col("o_name") != "")
    legal = F.broadcast(ontology.legal_edges(triples.sparkSession).withColumn("legal", F.lit(True)))
    rows = triples.join(legal, ["s_type", "rel", "o_type"], "left")
    mentions = triples.select(F.col("s_name").alias("name"), F.col("s_type").alias("type")).union(triples.select("o_name", "o_type"))
    faces = ontology.two_faced(mentions)
    for side in ("s", "o"):
        rows = rows.join(faces.select(F.col("name").alias(f"{side}_name"), F.lit(True).alias(f"{side}_faces")), f"{side}_name", "left")
    rule = ontology.broken_rule(F.col("s_type"), F.col("rel"), F.col("o_type"))
    reason = (
        F.when(~complete, "syntax")
        .when(F.col("legal").isNull(), F.concat(F.lit("edge: "), F.concat_ws(" -> ", "s_type", "rel", "o_type")))
        .when(rule.isNotNull(), F.concat(F.lit("rule "), rule.cast("string")))
        .when(F.col("s_faces") | F.col("o_faces"), "rule 1")
    )
    return rows.withColumn("reject_reason", reason).select(*triples.columns, "reject_reason")


def reasons(judged: DataFrame) -> DataFrame:
    """Number of triples per kind of rejection."""
    kind = F.coalesce(F.when(F.col("reject_reason").startswith("edge"), "edge").otherwise(F.col("reject_reason")), F.lit("accepted"))
    return judged.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def frequency(triples: DataFrame, column: Column) -> DataFrame:
    """How often a value occurs; a missing one counts as __MISSING__."""
    return triples.groupBy(F.coalesce(column, F.lit("__MISSING__")).alias("value")).agg(F.count("*").alias("n"))


def changes(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Records, those with an original, and for each field how many differ from ``original_<field>`` (null equals null)."""
    has = F.col("has_original")
    flags = [F.sum((has & ~F.col(f).eqNullSafe(F.col(f"original_{f}"))).cast("long")).alias(f"changed_{f}") for f in fields]
    return pairs.agg(F.count("*").alias("records"), F.sum(has.cast("long")).alias("with_original"), *flags)


def resume(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: work without a row of the same keys in done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def outcomes(records: DataFrame) -> DataFrame:
    """What standardisation did to records (has_original, response, and subject, object before as original_ and after): null responses had no such step.

    Names count as changed only where the step was taken; a missing one is empty.
    """
    has, taken = F.col("has_original"), F.col("has_original") & F.col("response").isNotNull()
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    renamed = lambda c: F.count_if(taken & (named(c) != named(f"original_{c}"))).alias(f"{c}_renamed")
    return records.agg(
        F.count("*").alias("total"), F.count_if(has).alias("with_original"), F.count_if(taken).alias("taken"), F.count_if(taken & (F.col("response") == "duplicate")).alias("duplicate"),
        F.count_if(taken & (F.col("response") != "duplicate")).alias("correct"), F.count_if(has & F.col("response").isNull()).alias("not_taken"), renamed("subject"), renamed("object"),
    )
