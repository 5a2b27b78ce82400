"""What views of a graph show: edges with their ends, a node's surroundings, orders with missing values, units of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import neighbour_rows
from strandline.operators.ranges import places
from strandline.sources.staging import Steps


def limited(rows: DataFrame, order: list[Column], most: int | None = None) -> DataFrame:
    """rows in order, the first ``most`` if that is given."""
    rows = rows.orderBy(*order)
    return rows if most is None else rows.limit(most)


def edge_view(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """source, source_type, relationship, target, target_type: edges with the names and labels of both ends, in order, the first ``most`` if that is given.
    Edges without one of their ends are left out."""
    end = lambda key, *names: nodes.select(F.col("id").alias(key), F.col("name").alias(names[0]), F.col("label").alias(names[1]))
    rows = edges.join(end("src", "source", "source_type"), "src").join(end("dst", "target", "target_type"), "dst")
    rows = rows.select("source", "source_type", F.col("rel").alias("relationship"), "target", "target_type")
    return rows if most is None else limited(rows, [F.col(c) for c in rows.columns], most)


def surroundings(edges: DataFrame, ids: DataFrame, most: int = 20) -> DataFrame:
    """id, src, rel, dst: for each of ids (id) the first edges that touch it, by relation, start and end, in the direction that they have; a loop counts once."""
    touching = edges.select(F.col("src").alias("id"), "src", "rel", "dst").union(edges.where("src <> dst").select(F.col("dst").alias("id"), "src", "rel", "dst"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("rel", "src", "dst"))
    return touching.join(ids.select("id").distinct(), "id", "left_semi").withColumn("place", place).where(F.col("place") <= most).drop("place")


def around(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, other, side of what leads to the chosen nodes (id), prerequisite, and of what they lead to, dependent; each once."""
    rows = neighbour_rows(edges).join(chosen.select("id").distinct(), "id", "left_semi")
    return rows.select("id", "other", F.when(F.col("way") == "in", "prerequisite").otherwise("dependent").alias("side")).distinct()


def node_order(rows: DataFrame, groups: list[str], most: int | None = None) -> DataFrame:
    """rows (name, degree, id) with place within their group: high degrees first and missing ones before all, then names; the first ``most`` if that is given."""
    placed = places(rows, groups, [F.col("degree").desc_nulls_first(), F.col("name"), F.col("id")], Steps(rows.sparkSession, "order"), "places").withColumnRenamed("_place", "place").drop("_count")
    return placed if most is None else placed.where(F.col("place") <= most)


# Fixed value: the label that all nodes share.
COMMON = "KGNode"


def with_common_label(nodes: DataFrame, common: str = COMMON) -> DataFrame:
    """nodes with labels, their own and the common one, and type, their own; one without label has the common one only."""
    return nodes.withColumns({"labels": F.array_distinct(F.array_compact(F.array(F.col("label"), F.lit(common)))), "type": F.col("label")})


def projected(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """src, dst of edges without direction, each in both, those of the given relations or of all. Parallel edges stay; a loop stands once."""
    rows = edges if relations is None else edges.where(F.col("rel").isin(*relations))
    return rows.select("src", "dst").unionAll(rows.where("src <> dst").select("dst", "src"))


def source_keys(source: Column) -> dict[str, Column]:
    """How a source file may be named: as it is, by its base name, with slashes turned."""
    return {"whole": source, "base": F.regexp_extract(source, r"([^/]*)/*$", 1), "turned": F.replace(source, F.lit("\\"), F.lit("/"))}


def unit_lookup(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """files (file) with unit by a mapping (source, unit, ord): a file is looked up as it is, then by its base name, then with slashes turned.

    Each source of the mapping can be named in all three ways; where several can, the last by ord counts. A file that none names has no unit.
    """
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("way"), k.alias("key")) for i, k in enumerate(source_keys(F.col("source")).values()))))
    keys = mapping.select("unit", "ord", named.alias("k")).groupBy("k.key").agg(F.max_by("unit", F.struct("ord", "k.way")).alias("unit"))
    rows = files.withColumns({f"_{n}": k for n, k in source_keys(F.col("file")).items()})
    for n in ("whole", "base", "turned"):
        rows = rows.join(keys.select(F.col("key").alias(f"_{n}"), F.nullif("unit", F.lit("")).alias(f"_unit_{n}")), f"_{n}", "left")
    return rows.select(*files.columns, F.coalesce("_unit_whole", "_unit_base", "_unit_turned").alias("unit"))


def hints(texts: DataFrame, text: str, order: str, some: str, none: str, most: int | None = 30) -> DataFrame:
    """Texts in which the pattern ``some`` occurs and ``none`` doesn't, in any case; the first ``most`` in order."""
    low = F.lower(text)
    rows = texts.where(F.rlike(low, F.lit(some)) & ~F.rlike(low, F.lit(none)))
    return rows if most is None else limited(rows, [F.col(order)], most)


def best_threshold(rows: DataFrame) -> DataFrame:
    """Of rows (threshold, cross_rate, reduction, modularity) the one to go on with: without merges across types, if there is one without, then the largest reduction,
    then the highest modularity, a missing one counting as 0, then the smallest threshold. One row per threshold."""
    clean = rows.agg(F.min("cross_rate").alias("_least"))  # one row
    judged = rows.join(clean, how="cross").where("_least > 0 OR cross_rate = 0").drop("_least")
    return judged.orderBy(F.desc("reduction"), F.desc(F.coalesce("modularity", F.lit(0.0))), "threshold").limit(1)


def merge_statistics(merged: DataFrame, types: DataFrame, links: DataFrame, into: DataFrame) -> DataFrame:
    """What a merge did, in one row. merged: id_a, id_b, outcome; types: id, type; links: src, dst before; into: id, into.

    pairs, merged, not_found, cross_rate (the share of merges across types), edges_before, edges_after (distinct, after ends have moved), self_loops, and
    preserved, edges_after without loops over edges_before.
    """
    a, b = types.toDF("id_a", "type_a"), types.toDF("id_b", "type_b")
    done = F.col("outcome") == "merged"
    cross = F.count_if(done & ~F.col("type_a").eqNullSafe(F.col("type_b"))) / F.nullif(F.count_if(done), F.lit(0))
    counts = merged.join(a, "id_a", "left").join(b, "id_b", "left").agg(F.count("*").alias("pairs"), F.count_if(done).alias("merged"), F.count_if(~done).alias("not_found"), F.round(F.coalesce(cross, F.lit(0.0)), 4).alias("cross_rate"))
    s, d = into.toDF("src", "to_s"), into.toDF("dst", "to_d")
    after = links.join(s, "src", "left").join(d, "dst", "left").select(F.coalesce("to_s", "src").alias("s"), F.coalesce("to_d", "dst").alias("d")).distinct()
    loops = after.agg(F.count("*").alias("edges_after"), F.count_if(F.col("s") == F.col("d")).alias("self_loops"))
    rows = counts.join(links.agg(F.count("*").alias("edges_before")), how="cross").join(loops, how="cross")  # one row each
    return rows.withColumn("preserved", F.round((F.col("edges_after") - F.col("self_loops")) / F.col("edges_before"), 4))
