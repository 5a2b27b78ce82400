"""Betweenness and closeness by joins: breadth-first searches from many sources at once, a level per step, and shares of paths summed on the way back.

A row is (source, node, paths): how many shortest paths lead there. A level is joined with the arcs, what was reached before is taken away, and paths
are summed. On the way back each arc that a search took hands its share of the node behind it to the node before. So work is spread by
(source, node), whatever the size of a community; sources go in batches, which bounds what is on disk at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.graph import with_communities
from strandline.operators.ranges import places
from strandline.sources.staging import Steps

SOURCES = 1 << 17  # of a batch


def _searched(sources: DataFrame, arcs: DataFrame, steps: Steps) -> DataFrame:
    """n, between, reach, far of what sources (n) reach over arcs (a, b): shares of paths through n, how many sources reach it, the sum of their distances."""
    levels, taken = [steps(sources.select(F.col("n").alias("s"), F.col("n").alias("v"), F.lit(1.0).alias("paths")), "level")], []
    while True:
        ahead = levels[-1].join(arcs, F.col("v") == F.col("a")).select("s", "v", F.col("b").alias("w"), "paths")
        known = reduce(DataFrame.unionByName, [x.select("s", F.col("v").alias("w")) for x in levels])
        link = steps(ahead.join(known, ["s", "w"], "left_anti"), "taken")
        if link.isEmpty():
            break
        taken.append(link)
        levels.append(steps(link.groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths")), "level"))
    found = [x.groupBy(F.col("v").alias("n")).agg(F.count("*").alias("reach"), F.lit(d).alias("d")).select("n", F.lit(0.0).alias("between"), "reach", (F.col("reach") * d).alias("far")) for d, x in enumerate(levels) if d]
    share = None
    for d in range(len(levels) - 1, 1, -1):
        level = levels[d].select("s", F.col("v").alias("w"), F.col("paths").alias("all_paths"))
        level = level.withColumn("share", F.lit(0.0)) if share is None else level.join(share.toDF("s", "w", "share"), ["s", "w"], "left").fillna(0.0, ["share"])
        part = F.col("paths") / F.col("all_paths") * (1 + F.col("share"))
        share = steps(taken[d - 1].join(level, ["s", "w"]).groupBy("s", "v").agg(F.sum(part).alias("share")), "share")
        found.append(share.groupBy(F.col("v").alias("n")).agg(F.sum("share").alias("between")).select("n", "between", F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("far")))
    if not found:
        return sources.limit(0).select("n", F.lit(0.0).alias("between"), F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("far"))
    return reduce(DataFrame.unionByName, found)


def centrality(edges: DataFrame, nodes: DataFrame, least: int = 10, sources: int = SOURCES) -> DataFrame:
    """community, id, degree, betweenness, closeness within communities of at least ``least`` nodes.

    Edges are directed, parallel ones count once. Betweenness is not normalised, to nine digits; closeness of a node is the number of nodes that reach it
    over the sum of their distances, 0 if there are none. There are as many steps as the longest of the shortest paths has edges.
    """
    steps = Steps(edges.sparkSession, "centrality")
    big = nodes.groupBy("community").count().where(F.col("count") >= least).select("community")
    members = steps(nodes.join(big, "community", "left_semi").select("community", "id").withColumn("n", F.monotonically_increasing_id()), "members")
    inside = with_communities(edges, nodes.join(big, "community", "left_semi")).where("src_cid = dst_cid").select("src", "dst").distinct()
    a, b = members.select(F.col("id").alias("src"), F.col("n").alias("a")), members.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    arcs = steps(inside.join(a, "src").join(b, "dst").select("a", "b"), "arcs")
    ways = arcs.where("a <> b")
    batches = max(1, -(-members.count() // sources))
    found = []
    for i in range(batches):
        own = Steps(edges.sparkSession, "searches")
        batch = members.where(F.pmod(F.xxhash64("n"), F.lit(batches)) == i)
        rows = _searched(batch, ways, own).groupBy("n").agg(*(F.sum(c).alias(c) for c in ("between", "reach", "far")))
        found.append(steps(rows, "found"))
        own.drop()
    sums = reduce(DataFrame.unionByName, found).groupBy("n").agg(*(F.sum(c).alias(c) for c in ("between", "reach", "far")))
    degree = arcs.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("degree"))
    rows = members.join(degree, "n", "left").join(sums, "n", "left")
    closeness = F.when(F.col("far") > 0, F.col("reach") / F.col("far")).otherwise(0.0)
    return rows.select("community", "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce(F.round("between", 9), F.lit(0.0)).alias("betweenness"), closeness.alias("closeness"))


def ranked(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """rows (id, community, metrics) with rank_<metric> within the community: high scores first, then ids."""
    steps = Steps(rows.sparkSession, "ranks")
    rows = steps(rows, "rows")
    for m in metrics:
        rows = places(rows, ["community"], [F.desc(m), F.col("id")], steps, m).withColumnRenamed("_place", f"rank_{m}").drop("_count")
    return rows
