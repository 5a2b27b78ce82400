"""Property graphs as two DataFrames: nodes (id, label, name, community) and edges (src, rel, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ranges import places
from strandline.sources.staging import Steps


# ---------------------------------------------------------------- folds of mentions


def _first(column: str, *tie: str) -> Column:
    """The column's first value that isn't null, by ord and then by the columns tie; mentions without ord don't count."""
    return F.min_by(column, F.when(F.col("ord").isNotNull() & F.col(column).isNotNull(), F.struct("ord", *tie)))


def fold_nodes(mentions: DataFrame, keys: list[str], tie: tuple[str, ...] = ()) -> DataFrame:
    """Mentions (keys, display, ord, source) folded to a node per key: the first display and source, and how many there are. Of mentions with one ord
    the first by the columns tie counts. No list is gathered, so that a hub's mentions are aggregated in part before the shuffle."""
    return mentions.groupBy(*keys).agg(
        _first("display", *tie).alias("display"), F.count("*").alias("n_mentions"), F.min("ord").alias("first_ord"), _first("source", *tie).alias("first_source"), F.count("source").alias("n_sources")
    )


def fold_sources(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """The sources of each node (keys, ord, source) in rows, each source as often as it is mentioned; sorted on reading by (keys, ord)."""
    return mentions.where(F.col("source").isNotNull()).select(*keys, "ord", "source")


def fold_nodes_by_name(mentions: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """A node per name alone: the first mention's label and display win, of mentions with one ord the first by the columns tie."""
    return mentions.groupBy("name").agg(_first("label", *tie).alias("label"), _first("display", *tie).alias("display"), F.count("*").alias("n_mentions"))


def fold_edges(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("src", "rel", "dst").agg(F.count("*").alias("n_mentions"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


# ---------------------------------------------------------------- counts


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"), F.countDistinct("label").alias("labels"))
    return n.join(edges.agg(F.count("*").alias("edges")), how="cross")  # one row each


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, relations, isolated nodes and their share, average degree 2E / N."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    alone = nodes.join(ends, "id", "left_anti").agg(F.count("*").alias("isolated"))
    counts = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("rels")), how="cross").join(alone, how="cross")  # one row each
    return counts.select("nodes", "rels", "isolated", F.round(F.col("isolated") / F.col("nodes"), 6).alias("isolated_ratio"), F.round(2 * F.col("rels") / F.col("nodes"), 4).alias("avg_degree"))


# ---------------------------------------------------------------- neighbourhoods and subgraphs


def neighbour_rows(edges: DataFrame) -> DataFrame:
    """id, rel, other, way: each node's undirected neighbours in rows, a self-loop once."""
    out = edges.select(F.col("src").alias("id"), "rel", F.col("dst").alias("other"), F.lit("out").alias("way"))
    return out.union(edges.where("src <> dst").select("dst", "rel", "src", F.lit("in")))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members (id)."""
    ids = members.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def ego(edges: DataFrame, centre: str) -> DataFrame:
    """The induced edges of a node and its direct neighbours."""
    near = edges.where((F.col("src") == centre) | (F.col("dst") == centre))
    ids = near.select(F.col("src").alias("id")).union(near.select("dst"))
    return induced(edges, ids)


def facets(nodes: DataFrame, edges: DataFrame, labels: list[str], relations: list[str]) -> DataFrame:
    """Edges of the chosen relations between nodes of the chosen labels; a node without label counts as 'Concept'."""
    return induced(edges.where(F.col("rel").isin(*relations)), nodes.where(F.coalesce("label", F.lit("Concept")).isin(*labels)))


def with_communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_cid and dst_cid; edges that come with them stay as they are."""
    if {"src_cid", "dst_cid"} <= set(edges.columns):
        return edges
    ids = nodes.select("id", "community")
    rows = edges.join(ids.toDF("src", "src_cid"), "src")
    return rows.join(ids.toDF("dst", "dst_cid"), "dst")


def cross_community(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = with_communities(edges, nodes).where("src_cid <> dst_cid")
    return rows.groupBy("src_cid", "dst_cid").agg(F.count("*").alias("n"))


def ccod_rank(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Communities by outgoing edges to others, those without any last: cid, size, ccod, rank."""
    sizes = nodes.where("community is not null").groupBy(F.col("community").alias("cid")).agg(F.count("*").alias("size"))
    out = cross_community(edges, nodes).groupBy(F.col("src_cid").alias("cid")).agg(F.sum("n").alias("ccod"))
    rows = sizes.join(out, "cid", "left").select("cid", "size", F.coalesce("ccod", F.lit(0)).alias("ccod"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ccod"), "cid")).cast("long"))


def intra_degree_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Out-degree within the community, zeros included, its rank by (degree, name) and its layer: 0 for the highest degree, equal for equal ones."""
    inside = with_communities(edges, nodes).where("src_cid = dst_cid").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    rows = nodes.where("community is not null").join(inside, "id", "left").select("id", "name", "community", F.coalesce("d", F.lit(0)).alias("degree"))
    steps = Steps(edges.sparkSession, "degrees")
    placed = places(rows, ["community"], [F.desc("degree"), F.col("name"), F.col("id")], steps, "places").withColumnRenamed("_place", "rank").drop("_count")
    # A community of E edges has at most about the root of 2 E different degrees.
    order = Window.partitionBy("community").orderBy(F.desc("degree"))
    layers = steps(placed, "placed").select("community", "degree").distinct().withColumn("layer", F.dense_rank().over(order) - 1)
    return placed.join(layers, ["community", "degree"]).select("id", "name", "community", "degree", "rank", "layer")


# ---------------------------------------------------------------- components, paths


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable without regard to direction. Large-star and small-star steps, each written."""
    steps = Steps(edges.sparkSession, "wcc")
    current = steps(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        current = steps(small.where("u <> v").distinct())
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return nodes.select("id").join(current.toDF("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def path_plan(edges: DataFrame, target: str | int, learned: list) -> DataFrame:
    """id, distance: what leads to target over edges backwards. Learned nodes are reached but not passed, except the target. Each step is a table of its own."""
    steps = Steps(edges.sparkSession, "plan")
    back = steps(edges.select("src", "dst").distinct(), "back")  # so that no step works the edges out again
    found = [steps(edges.sparkSession.createDataFrame([(target, 0)], f"id {back.schema['src'].dataType.simpleString()}, distance INT"), "target")]
    while True:
        front = found[-1]
        front = front.where(~F.col("id").isin(*learned) | (F.col("id") == target)) if learned else front
        seen = reduce(DataFrame.unionByName, found)
        more = back.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        more = steps(more.withColumn("distance", F.lit(len(found))), "more")
        if more.isEmpty():
            return seen
        found.append(more)


def learning_path(edges: DataFrame, layered: DataFrame, target: str, learned: list[str]) -> DataFrame:
    """id, layer, degree, distance, learned of what leads to target over edges between nodes with a layer (id, layer, degree); low layers, then high degrees first."""
    found = path_plan(induced(edges, layered.where("layer IS NOT NULL")), target, learned)
    known = F.col("id").isin(*learned) if learned else F.lit(False)
    rows = found.join(layered, "id").select("id", "layer", "degree", "distance", known.alias("learned"))
    return rows.orderBy(F.coalesce("layer", F.lit(0)), F.desc(F.coalesce("degree", F.lit(0))), "distance", "id")


def rewired(edges: DataFrame, into: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) after nodes (id, into) were merged: ends moved, self-loops dropped, equal ones one, with the number of edges that each stands for."""
    a, b = into.toDF("src", "to_a"), into.toDF("dst", "to_b")
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("to_a", "src").alias("src"), "rel", F.coalesce("to_b", "dst").alias("dst"))
    return moved.where("src <> dst").groupBy("src", "rel", "dst").agg(F.count("*").alias("n"))


def merged_sources(sources: DataFrame, into: DataFrame) -> DataFrame:
    """Provenance in rows (id, ord, source) after a merge: a merged node's sources follow those of the node it went into (own, then by ord)."""
    rows = sources.join(into, "id", "left")
    return rows.select(F.coalesce("into", "id").alias("id"), F.col("into").isNull().alias("own"), "ord", "source")


def united(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several graphs as one: nodes by id, edges by (src, rel, dst), each once."""
    nodes, edges = graphs[0]
    for n, e in graphs[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["src", "rel", "dst"])
