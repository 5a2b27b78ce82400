"""Merkle manifest of a dataset: one root that changes with any field of any row, and a proof per row.

A row's leaf is the SHA-256 of its fields. The leaves of a group, in the order of their ids, are cut into blocks of 2 ** LEVELS; a block is
one row with an ordered array, which sequence, transform, slice and aggregate collapse level by level. The blocks' roots are the next
tier's nodes, until a group has one block; the groups' roots then climb the same way to the root. So a tier's shuffle is a
2 ** LEVELS th of the one below, no task sees more than a block of any group, and the proofs come back down by one join per tier.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace
from strandline.operators.ranges import Stage, places, running

LEVELS = 8  # of the tree in a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A list of nodes to the level above: every 2 in order, the last run may be of one.
COLLAPSED = "transform(sequence(1, size({0}), 2), at -> sha2(array_join(slice({0}, at, 2), ''), 256))"
#: All levels of a block, its nodes first.
CLIMB = f"aggregate(array_repeat(0, _depth), array(transform(_nodes, x -> x._node)), (done, _) -> concat(done, array({COLLAPSED.format('element_at(done, -1)')})))"
#: From a node's place in its block (x._at) up: its sibling, null where there is none, and whether the node itself is the right one.
STEPS = "transform(array_repeat(0, _depth), (_, up) -> named_struct('sibling', get(get(_levels, up), shiftright(cast(x._at & {0} as int), up) ^ 1), 'right', (shiftright(cast(x._at & {0} as int), up) & 1) = 1))"
PATH = "array<struct<sibling: string, right: boolean>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: ``-`` for each null field, else its length in UTF-8 bytes, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(path: Column, node: Column) -> Column:
    """The root that a leaf gives with its path."""
    return F.aggregate(path, node, lambda now, s: F.sha2(F.when(s["right"], F.concat(s["sibling"], now)).otherwise(F.concat(now, F.coalesce(s["sibling"], F.lit("")))), 256))


@dataclass
class Tree:
    """tiers: blocks (_group, _block, _nodes, _depth, _levels), the lowest first; tops: _group, _node, one row per group."""

    tiers: list[DataFrame]
    tops: DataFrame


def climb(nodes: DataFrame, work: Workspace, name: str, carry: tuple[str, ...] = (), levels: int = LEVELS) -> Tree:
    """nodes: _group, _at (from 0 in the group), _count (of the group), _node, and what the lowest tier carries."""
    tiers = []
    height = F.when(F.col("_count") > 1, F.length(F.bin(F.col("_count") - 1))).otherwise(0)  # of the group's tree: log2, rounded up
    left = nodes.agg(F.max(height)).first()[0] or 0
    while True:
        done = levels * len(tiers)
        own = nodes.groupBy("_group", F.shiftright("_at", levels).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_at", "_node", *carry))).alias("_nodes"), F.max("_whole" if tiers else "_count").alias("_whole"))
        height = F.when(F.col("_whole") > 1, F.length(F.bin(F.col("_whole") - 1))).otherwise(0)
        own = own.withColumn("_depth", F.least(F.lit(levels), F.greatest(F.lit(0), height - done)).cast("int")).withColumn("_levels", F.expr(CLIMB))
        tiers.append(work.stage(own, f"{name}-{len(tiers)}"))
        nodes, carry = tiers[-1].select("_group", F.col("_block").alias("_at"), "_whole", F.expr("element_at(_levels, -1)[0]").alias("_node")), ()
        left -= levels
        if left <= 0:
            return Tree(tiers, nodes.select("_group", "_node"))


def descend(tree: Tree, above: DataFrame, carry: tuple[str, ...] = (), levels: int = LEVELS) -> DataFrame:
    """The lowest tier's nodes (_group, _node, carry) with _path to the root, and _of; above: a row per group, with _group, the _path of its top and _of."""
    upper = above.select("_group", F.lit(0).cast("long").alias("_at"), F.col("_path").alias("_up"), "_of")
    for i, tier in reversed(list(enumerate(tree.tiers))):
        both = tier.alias("t").join(upper.alias("u"), F.col("t._group").eqNullSafe(F.col("u._group")) & (F.col("_block") == F.col("_at")))
        steps = F.expr(f"transform(_nodes, x -> struct(x, concat({STEPS.format((1 << levels) - 1)}, _up) as path))")
        rows = both.select("t._group", "_of", F.explode(steps).alias("_x"))
        upper = rows.select("_group", "_x.x._at", F.col("_x.path").alias("_up"), "_of", *(f"_x.x.{c}" for c in (("_node", *carry) if i == 0 else ())))
    return upper.withColumnRenamed("_up", "_path")


def in_order(leaves: DataFrame, stage: Stage) -> DataFrame:
    """leaves (_group, _id, _node, _row) with _at, the place in the group by (_id, _node), nulls first, and _count, the group's leaves. Ranges split a large
    group, and equal rows, wherever they are many."""
    placed = places(leaves, ["_group"], [F.col("_id").asc_nulls_first(), F.col("_node"), F.col("_row")], stage, "order")
    return placed.withColumn("_at", F.col("_place") - 1)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", told: Column | None = None) -> DataFrame:
    """A row per row of docs: id_col, leaf, subroot (of its group), root, path (sibling, right; from the leaf up), and told.

    ``told`` is a digest over the columns of docs that someone claims for a row, by default its leaf; folded(path, told) equals root if
    it is true. Groups are ordered by their text, null first, which is a group of its own. Null ids come first; rows with one id stand by
    their leaves, and equal rows next to each other, each a leaf. A group of one leaf has that as its subroot, and one group's subroot is the
    root. Empty texts and null fields have different leaves. Other columns of docs don't matter. An empty table gives no row.
    """
    work = Workspace(docs.sparkSession, "merkle")
    own = docs.withColumn("__leaf", leaf([F.col(f"`{c}`") for c in fields]))
    own = own.select(F.col(f"`{group_col}`").cast("string").alias("_group"), F.col(f"`{id_col}`").alias("_id"), F.col("__leaf").alias("_node"), (F.col("__leaf") if told is None else F.coalesce(told, F.col("__leaf"))).alias("_told"))
    leaves = work.stage(own.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    carry = ("_id", "_told")
    tree = climb(in_order(leaves, work.stage), work, "rows", carry)
    tops = running(tree.tops, [F.col("_group").asc_nulls_first()], [], work.stage, "tops")
    tops = tops.join(tops.agg(F.count("*").alias("_count")), how="cross")  # one row
    tops = tops.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), (F.col("_rank") - 1).alias("_at"), "_count", "_node")
    crown = climb(tops, work, "groups", ("_name",))
    root = crown.tops.select("_group", F.col("_node").alias("root"))
    top = root.select("_group", F.array().cast(PATH).alias("_path"), F.col("root").alias("_of"))
    above = descend(crown, top, ("_name",)).select(F.col("_name").alias("_group"), "_path", F.struct(F.col("_node").alias("subroot"), F.col("_of").alias("root")).alias("_of"))
    rows = descend(tree, work.stage(above, "above"), carry)
    return rows.select(F.col("_id").alias(id_col), F.col("_node").alias("leaf"), "_of.subroot", "_of.root", F.col("_path").alias("path"), F.col("_told").alias("told"))
