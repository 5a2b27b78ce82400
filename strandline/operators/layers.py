"""Layers of directed graphs by rounds of joins: cycles are found as strongly connected components, broken edge by edge, and what is left is peeled.

Each strongly connected component breaks its cycles on its own, since an edge on a cycle shares its ends' degrees with edges of the same component only.
So all components go on side by side. One of a few thousand arcs is a task; a larger one gives up one arc per round, and is then split anew.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.graph import with_communities
from strandline.sources.staging import Steps

TASK_ARCS = 5_000  # of a component whose cycles one task breaks


def _ends(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("a").alias("n")).union(arcs.select("b")).distinct()


def _trimmed(arcs: DataFrame, steps: Steps) -> DataFrame:
    """Without the arcs from nodes that nothing leads to and those to nodes that lead nowhere, again and again: they are on no cycle."""
    size = arcs.count()
    while size:
        arcs = steps(arcs.join(arcs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(arcs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "trimmed")
        now = arcs.count()
        if now == size:
            break
        size = now
    return arcs


def strong_components(arcs: DataFrame) -> DataFrame:
    """n, component of the nodes of arcs (a, b) that lie on a cycle with other nodes; a component is the largest n in it.

    Rounds of trimming, forward colours and backward search: the colour of a node is the largest node that leads to it; the nodes of one colour that lead to the
    node that gave it are its component. Each round finds one component at least for every colour.
    """
    steps = Steps(arcs.sparkSession, "strong")
    left = steps(arcs.where("a <> b").select("a", "b").distinct(), "arcs")
    found = []
    while True:
        left = _trimmed(left, steps)
        if left.isEmpty():
            break
        colour = steps(_ends(left).select("n", F.col("n").alias("c")), "colour")
        while True:
            ahead = left.join(colour.select(F.col("n").alias("a"), "c"), "a").select(F.col("b").alias("n"), "c")
            best = colour.unionByName(ahead).groupBy("n").agg(F.max("c").alias("c"))
            now = steps(best, "colour")
            changed = not now.join(colour.withColumnRenamed("c", "old"), "n").where("c <> old").isEmpty()
            colour = now
            if not changed:
                break
        within = left.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").where("ca = cb").select("a", "b")
        within = steps(within, "within")
        fronts = [steps(colour.where("n = c"), "front")]
        while True:
            before = within.join(fronts[-1].select(F.col("n").alias("b"), "c"), "b").select(F.col("a").alias("n"), "c").distinct()
            more = steps(before.join(reduce(DataFrame.unionByName, fronts).select("n"), "n", "left_anti"), "front")
            if more.isEmpty():
                break
            fronts.append(more)
        members = steps(reduce(DataFrame.unionByName, fronts).select("n", F.col("c").alias("component")), "members")
        found.append(members.join(members.groupBy("component").count().where("count > 1"), "component", "left_semi").select("n", "component"))
        gone = members.select("n")
        left = steps(left.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b"), "left")
    return reduce(DataFrame.unionByName, found) if found else left.select(F.col("a").alias("n"), F.col("b").alias("component"))


def _broken(key, own: pd.DataFrame) -> pd.DataFrame:
    """The arcs of one component that go, in order: while there is a cycle, the one on it with the smallest (in-degree of its end, out-degree of its start, names)."""
    name, into, out = {}, {}, {}
    heads = defaultdict(set)
    for r in own.itertuples(index=False):
        name[r.a], name[r.b], into[r.b], out[r.a] = r.src, r.dst, r.into, r.out
        heads[r.a].add(r.b)

    def cyclic() -> dict:
        """Each node's place among the components that are left, nodes without a cycle left out: two searches, the second over turned arcs."""
        order, seen = [], set()
        for top in heads:
            stack = [(top, iter(heads[top]))] if top not in seen else []
            seen.add(top)
            while stack:
                v, rest = stack[-1]
                w = next((w for w in rest if w not in seen), None)
                if w is None:
                    order.append(v)
                    stack.pop()
                else:
                    seen.add(w)
                    stack.append((w, iter(heads.get(w, ()))))
        turned = defaultdict(set)
        for a, ends in heads.items():
            for b in ends:
                turned[b].add(a)
        part: dict = {}
        for top in reversed(order):
            todo = [top] if top not in part else []
            while todo:
                v = todo.pop()
                if v not in part:
                    part[v] = top
                    todo += turned[v] - part.keys()
        return part

    gone = []
    while True:
        part = cyclic()
        on = [(into[b], out[a], name[a], name[b], a, b) for a, ends in heads.items() for b in ends if part[a] == part[b]]
        if not on:
            break
        *_, a, b = min(on)
        heads[a].discard(b)
        into[b] -= 1
        out[a] -= 1
        gone.append((a, b))
    return pd.DataFrame(gone, columns=["a", "b"])


def cycle_breaks(arcs: DataFrame, names: DataFrame, task_arcs: int = TASK_ARCS) -> DataFrame:
    """The arcs (a, b) that go until no cycle is left; names: n, id, by whose order ties are decided. One arc goes at a time in each component."""
    steps = Steps(arcs.sparkSession, "breaks")
    gone = []
    a_name, b_name = names.select(F.col("n").alias("a"), F.col("id").alias("src")), names.select(F.col("n").alias("b"), F.col("id").alias("dst"))
    arcs = steps(arcs.select("a", "b"), "arcs")
    left = arcs
    while True:
        part = strong_components(left)
        inside = left.join(part.toDF("a", "pa"), "a", "left").join(part.toDF("b", "pb"), "b", "left").where("a = b OR pa = pb").select("a", "b", F.coalesce("pa", "a").alias("part"))
        inside = steps(inside, "inside")
        if inside.isEmpty():
            break
        current = arcs if not gone else arcs.join(reduce(DataFrame.unionByName, gone), ["a", "b"], "left_anti")
        into, out = current.groupBy("b").agg(F.count("*").alias("into")), current.groupBy("a").agg(F.count("*").alias("out"))
        judged = steps(inside.join(into, "b").join(out, "a").join(a_name, "a").join(b_name, "b"), "judged")
        sizes = judged.groupBy("part").agg(F.count("*").alias("size"))
        small = judged.join(sizes.where(F.col("size") <= task_arcs).select("part"), "part", "left_semi").groupBy("part").applyInPandas(_broken, "a long, b long")
        large = judged.join(sizes.where(F.col("size") > task_arcs).select("part"), "part", "left_semi")
        first = large.groupBy("part").agg(F.min(F.struct("into", "out", "src", "dst", "a", "b")).alias("e")).select("e.a", "e.b")
        cut = steps(first, "cut")
        gone += [steps(small, "broken"), cut]
        left = steps(large.select("a", "b").join(cut, ["a", "b"], "left_anti"), "large")
    return reduce(DataFrame.unionByName, gone) if gone else arcs.limit(0)


def peeled(arcs: DataFrame) -> DataFrame:
    """n, layer of the nodes of arcs (a, b) without cycle: the number of arcs of the longest path that leads to a node. A round per layer takes those that
    nothing left leads to."""
    steps = Steps(arcs.sparkSession, "layers")
    left = steps(arcs.select("a", "b"), "left")
    front = steps(_ends(left).join(left.select(F.col("b").alias("n")), "n", "left_anti"), "front")
    found, layer = [], 0
    while not front.isEmpty():
        found.append(front.select("n", F.lit(layer).cast("long").alias("layer")))
        taken = left.join(front.select(F.col("n").alias("a")), "a", "left_semi").select(F.col("b").alias("n")).distinct()
        left = steps(left.join(front.select(F.col("n").alias("a")), "a", "left_anti").select("a", "b"), "left")
        front = steps(taken.join(left.select(F.col("b").alias("n")), "n", "left_anti"), "front")
        layer += 1
    return reduce(DataFrame.unionByName, found) if found else front.select("n", F.lit(0).cast("long").alias("layer"))


def dag_layers(edges: DataFrame, nodes: DataFrame, least: int = 3, task_arcs: int = TASK_ARCS) -> DataFrame:
    """community, id, layer, removed: layers within communities once their cycles are broken, and how many edges of the community went for that.

    While there is a cycle, the edge on one with the smallest (in-degree of its end, out-degree of its start, start, end) goes, a loop of a node with
    itself among them; then a node's layer is the longest path to it. Nodes of communities below ``least`` are all layer 0, as are those without edges.
    """
    steps = Steps(edges.sparkSession, "dag")
    sized = nodes.where("community IS NOT NULL").select("community", "id")
    members = steps(sized.withColumn("n", F.monotonically_increasing_id()), "members")
    big = members.groupBy("community").count().where(F.col("count") >= least).select("community")
    own = members.join(big, "community", "left_semi")
    inside = with_communities(edges, own).where("src_cid = dst_cid").select("src", "dst").distinct()
    a, b = own.select(F.col("id").alias("src"), F.col("n").alias("a")), own.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    arcs = steps(inside.join(a, "src").join(b, "dst").select("a", "b"), "arcs")
    gone = steps(cycle_breaks(arcs, members, task_arcs), "gone")
    layers = peeled(arcs.join(gone, ["a", "b"], "left_anti"))
    removed = gone.join(members.select(F.col("n").alias("a"), "community"), "a").groupBy("community").agg(F.count("*").alias("removed"))
    rows = members.join(layers, "n", "left").join(removed, "community", "left")
    return rows.select("community", "id", F.coalesce("layer", F.lit(0)).alias("layer"), F.coalesce("removed", F.lit(0)).alias("removed"))
