"""Centrality and layers against plain loops on random graphs, and on one community of 100,000 nodes."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from strandline.operators import centrality, layers


def graph_of(spark, arcs, ids, community=lambda i: 1):
    edges = spark.createDataFrame([(f"n{a:03d}", "r", f"n{b:03d}") for a, b in arcs], "src STRING, rel STRING, dst STRING")
    nodes = spark.createDataFrame([(f"n{i:03d}", community(i)) for i in ids], "id STRING, community LONG")
    return edges, nodes


def loop_centrality(arcs, ids):
    out = defaultdict(list)
    for a, b in sorted(set(arcs)):
        out[a].append(b)
    between, reach, far = dict.fromkeys(ids, 0.0), dict.fromkeys(ids, 0), dict.fromkeys(ids, 0)
    for s in ids:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = defaultdict(float)
        for w in reversed(order):
            for v in [v for v in order if dist[v] == dist[w] - 1 and w in out[v]]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                between[w] += share[w]
                reach[w] += 1
                far[w] += dist[w]
    return {i: (len(out[i]), round(between[i], 6), round(reach[i] / far[i] if far[i] else 0.0, 9)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_centrality_equals_searches_from_each_node(spark, seed):
    rng = random.Random(seed)
    ids = range(30)
    arcs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    arcs += arcs[:3] + [(4, 4)]
    edges, nodes = graph_of(spark, arcs, ids, lambda i: 1 if i < 25 else None if i == 29 else 2)
    got = centrality.centrality(edges, nodes, least=3, sources=10).collect()
    own = {1: range(25), 2: range(25, 29)}
    want = {f"n{i:03d}": (c, *v) for c, part in own.items() for i, v in loop_centrality([(a, b) for a, b in arcs if a in part and b in part], part).items()}
    assert {r.id: (r.community, r.degree, round(r.betweenness, 6), round(r.closeness, 9)) for r in got} == want
    assert {r.community for r in centrality.centrality(edges, nodes, least=10).collect()} == {1}


def loop_layers(arcs, ids):
    """Networks as sets: an edge is on a cycle if its start can be reached from its end."""
    arcs, removed = set(arcs), []
    def reached(x):
        seen, todo = set(), [x]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [b for a, b in arcs if a == v]
        return seen
    while True:
        behind = {i: reached(i) for i in ids}
        on = [(a, b) for a, b in arcs if a in behind[b]]
        if not on:
            break
        into = lambda x: sum(b == x for _, b in arcs)
        out = lambda x: sum(a == x for a, _ in arcs)
        first = min(on, key=lambda e: (into(e[1]), out(e[0]), *e))
        arcs.discard(first)
        removed.append(first)
    layer = {}
    def depth(x):
        if x not in layer:
            layer[x] = 1 + max((depth(a) for a, b in arcs if b == x), default=-1)
        return layer[x]
    return {i: depth(i) for i in ids}, len(removed)


@pytest.mark.parametrize("seed,task_arcs", [(1, 5000), (2, 5000), (3, 5000), (4, 6)])
def test_layers_equal_one_edge_at_a_time(spark, seed, task_arcs):
    rng = random.Random(seed)
    n = 24 if task_arcs > 10 else 9
    arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(1.7 * n))]
    edges, nodes = graph_of(spark, arcs, range(n + 2), lambda i: 1 if i < n else 7)
    got = layers.dag_layers(edges, nodes, task_arcs=task_arcs).collect()
    want, removed = loop_layers(arcs, range(n))
    assert removed and {(r.id, r.layer, r.removed) for r in got if r.community == 1} == {(f"n{i:03d}", k, removed) for i, k in want.items()}
    assert [(r.layer, r.removed) for r in got if r.community == 7] == [(0, 0)] * 2


def test_components_of_cycles(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8)], "a LONG, b LONG")
    assert {(r.n, r.component) for r in layers.strong_components(arcs).collect()} == {(1, 3), (2, 3), (3, 3), (4, 5), (5, 5)}


N = 100_000


@pytest.fixture(scope="module")
def large(spark):
    """One community: a tree in which node i leads to 20 i + 1 ... 20 i + 20, with loops of three among every hundredth leaf."""
    key = lambda c: F.format_string("n%06d", c)
    ids = spark.range(N)
    tree = ids.where("id > 0").select(key(F.floor((F.col("id") - 1) / 20)).alias("src"), key(F.col("id")).alias("dst"))
    loops = ids.where("id >= 60000 AND id % 100 < 3").select(key(F.col("id")).alias("src"), key(F.when(F.col("id") % 100 == 2, F.col("id") - 2).otherwise(F.col("id") + 1)).alias("dst"))
    return tree.union(loops).selectExpr("src", "'r' rel", "dst"), ids.select(key(F.col("id")).alias("id"), F.lit(1).cast("long").alias("community"))


def test_layers_of_a_large_community(spark, large):
    rows = layers.dag_layers(*large)
    assert rows.count() == N and {r.removed for r in rows.select("removed").distinct().collect()} == {400}
    assert {r.layer for r in rows.select("layer").distinct().collect()} == set(range(7))


def test_centrality_of_a_large_community(spark, large):
    edges, nodes = large
    rows = centrality.ranked(centrality.centrality(edges, nodes, sources=60_000), ["degree", "betweenness"])
    top = rows.where("rank_betweenness <= 3").orderBy("rank_betweenness").collect()
    assert rows.count() == N and rows.where("id = 'n000000'").first().betweenness == 0
    assert top[0].id == "n000001" and rows.agg(F.max("rank_degree")).first()[0] == N
