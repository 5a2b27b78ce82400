from itertools import combinations

from pyspark.sql import functions as F

from strandline.operators import evidence


def graph_of(spark, triples):
    return spark.createDataFrame(triples, "src STRING, rel STRING, dst STRING")


def test_links_by_containment(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["SQL Injection", "sql", "SQL Injection Attack", "Firewall", "wall", "", None])], "id INT, name STRING")
    asked = ["sql injection", "injection att", "the firewall rule", "a wall", "nothing", "ction", "", None]
    got = {r.qid: r.id for r in evidence.link_entities(spark.createDataFrame(list(enumerate(asked)), "qid INT, mention STRING"), names).collect()}
    assert got == {0: 0, 1: 2, 2: 3, 3: 4, 5: 0}


def test_relations_and_one_more_hop(spark):
    edges = graph_of(spark, [("a", "r", "b"), ("z", "s", "a"), ("b", "r", "c"), ("b", "t", "d"), ("c", "r", "e")])
    linked = spark.createDataFrame([(1, "a"), (2, "c")], "qid INT, id STRING")
    assert {r.qid: r.relations for r in evidence.relation_candidates(linked, edges).collect()} == {1: ["r", "s"], 2: ["r"]}
    near = evidence.expand(linked.where("qid = 1"), edges)
    assert sorted((r.head, r.rel, r.tail) for r in evidence.hop(near, edges).collect()) == [("a", "r", "b"), ("b", "r", "c")]


def test_pairs_within_and_across(spark):
    small = [(c, f"n{c}-{i}") for c in (1, 2, 3) for i in range(7)] + [(c, "same") for c in (1, 2)] + [(4, "alone"), (4, "too")]
    nodes = spark.createDataFrame([(str(k), n, c) for k, (c, n) in enumerate(small)], "id STRING, name STRING, community LONG")
    of = {n: {c for c, m in small if m == n} for _, n in small}
    rows = evidence.sample_pairs(nodes, per_community=20, least=7).collect()
    assert {(r.community, r.pair_type): 0 for r in rows}.keys() == {(c, k) for c in (1, 2, 3) for k in ("in", "cross")}
    assert all(sum((r.community, r.pair_type) == (c, k) for r in rows) == 20 for c in (1, 2, 3) for k in ("in", "cross"))
    assert len({(r.a, r.b) for r in rows}) == len(rows) and all(r.a < r.b and {r.community, r.other} <= of[r.a] | of[r.b] and (r.pair_type == "in") == (r.other == r.community) for r in rows)
    every = evidence.sample_pairs(nodes.where("community = 3"), per_community=500, least=7)
    assert {(r.a, r.b) for r in every.collect()} == set(combinations([f"n3-{i}" for i in range(7)], 2))
    names = nodes.where("community IN (1, 3)")
    assert evidence.sample_pairs(names, per_community=500, least=7).groupBy("pair_type").agg(F.count("*").alias("n")).where("pair_type = 'cross'").first().n == 56
