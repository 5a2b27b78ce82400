import pandas as pd
from pyspark.sql import functions as F

from strandline.operators import centrality, evidence, funnel, graph, layers, matching, stats


def edges(spark, pairs, rel="r"):
    return spark.createDataFrame([(a, rel, b) for a, b in pairs], "src STRING, rel STRING, dst STRING")


def nodes(spark, ids, community=1):
    return spark.createDataFrame([(i, "x", i, community) for i in ids], "id STRING, label STRING, name STRING, community LONG")


def test_components(spark):
    got = graph.components(edges(spark, [("a", "b"), ("c", "b"), ("d", "e"), ("f", "f")]), nodes(spark, "abcdefg")).collect()
    assert {r.id: r.component for r in got} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}


def test_layers_of_a_dag_and_of_a_cycle(spark):
    got = layers.dag_layers(edges(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]), nodes(spark, "ABCD")).collect()
    assert {r.id: r.layer for r in got} == {"A": 0, "B": 1, "C": 1, "D": 2} and {r.removed for r in got} == {0}
    got = layers.dag_layers(edges(spark, [("A", "B"), ("B", "C"), ("C", "B")]), nodes(spark, "ABC")).collect()
    assert {r.removed for r in got} == {1}


def test_ranking_across_communities(spark):
    sizes = {1: 4, 2: 2, 3: 1}
    ns = spark.createDataFrame([(f"{c}-{i}", "x", "n", c) for c, n in sizes.items() for i in range(n)], "id STRING, label STRING, name STRING, community LONG")
    got = graph.ccod_rank(edges(spark, [("1-0", "2-0"), ("1-1", "3-0"), ("2-0", "1-0")]), ns).orderBy("rank").collect()
    assert [(r.cid, r.ccod, r["rank"]) for r in got] == [(1, 2, 1), (2, 1, 2), (3, 0, 3)]


def test_centrality_of_a_path(spark):
    got = {r.id: r for r in centrality.centrality(edges(spark, [("a", "b"), ("b", "c"), ("b", "c")]), nodes(spark, "abc"), least=3).collect()}
    assert (got["b"].betweenness, got["a"].degree, got["c"].closeness) == (1.0, 1, 2 / 3)


def test_path_plan_stops_at_learned_nodes(spark):
    got = graph.path_plan(edges(spark, [("a", "b"), ("b", "t"), ("x", "a"), ("t", "x")]), "t", ["a"]).collect()
    assert {r.id: r.distance for r in got} == {"t": 0, "b": 1, "a": 2}


def test_sequential_merge_is_not_a_closure(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 2), (0, 2, 2, 3), (0, 3, 1, 3), (0, 4, 3, 4)], "block LONG, ord LONG, id_a LONG, id_b LONG")
    merged = matching.sequential_merge(pairs).orderBy("ord")
    assert [r.outcome for r in merged.collect()] == ["merged", "not_found", "merged", "not_found"]
    assert {r.id: r["into"] for r in matching.final_names(merged).collect()} == {2: 1, 3: 1}


def test_capped_pairs(spark):
    pairs = spark.createDataFrame([(0, 1, 2, 0.9), (0, 1, 3, 0.8), (0, 2, 3, 0.7)], "block LONG, id_a LONG, id_b LONG, similarity DOUBLE")
    assert {(r.id_a, r.id_b) for r in matching.capped_pairs(pairs, 1).collect()} == {(1, 2)}


def test_first_wins(spark):
    rows = spark.createDataFrame([("a", "r", "b", 1), ("b", "r", "c", 2), ("d", "r", "e", 3), ("a", "s", "b", 4)], "head STRING, rel STRING, tail STRING, ord INT").withColumn("qid", F.lit(1))
    assert sorted(r.ord for r in evidence.first_wins(rows).collect()) == [1, 3, 4]


def test_funnel_reasons(spark):
    rows = [("s", "tool", "mitigates", "o", "risk"), (None, "tool", "uses", "o", "technique"), ("s", "data", "uses", "o", "tool"), ("z", "attacker", "uses", "o", "tool"), ("z", "securityTeam", "uses", "o", "tool")]
    judged = funnel.funnel(spark.createDataFrame(rows, "s_name STRING, s_type STRING, rel STRING, o_name STRING, o_type STRING"))
    assert {r.outcome: r.n for r in funnel.reasons(judged).collect()} == {"accepted": 1, "syntax": 1, "edge": 1, "rule 1": 2}


def test_bh_is_monotone(spark):
    table = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "i INT, p DOUBLE")
    got = stats.bh(table, ["i"]).orderBy("p").toPandas()
    assert (got.q >= got.p).all() and got.q.is_monotonic_increasing and abs(got.q.iloc[0] - 0.04) < 1e-12


def test_percent_change(spark):
    rows = spark.createDataFrame([(4108, 3703), (0, 0), (0, 5)], "a LONG, b LONG")
    assert [r.p for r in rows.select(stats.percent_change(F.col("a"), F.col("b")).alias("p")).collect()] == ["-9.86%", "0.00%", "NA"]


def test_empty_graph(spark):
    none = edges(spark, [])
    assert graph.components(none, nodes(spark, "a")).toPandas().equals(pd.DataFrame({"id": ["a"], "component": ["a"]}))
    assert graph.structure(nodes(spark, "a"), none).first().isolated == 1


def test_communities_of_two_cliques(spark):
    from strandline.operators.communities import communities

    pairs = [(f"{k}{i}", f"{k}{j}") for k in "ab" for i in range(6) for j in range(i)] + [("a0", "b0")]
    own = edges(spark, pairs)
    found = communities(own)
    got = {r.id: r.community for r in found.collect()}
    assert len({got[f"a{i}"] for i in range(6)}) == 1 and got["a1"] != got["b1"]
    assert stats.modularity(own, found.toDF("id", "cid")).first().modularity > 0.4


def test_model_stub_is_deterministic(spark):
    from strandline import models

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id LONG, prompt STRING")
    first = {r.id: r.answer for r in models.ask(rows, "id", "prompt", batch=2).collect()}
    assert first == {r.id: r.answer for r in models.ask(rows.repartition(3), "id", "prompt").collect()} and len(first) == 5
