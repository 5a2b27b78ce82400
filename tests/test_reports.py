"""Report functions, tests of samples, answers of models, evidence and merges, against values worked out by other means."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline import models
from strandline.functions import report
from strandline.operators import centrality, communities, evidence, graph, stats
from strandline.plans import report_queries
from strandline.sources import triples as sources


def values(spark, column, rows, schema):
    return [r.v for r in spark.createDataFrame(rows, schema).select("i", column.alias("v")).orderBy("i").collect()]


def test_tails_of_the_normal(spark):
    z = [0.0, 0.01, 1.0, -1.96, 4.2, 4.3, 8.0, 20.0]
    got = values(spark, stats.normal_tails(F.col("z")), list(enumerate(z)), "i INT, z DOUBLE")
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], rel=1e-10)


def test_tails_of_students_t(spark):
    def integral(t, v, n=100_000):
        c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        return 1 - 2 * sum(c * (1 + (t * (i + 0.5) / n) ** 2 / v) ** (-(v + 1) / 2) for i in range(n)) * t / n

    cases = [(0.0, 5.0), (0.3, 1.0), (2.0, 1.0), (1.5, 2.5), (2.2, 11.3), (0.01, 400.0), (3.0, 986.6), (1.0, 9_999.0), (2.5, 10_001.0), (1.96, 1e6)]
    got = values(spark, stats.student_tails(F.col("t"), F.col("v")), [(i, *c) for i, c in enumerate(cases)], "i INT, t DOUBLE, v DOUBLE")
    assert got == pytest.approx([1.0, *(integral(*c) for c in cases[1:])], abs=2e-8)
    assert values(spark, stats.log_gamma(F.col("x")), [(i, x) for i, x in enumerate([0.5, 1.0, 3.7, 200.25])], "i INT, x DOUBLE") == pytest.approx([math.lgamma(x) for x in (0.5, 1.0, 3.7, 200.25)], abs=1e-10)


def test_thresholds_and_configurations(spark):
    given = ["0.7", "t0.7", " t0.70 ", "1", "best", "", None]
    keys = values(spark, report.threshold_key(F.col("x")), list(enumerate(given)), "i INT, x STRING")
    assert keys == ["t0.7", "t0.7", "t0.7", "t1", "tbest", "N/A", "N/A"]
    assert values(spark, report.threshold_number(F.col("x")), list(enumerate(keys)), "i INT, x STRING") == [0.7, 0.7, 0.7, 1.0, math.inf, math.inf, math.inf]
    assert (report.config_name(0.5, 3), report.config_name(1.0, 10)) == ("cid_g05_m3", "cid_g10_m10")


def test_seeded_vectors_have_length_one(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("t")).withColumn("v", report.seeded_vector(F.col("t"), 8)).collect()
    assert all(sum(x * x for x in r.v) == pytest.approx(1) for r in rows) and len({tuple(r.v) for r in rows}) == 200
    assert all(abs(sum(r.v[i] for r in rows) / 200) < 0.15 for i in range(8))


def test_store_keeps_the_first_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, x STRING")
    sources.append_new(rows, ["id"], str(tmp_path / "s"))
    again = sources.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "id INT, x STRING"), ["id"], str(tmp_path / "s"))
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.json", "in/b.json", "in/c.pdf", "d.txt"):
        (tmp_path / name).write_text(f"[{name}]\n.")
    assert sorted(r.path.rsplit("/", 1)[1] for r in sources.scan_documents(spark, str(tmp_path)).collect()) == ["a.json", "b.json", "c.pdf"]
    assert sorted(r.text for r in sources.read_texts(spark, str(tmp_path)).collect()) == ["[a.json]\n.", "[in/b.json]\n."]


def test_log_is_asked_once(spark, tmp_path):
    def refuse(prompts):
        raise ConnectionError("no service")

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "id LONG, prompt STRING")
    first = {r.id: r.answer for r in models.ask(rows, "id", "prompt", log=str(tmp_path / "log")).collect()}
    assert {r.id: r.answer for r in models.ask(rows, "id", "prompt", refuse, log=str(tmp_path / "log")).collect()} == first and len(first) == 4


def test_embedding_one_by_one(spark, tmp_path):
    rows = spark.createDataFrame([(t,) for t in ["ab", "", "cd", "ab", None, "bad"]], "t STRING")

    def client(texts):
        if "bad" in texts or (len(texts) > 1 and "" in texts):
            raise ValueError(texts)
        return [[float(len(t)), 1.0] for t in texts]

    got = {r.t: r.vector for r in models.embed(rows.coalesce(1), "t", client, 2, str(tmp_path / "c")).collect()}
    assert got == {"ab": [2.0, 1.0], "": [0.0, 1.0], "cd": [2.0, 1.0], "bad": None}
    assert {r.vector for r in models.embed(rows, "t", client, 3, str(tmp_path / "c")).collect()} == {None}


def test_claims_and_relations(spark):
    answers = [
        '{"sub_claims": [{"sentence": " A ", "entities": ["x ", "", "y", "z"]}, {"sentence": "B", "entities": []}, {"sentence": "C"}]}', "1. Alpha beats beta, Entity set: ['x' ## \"y\"]\n  2. Gamma。 Entity set：[z]\nrest",
        '{"sub_claims": []}', "", None, "{broken",
    ]
    got = sorted((r.qid, r.place, r.sentence, r.entities) for r in evidence.sub_claims(spark.createDataFrame(list(enumerate(answers)), "qid INT, answer STRING")).collect())
    assert got == [(0, 1, "A", ["x", "y"]), (1, 1, "Alpha beats beta", ["x", "y"]), (1, 2, "Gamma", ["z"])]
    cases = [('{"selected_relations": ["s", "q", "r"]}', ["s", "r"]), ("I take ['r', t]", ["r", "t"]), ("nothing", ["r", "s", "t"]), (None, ["r", "s", "t"]), ('{"selected_relations": ["q"]}', ["r", "s", "t"])]
    candidates = F.array(*map(F.lit, "rst"))
    assert values(spark, evidence.chosen_relations(F.col("a"), candidates), [(i, a) for i, (a, _) in enumerate(cases)], "i INT, a STRING") == [e for _, e in cases]


def retrieved(names, edges, asked):
    """The evidence of each question by loops, and the outcome."""
    out = {}
    for q, ids, outcome in asked:
        rels = sorted({r for s, r, d in edges for i in ids if i in (s, d)})
        rels = rels if len(rels) <= 10 else rels[:3]
        near = {(s, r, d) for s, r, d in edges if r in rels and (s in ids or d in ids)}
        heads, over = sorted({d for _, _, d in near})[:30], sorted({r for _, r, _ in near})[:10]
        far = {(s, r, d) for s, r, d in edges if s in heads and r in over} - near
        seen, kept = set(), set()
        for s, r, d in [*sorted(near, key=lambda t: (t[1], t[0], t[2])), *sorted(far, key=lambda t: (t[1], t[0], t[2]))]:
            if (s, r) not in seen and (d, r) not in seen:
                seen |= {(s, r), (d, r)}
                kept.add((s, r, d))
        out[q] = (outcome, kept)
    return out


def test_retrieval_equals_loops(spark):
    names = ["NATION_0", "NATION_1", "NATION_2", *(f"SUPPLIER#{i:09d}" for i in range(3)), *"abcdef"]
    pairs = [(names[i], f"r{(i * j) % 12:02d}", names[(i * 5 + j * 7) % len(names)]) for i in range(len(names)) for j in range(1, 9)]
    edges = sorted(set(pairs) | {(names[0], f"r{k:02d}", "a") for k in range(12)})
    nodes = spark.createDataFrame([(n, n) for n in names], "id STRING, name STRING")
    questions = spark.createDataFrame([(q, f"{q}|NATION_{q}|SUPPLIER#{q:09d}") for q in range(3)], "qid LONG, stem STRING")
    found, outcomes = evidence.retrieve(questions, nodes, spark.createDataFrame(edges, "src STRING, rel STRING, dst STRING"), report_queries.claims_stub, report_queries.relations_stub, report_queries.claims_again)
    kept = defaultdict(set)
    for r in found.collect():
        kept[r.qid].add((r["head"], r.rel, r["tail"]))
    got = {r.qid: (r.outcome, kept[r.qid]) for r in outcomes.collect()}
    assert got == retrieved(names, edges, [(q, (f"NATION_{q}", f"SUPPLIER#{q:09d}"), "retry" if q == 2 else "first") for q in range(3)])
    _, single = evidence.retrieve(questions, nodes, spark.createDataFrame(edges, "src STRING, rel STRING, dst STRING"), report_queries.claims_stub, report_queries.relations_stub)
    assert {r.qid: (r.outcome, r.n_claims) for r in single.collect()}[2] == ("failed", 0)


def test_learning_path_keeps_to_layers(spark):
    edges = spark.createDataFrame([("a", "r", "t"), ("b", "r", "t"), ("c", "r", "b"), ("x", "r", "t"), ("y", "r", "x")], "src STRING, rel STRING, dst STRING")
    layered = spark.createDataFrame([("t", 2, 0), ("a", 1, 1), ("b", 1, 3), ("c", 0, 1), ("x", None, 9), ("y", 0, 5)], "id STRING, layer LONG, degree LONG")
    got = [(r.id, r.distance, r.learned) for r in graph.learning_path(edges, layered, "t", ["a"]).collect()]
    assert got == [("c", 2, False), ("b", 1, False), ("a", 1, True), ("t", 0, False)]


def test_merge_moves_edges_and_sources(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("a", "r", "c"), ("c", "s", "b")], "src STRING, rel STRING, dst STRING")
    into = spark.createDataFrame([("b", "a")], "id STRING, into STRING")
    assert sorted(map(tuple, graph.rewired(edges, into).collect())) == [("a", "r", "c", 2), ("c", "s", "a", 1)]
    sources_of = spark.createDataFrame([("a", 1, "f1"), ("b", 2, "f2"), ("c", 3, "f3")], "id STRING, ord INT, source STRING")
    assert sorted(map(tuple, graph.merged_sources(sources_of, into).collect())) == [("a", False, 2, "f2"), ("a", True, 1, "f1"), ("c", True, 3, "f3")]


def test_grid_of_communities(spark):
    pairs = [(f"{k}{i}", "r", f"{k}{j}") for k, n in (("a", 6), ("b", 4), ("c", 2)) for i in range(n) for j in range(i)]
    found = communities.grid(spark.createDataFrame(pairs, "src STRING, rel STRING, dst STRING"), [0.5, 1.0], [1, 3])
    got = {(r.config, r.id): r.community for r in found.collect()}
    assert {c for c, _ in got} == {"cid_g05_m1", "cid_g05_m3", "cid_g10_m1", "cid_g10_m3"}
    assert all(got[c, f"a{i}"] == 1 for c in ("cid_g05_m3", "cid_g10_m1") for i in range(6)) and got["cid_g10_m1", "c0"] == 3 and ("cid_g10_m3", "c0") not in got
    assert {r.id: r.community for r in communities.final(found, "cid_g10_m3").collect()}["b1"] == 2


def test_ranks_within_communities(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 9), ("d", 2, 0)], "id STRING, community LONG, degree LONG")
    assert {r.id: r.rank_degree for r in centrality.ranked(rows, ["degree"]).collect()} == {"c": 1, "a": 2, "b": 3, "d": 1}
