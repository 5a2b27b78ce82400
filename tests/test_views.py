"""Views, tolerant scans, CSV files, answers and hashes against values worked out by other means."""

import json
import random

from pyspark.sql import functions as F

from strandline.functions import report
from strandline.functions import text as fn
from strandline.operators import communities, views
from strandline.sources import triples as sources


def test_scan_keeps_what_it_can(spark, tmp_path):
    good = {"subject": {"name": "a", "type": "app"}, "relation": "uses", "object": {"name": "b", "type": "data"}}
    files = {
        "a.json": json.dumps([good, good | {"relation": None}, 3, good]), "b.json": json.dumps([good])[:-1], "c.json": json.dumps(good), "d.json": "\n", "z.json": "", "e.json": " [ ] \n", "f.json": "\ufeff" + json.dumps([good | {"more": 1}]), "g.txt": "[",
        "sub/h.json": json.dumps([{"subject": "text", "relation": "uses"}]),
    }
    (tmp_path / "sub").mkdir()
    for name, body in files.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    rows, faults = sources.scan_triples(spark, str(tmp_path))
    short = lambda f: f.rsplit("/", 1)[1]
    assert sorted((short(r._file), r._index, r.relation) for r in rows.collect()) == [("a.json", 1, "uses"), ("a.json", 4, "uses"), ("f.json", 1, "uses"), ("h.json", 1, "uses")]
    assert sorted(map(str, ((short(r.file), r.reason, r["index"]) for r in faults.collect()))) == sorted(
        map(str, [("a.json", "no relation", 2), ("a.json", "no relation", 3), ("b.json", "bad JSON", None), ("c.json", "no array", None), ("d.json", "empty", None), ("e.json", "empty", None)])
    )
    assert {r.outcome: (r.files, r.records) for r in sources.scan_counts(rows, faults).collect()} == {"accepted": (3, 4), "no relation": (1, 2), "bad JSON": (1, 0), "no array": (1, 0), "empty": (2, 0)}


def test_decisions_by_other_names_and_with_a_mark(spark, tmp_path):
    (tmp_path / "d.csv").write_text("\ufeffname_a,type_a,b_name,similarity,decision,conf,note\nx,app,y,0.5,same,0.9,n\nz,,w,bad,different,,\n", encoding="utf-8")
    got = sources.read_decisions(spark, str(tmp_path / "d.csv"), {"name_b": ["other", "b_name"], "confidence": ["conf"]})
    assert [tuple(r) for r in got.collect()] == [("x", "app", "y", None, 0.5, "same", 0.9, None), ("z", None, "w", None, None, "different", None, None)]
    sources.write_csv(spark.createDataFrame([("é", None)], "`a.b` STRING, c INT").coalesce(1), str(tmp_path / "out"), mark=True)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert text.startswith("\ufeffa.b,c\n") and text.endswith('é,""\n')


def fnv(text):
    h = 2166136261
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2])) * 16777619) & 0xFFFFFFFF
    return h


def test_hash_equals_a_loop_over_all_planes(spark):
    rng = random.Random(1)
    point = lambda: rng.choice([rng.randrange(1, 0x80), rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x10000), rng.randrange(0x10000, 0x110000)])
    texts = ["", "a", "foobar", "node:1"] + ["".join(chr(point()) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select("i", report.fnv1a(F.col("t")).alias("h"), report.hash_to_unit(F.col("t"), 7).alias("u")).collect()
    assert {r.i: r.h for r in rows} == {i: fnv(t) for i, t in enumerate(texts)} and {r.i: r.u for r in rows} == {i: fnv(f"{t}:7") / 0xFFFFFFFF for i, t in enumerate(texts)}
    assert fnv("foobar") == 0xBF9CF968


def test_answers_with_fallback(spark):
    cases = [
        ('{"answer": " AB ", "reasoning": "r"}', ("AB", "r", None)), ('x ```json\n{"answer": 3}\n``` y', ("3", "", None)), ('so {"answer": "A"} it is', ("A", "", None)), ('answer: "A、c" ok', ("A、c", 'answer: "A、c" ok', "regex_fallback")),
        ('"answer"："b"', ("b", '"answer"："b"', "regex_fallback")), ("[1]", ("", "[1]", "no_match")), ("n" * 400, ("", "n" * 300, "no_match")), ("", ("", "", "empty")), (None, ("", "", "empty")),
        ('{"answer": "A", "reasoning": "' + "r" * 600 + '"}', ("A", "r" * 500, None)),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i INT, raw STRING").select("i", fn.answer_of(F.col("raw")).alias("a")).collect()
    assert {r.i: tuple(r.a) for r in rows} == {i: want for i, (_, want) in enumerate(cases)}


def test_whole_numbers(spark):
    cases = ["7", " 7.9 ", "-3.9", "1e3", "abc", "", None, "nan", "1e30"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i INT, t STRING").select("i", fn.whole_number(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [7, 7, -3, 1000, None, None, None, None, None]


def graph_of(spark, triples):
    return spark.createDataFrame(triples, "src STRING, rel STRING, dst STRING")


def test_views_of_a_small_graph(spark):
    edges = graph_of(spark, [("a", "r", "b"), ("b", "s", "a"), ("a", "r", "a"), ("c", "r", "a"), ("a", "t", "x")])
    nodes = spark.createDataFrame([("a", "L", "A"), ("b", None, "B"), ("c", "M", None)], "id STRING, label STRING, name STRING")
    assert sorted(map(str, views.edge_view(edges, nodes).collect())) == sorted(map(str, views.edge_view(edges, nodes, 9).collect())) and views.edge_view(edges, nodes).count() == 4
    assert views.edge_view(edges, nodes, 2).count() == 2
    assert [tuple(r) for r in views.surroundings(edges, nodes.where("id = 'a'"), 2).orderBy("rel", "src", "dst").collect()] == [("a", "a", "r", "a"), ("a", "a", "r", "b")]
    assert {(r.other, r.side) for r in views.around(edges, nodes.where("id = 'a'")).collect()} == {("b", "dependent"), ("a", "dependent"), ("x", "dependent"), ("b", "prerequisite"), ("c", "prerequisite")}
    assert {r.id: (r.labels, r.type) for r in views.with_common_label(nodes).collect()} == {"a": (["L", "KGNode"], "L"), "b": (["KGNode"], None), "c": (["M", "KGNode"], "M")}
    assert views.projected(edges).count() == 9 and views.projected(edges, ["s"]).count() == 2


def test_missing_degrees_come_first(spark):
    rows = spark.createDataFrame([("1", "x", 3, "u"), ("2", "y", None, "u"), ("3", "a", 3, "u"), ("4", "z", 9, "u"), ("5", "k", 1, None)], "id STRING, name STRING, degree INT, unit STRING")
    assert {r.id: r.place for r in views.node_order(rows, ["unit"]).collect()} == {"2": 1, "4": 2, "3": 3, "1": 4, "5": 1}
    assert {r.id for r in views.node_order(rows, ["unit"], 1).collect()} == {"2", "5"}


def test_units_by_any_name(spark):
    mapping = spark.createDataFrame([("a/b.pdf", "U1", 1), ("c\\d.pdf", "U2", 2), ("x/b.pdf", "U3", 3), ("e.pdf", "", 4)], "source STRING, unit STRING, ord INT")
    files = spark.createDataFrame([("a/b.pdf",), ("q/b.pdf",), ("c/d.pdf",), ("c\\d.pdf",), ("e.pdf",), ("none",), (None,)], "file STRING")
    assert {r.file: r.unit for r in views.unit_lookup(files, mapping).collect()} == {"a/b.pdf": "U1", "q/b.pdf": "U3", "c/d.pdf": "U2", "c\\d.pdf": "U2", "e.pdf": None, "none": None, None: None}


def test_choices(spark):
    rows = [(0.5, 0.1, 0.9, 0.9), (0.7, 0.0, 0.5, None), (0.8, 0.0, 0.5, 0.3), (0.9, 0.0, 0.4, 0.9)]
    pick = lambda r: views.best_threshold(spark.createDataFrame(r, "threshold DOUBLE, cross_rate DOUBLE, reduction DOUBLE, modularity DOUBLE")).first().threshold
    assert pick(rows) == 0.8 and pick(rows[:1]) == 0.5
    links = spark.createDataFrame([(f"{k}{i}", f"{k}{j}") for k in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")], "src STRING, dst STRING")
    judged = communities.judged(communities.grid(links, [1.0], [1, 6]), links)
    got = {r.config: r for r in judged.collect()}
    assert got.keys() == {"cid_g10_m1"} and got["cid_g10_m1"].communities == 2 and got["cid_g10_m1"].modularity == round(20 / 21 - 0.5, 6)
    assert communities.chosen(judged).first().config == "cid_g10_m1" and communities.chosen(judged, "other").count() == 0


def test_statistics_of_a_merge(spark):
    merged = spark.createDataFrame([(1, 2, "merged"), (3, 4, "merged"), (2, 5, "not_found")], "id_a LONG, id_b LONG, outcome STRING")
    types = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "z")], "id LONG, type STRING")
    links = spark.createDataFrame([(1, 2), (2, 5), (1, 5), (4, 5)], "src LONG, dst LONG")
    into = spark.createDataFrame([(2, 1), (4, 3)], "id LONG, into LONG")
    row = views.merge_statistics(merged, types, links, into).first().asDict()
    assert row == {"pairs": 3, "merged": 2, "not_found": 1, "cross_rate": 0.5, "edges_before": 4, "edges_after": 3, "self_loops": 1, "preserved": 0.5}


def test_a_retry_at_another_temperature(spark):
    from strandline import models

    sampler = lambda prompts, t: [f"{p}@{t}" for p in prompts]
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "id LONG, prompt STRING")
    assert {r.answer for r in models.ask(rows, "id", "prompt", models.tempered(sampler, 0.7)).collect()} == {"p@0.7", "q@0.7"}
