"""Matching by rounds against the loops and all pairs that they stand for."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from strandline.operators import evidence, matching, stats
from pyspark.sql import functions as F


def random_pairs(n_graphs, seed):
    rng = random.Random(seed)
    for g in range(n_graphs):
        n = rng.randint(2, 9)
        every = [(a, b) for a in range(n) for b in range(a + 1, n)]
        for a, b in rng.sample(every, rng.randint(1, len(every))):
            yield g, a, b, rng.choice([0.5, 0.6, 0.7, 0.8, 0.9])


def test_capped_pairs_equal_the_loop_on_random_graphs(spark):
    rows = list(random_pairs(1000, 1))
    for cap in (1, 3):
        used, want = {}, set()
        for g, a, b, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
            if used.get((g, a), 0) < cap and used.get((g, b), 0) < cap:
                want.add((g, a, b))
                used[g, a], used[g, b] = used.get((g, a), 0) + 1, used.get((g, b), 0) + 1
        table = spark.createDataFrame([(*r, "x") for r in rows], "block LONG, id_a LONG, id_b LONG, similarity DOUBLE, more STRING")
        found = matching.capped_pairs(table, cap)
        assert found.columns == table.columns and {(r.block, r.id_a, r.id_b) for r in found.collect()} == want


def test_sequential_merge_equals_the_loop_on_random_graphs(spark):
    rng = random.Random(2)
    rows = [(g, o, *rng.choice([(a, b), (b, a)])) for o, (g, a, b, _) in enumerate(random_pairs(1000, 3))]
    rows = [(g, o, a, b) for (g, _, a, b), o in zip(rows, rng.sample(range(len(rows)), len(rows)))] + [(0, -1, 1, 1), (0, -2, 1, 1)]
    gone, into, want = set(), {}, {}
    for g, o, a, b in sorted(rows, key=lambda r: (r[0], r[1])):
        ok = a != b and (g, a) not in gone and (g, b) not in gone
        if ok:
            gone.add((g, b))
            into[g, b] = a
        want[g, o] = "merged" if ok else "not_found"
    merged = matching.sequential_merge(spark.createDataFrame(rows, "block LONG, ord LONG, id_a LONG, id_b LONG"))
    assert {(r.block, r.ord): r.outcome for r in merged.collect()} == want

    def last(g, x):
        while (g, x) in into:
            x = into[g, x]
        return x

    one = merged.where("block = 7")
    assert {r.id: r["into"] for r in matching.final_names(one).collect()} == {x: last(7, x) for g, x in into if g == 7}


def test_long_chain_of_names(spark):
    merged = spark.createDataFrame([(0, i, i, i + 1, "merged") for i in range(40)], "block LONG, ord LONG, id_a LONG, id_b LONG, outcome STRING")
    assert {r["into"] for r in matching.final_names(merged).collect()} == {0}


@pytest.mark.parametrize("group", [512, 5])
def test_fuzzy_pairs_equal_all_pairs(spark, group):
    rng = random.Random(3)
    words = ["attack", "Attack Surface", "sql", "injection", "İz", "é", "Part#1", "aaaa"]
    names = []
    for _ in range(120):
        w = list(" ".join(rng.choices(words, k=rng.randint(1, 3))))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcx1é")
        names.append((rng.randint(0, 2), "".join(w)))
    rows = names + names[:9] + [(0, ""), (0, None), (1, "x" * 260), (1, "x" * 259 + "y")]
    by = {}
    for b, n in set(rows):
        if n:
            by.setdefault(b, set()).add(n)
    want = {(b, x, y): SequenceMatcher(None, x.lower(), y.lower()).ratio() for b, v in by.items() for x in v for y in v if x < y}
    want = {k: r for k, r in want.items() if r >= 0.75}
    found = matching.fuzzy_pairs(spark.createDataFrame(rows, "block LONG, name STRING"), group=group).collect()
    assert len(found) == len(want) and {(r.block, r.name_a, r.name_b): r.ratio for r in found} == want and want


def test_nearest_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 7)
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(60, 1, [0.0] * 4)]
    table = spark.createDataFrame(rows, "id LONG, block LONG, v ARRAY<DOUBLE>")
    want = set()
    for i, b, v in rows:
        sims = []
        for j, c, w in rows:
            n = np.linalg.norm(v) * np.linalg.norm(w)
            s = float(np.floor(np.dot(v, w) / n * 1e4 + 0.5) / 1e4) if n else 0.0
            if b == c and i != j and s > 0.5:
                sims.append((-s, j))
        want |= {(i, j, -s, k) for k, (s, j) in enumerate(sorted(sims)[:3], 1)}
    assert {tuple(r) for r in matching.nearest(table, table, 3, 0.5).collect()} == want


def test_minima_over_ranges(spark):
    rng = random.Random(5)
    ps = [(i, rng.choice([0.001, 0.02, 0.02, 0.5, rng.random()])) for i in range(300)] + [(300, None)]
    table = spark.createDataFrame(ps, "i INT, p DOUBLE").repartition(7)
    ranked = sorted((p, i) for i, p in ps if p is not None)
    least, want = 1.0, {300: None}
    for k in range(len(ranked), 0, -1):
        least = min(least, ranked[k - 1][0] * len(ranked) / k)
        want[ranked[k - 1][1]] = least
    got = {r.i: r.q for r in stats.bh(table, ["i"]).collect()}
    assert got.keys() == want.keys() and got.pop(300) is None and all(q == pytest.approx(want[i], rel=1e-12) for i, q in got.items())


def test_texts_within_texts(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abé", k=n))
    inner, outer = {text(rng.randint(1, 5)) for _ in range(60)}, {text(rng.randint(1, 12)) for _ in range(60)}
    rows = lambda x: spark.createDataFrame([(t,) for t in x], "text STRING")
    assert {tuple(r) for r in evidence.contained(rows(inner | {""}), rows(outer)).collect()} == {(a, b) for a in inner for b in outer if a in b}


def test_hub_neighbours_are_ranked_once(spark):
    edges = spark.range(300).select(F.lit("hub").alias("src"), F.lit("r").alias("rel"), F.format_string("n%03d", "id").alias("dst"))
    linked = spark.range(40).selectExpr("id qid", "'hub' id")
    assert evidence.first_neighbours(edges, linked).count() == 50
    found = evidence.expand(linked, edges)
    assert found.count() == 40 * 50 and found.agg(F.max("tail")).first()[0] == "n049"
