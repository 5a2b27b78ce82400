"""Whole queries that have no SQL against loops over the smallest tables."""

import json
import os
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from strandline import models
from strandline.plans import detail_queries, graph_queries, report_queries, table_queries
from strandline.plans.graph_binding import edges, nodes
from test_large_communities import loop_centrality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    return {int(r.vec_id): (int(r.label), np.array(r.embedding, float)) for r in rows.itertuples()}


def similar(vectors, least):
    out = []
    for i, (b, v) in vectors.items():
        for j, (c, w) in vectors.items():
            if b == c and i < j and (s := v @ w / (np.linalg.norm(v) * np.linalg.norm(w))) >= least:
                out.append((b, i, j, s))
    return sorted(out, key=lambda r: (r[0], -r[3], r[1], r[2]))


@pytest.fixture(scope="module")
def merges(vectors):
    """Capped pairs, in order, with what became of each, and where nodes went."""
    used, gone, into, rows = Counter(), set(), {}, []
    for b, i, j, _ in similar(vectors, 0.3):
        if used[i] < 10 and used[j] < 10:
            used.update((i, j))
            ok = i not in gone and j not in gone
            if ok:
                gone.add(j)
                into[j] = i
            rows.append((b, i, j, ok))
    def last(x):
        while x in into:
            x = into[x]
        return x
    return rows, last


def test_greedy_pairs_and_merges(spark, merges):
    rows, _ = merges
    assert {(r.id_a, r.id_b) for r in table_queries.QUERIES["greedy_pairs"](spark, SF).collect()} == {(i, j) for _, i, j, _ in rows}
    want = Counter((b, "merged" if ok else "not_found") for b, _, _, ok in rows)
    assert {(r.block, r.outcome): r.n for r in table_queries.QUERIES["sequential_merge"](spark, SF).collect()} == want


def test_merge_stats_and_merged_graph(spark, vectors, merges):
    rows, last = merges
    links = [(i, j) for _, i, j, _ in similar(vectors, 0.25)]
    moved = [(last(i), last(j)) for i, j in links]
    loops = sum(a == b for a, b in set(moved))
    merged = [(i, j) for _, i, j, ok in rows if ok]
    want = {
        "pairs": len(rows), "merged": len(merged), "not_found": len(rows) - len(merged), "cross_rate": round(sum(i % 3 != j % 3 for i, j in merged) / len(merged), 4),
        "edges_before": len(links), "edges_after": len(set(moved)), "self_loops": loops, "preserved": round((len(set(moved)) - loops) / len(links), 4),
    }
    assert detail_queries.QUERIES["merge_stats"](spark, SF).first().asDict() == want
    assert {(r.src, r.dst): r.n for r in report_queries.QUERIES["merged_graph"](spark, SF).collect()} == Counter((a, b) for a, b in moved if a != b)


def test_model_decisions(spark, vectors):
    answers = [json.loads(models.stub([f"same? {i}|{j}"])[0]) for _, i, j, _ in similar(vectors, 0.3)]
    want = {t: (len(answers), sum(a["decision"] == "same" and a["confidence"] >= t for a in answers)) for t in (0.5, 0.7, 0.9)}
    assert {r.threshold: (r.total, r.same) for r in detail_queries.QUERIES["model_decisions"](spark, SF).collect()} == want


def test_fuzzy_names(spark, vectors):
    names = defaultdict(set)
    for r in pd.read_parquet(f"{SF}/part.parquet").itertuples():
        names[r.p_type].add(r.p_name)
    want = {(t, a, b) for t, own in names.items() for a in own for b in own if a < b and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.75}
    assert {(r.block, r.name_a, r.name_b) for r in table_queries.QUERIES["fuzzy_names"](spark, SF).collect()} == want and want


def test_centrality_of_the_bound_graph(spark, vectors):
    of = {r.id: r.community for r in nodes(spark, SF).collect() if r.community is not None}
    arcs, members = defaultdict(list), defaultdict(list)
    for r in edges(spark, SF).collect():
        if r.src in of and of.get(r.dst) == of[r.src]:
            arcs[of[r.src]].append((r.src, r.dst))
    for i, c in of.items():
        members[c].append(i)
    want = {}
    for c, own in members.items():
        if len(own) >= 10:
            found = loop_centrality(arcs[c], sorted(own))
            for k, m in enumerate(("degree", "betweenness", "closeness")):
                for place, i in enumerate(sorted(own, key=lambda i: (-found[i][k], i)), 1):
                    want[i, m] = (found[i][k], place)
    got = graph_queries.QUERIES["centrality"](spark, SF).collect()
    assert {(r.id, m): (round(r[m], 6 if m == "betweenness" else 9), r[f"rank_{m}"]) for r in got for m in ("degree", "betweenness", "closeness")} == want


def test_grid_of_the_bound_graph(spark, vectors):
    """Nodes of a configuration lie in communities of its least size, numbered by size; a grid's smaller least sizes keep the larger ones' communities."""
    rows = report_queries.QUERIES["community_grid"](spark, SF).collect()
    by = defaultdict(lambda: defaultdict(set))
    for r in rows:
        by[r.config][r.community].add(r.id)
    assert len(by) == 18
    for config, found in by.items():
        sizes = [len(found[c]) for c in sorted(found)]
        assert sorted(found) == list(range(1, len(found) + 1)) and sizes == sorted(sizes, reverse=True) and min(sizes) >= int(config.rsplit("m", 1)[1])
        whole = by[f"{config.rsplit('m', 1)[0]}m1"]
        assert all(members == whole[c] for c, members in found.items()) and sum(map(len, whole.values())) == len({r.id for r in rows if r.config.endswith("m1") and r.config[:7] == config[:7]})
