"""The Merkle manifest against a plain recursion."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle
from strandline.llm.common import Workspace

SCHEMA = "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING, leaf STRING, path STRING, _at STRING, _node STRING, `a.b` STRING"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root and, for each node, its siblings and sides."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            paths[i].append((nodes[other] if other < len(nodes) else None, k % 2 == 1))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def whole(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    found = {g: climb([x[2] for x in sorted(groups[g])]) for g in names}
    root, crown = climb([found[g][0] for g in names])
    return [(x[3], x[2], found[g][0], root, p + up) for g, up in zip(names, crown) for x, p in zip(sorted(groups[g]), found[g][1])]


def table(spark, rows):
    return spark.createDataFrame([(*r, "l", "p", "a", "n", "x") for r in rows], SCHEMA).repartition(4)


def corpus(seed, n):
    rng = random.Random(seed)
    langs = [None, "en", "en", "en", "en", "EN", "é", "zz", ""] + [f"l{i}" for i in range(9)]
    rows = [(i * 3, rng.choice(["a", None, ""]), rng.choice(langs), rng.choice([None, i]), rng.choice(["", None, f"text é {i}", "x" * i])) for i in range(n)]
    return rows + [rows[2], rows[2], (6, "other", rows[2][2], 1, "t"), (None, "a", "en", 1, "t"), (None, None, None, None, None), (999_999, "a", "alone", 3, "long " * 20_000)]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_a_recursion(spark, levels, monkeypatch):
    for name in ("climb", "descend"):
        monkeypatch.setattr(merkle, name, (lambda f: lambda *a, **b: f(*a, **b, levels=levels))(getattr(merkle, name)))
    rows = corpus(levels, 90 if levels < 8 else 700)
    out = merkle.manifest(table(spark, rows))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "path", "told"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.leaf, r.subroot, r.root, str([tuple(s) for s in r.path])) for r in out.collect())
    assert got == sorted((d is None, d or 0, a, s, r, str(p)) for d, a, s, r, p in whole(rows))
    assert out.where(merkle.folded(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0


def test_what_was_altered_is_found(spark):
    rows = corpus(5, 60)
    told = F.when(F.col("doc_id") % 9 == 0, merkle.leaf([F.concat("text", F.lit("."))] + [F.col(c) for c in merkle.FIELDS[1:]]))
    out = merkle.manifest(table(spark, rows), told=told).withColumn("ok", merkle.folded(F.col("path"), F.col("told")) == F.col("root"))
    texts = {r[0]: r[4] for r in rows}
    assert all(r.ok == (r.told == r.leaf) for r in out.collect()) and {r.doc_id for r in out.where("NOT ok").collect()} == {d for d in texts if d is not None and d % 9 == 0}


def test_small_trees(spark):
    one = merkle.manifest(table(spark, [(1, "s", "en", 2, "ab")])).first()
    assert one.leaf == one.subroot == one.root == leaf_of((1, "s", "en", 2, "ab")) and one.path == []
    assert merkle.manifest(table(spark, [])).count() == 0
    same = [(7, "s", None, 1, "t")] * 5
    assert {r.root for r in merkle.manifest(table(spark, same)).collect()} == {whole(same)[0][3]}


def test_a_group_of_many_equal_rows_is_cut_into_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(3000).select(F.lit("g").alias("_group"), F.lit(1).alias("_id"), F.lit("n").alias("_node"), F.col("id").alias("_row"))
    work = Workspace(spark, "t")
    dealt = []
    placed = merkle.in_order(rows, lambda df, name: dealt.append(work.stage(df, name)) or dealt[-1])
    assert sorted(r._at for r in placed.select("_at").collect()) == list(range(3000)) and dealt[0].select("_part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
