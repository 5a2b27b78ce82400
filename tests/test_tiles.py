"""Tiles go to Python vector by vector, so a batch is bounded whatever the tiles; pairs that batches cut in two are whole again."""

import numpy as np

from strandline.operators import matching


def test_pairs_across_batches(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 8)
    v = np.random.default_rng(3).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(60)], "id LONG, block LONG, v ARRAY<DOUBLE>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = matching.similar_pairs(rows, 0.5)
        assert "Generate inline" in found._jdf.queryExecution().toString()
        unit = v / np.linalg.norm(v, axis=1)[:, None]
        sim = unit @ unit.T
        want = {(i % 2, i, j) for i in range(60) for j in range(i + 1, 60) if (i - j) % 2 == 0 and sim[i, j] >= 0.5}
        assert {(r.block, r.id_a, r.id_b) for r in found.collect()} == want
        near = {(r.qid, r.id) for r in matching.nearest(rows.where("id < 10"), rows, 1, -2.0).collect()}
        assert near == {(i, max((j for j in range(i % 2, 60, 2) if j != i), key=lambda j: sim[i, j])) for i in range(10)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
