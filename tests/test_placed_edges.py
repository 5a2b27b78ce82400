"""Edges that come with the communities of their ends, against looking both ends up; modularity from counts."""

import os

import pytest

from strandline.operators import graph, stats
from strandline.plans.graph_binding import edges, nodes, placed_edges

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_placed_edges_equal_looked_up_ones(spark):
    columns = ["src", "rel", "dst", "src_cid", "dst_cid"]
    want = graph.with_communities(edges(spark, SF), nodes(spark, SF)).select(*columns)
    got = placed_edges(spark, SF).select(*columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_modularity_counts_edges_that_leave_the_graph(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "x")], "src STRING, dst STRING")
    own = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id STRING, cid LONG")
    assert round(stats.modularity(links, own).first().modularity, 9) == round(1 / 3 - (3 / 6) ** 2 + 0 - (2 / 6) ** 2, 9)
