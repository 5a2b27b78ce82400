"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandline.plans import detail_queries, graph_queries, report_queries, table_queries, view_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**graph_queries.QUERIES, **table_queries.QUERIES, **detail_queries.QUERIES, **report_queries.QUERIES, **view_queries.QUERIES}
SQL = {**graph_queries.SQL, **table_queries.SQL, **detail_queries.SQL, **report_queries.SQL, **view_queries.SQL}


def rows(found):
    return sorted(repr(tuple(f"{v:.6g}" if isinstance(v, float) else v for v in r)) for r in found)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, db):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    assert columns == sorted(db.sql(SQL[name]).columns)
    expected = db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({SQL[name]})").fetchall()
    assert rows(map(tuple, found.select(*columns).collect())) == rows(expected)
