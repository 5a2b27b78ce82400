"""The text queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    sql = queries.oracle_sql()[name]
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, expected))
