"""Lines with a token are a kind of secret_scan."""

from strandline.plans import table_queries


def test_token_is_a_kind(spark, tmp_path):
    token = 'token = "' + "0a" * 20 + '"'
    rows = [(1, f"x\n{token}"), (2, f"{token} C:\\x"), (3, 'token = "0a"'), (4, None)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.line_no, r.kind) for r in table_queries.QUERIES["secret_scan"](spark, str(tmp_path)).collect())
    assert got == [(1, 2, "TOKEN"), (2, 1, "PATH"), (2, 1, "TOKEN")]
