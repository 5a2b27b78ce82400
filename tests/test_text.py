import json

import pytest
from pyspark.sql import functions as F

from strandline import ontology, schemas
from strandline.functions import text as fn
from strandline.plans.table_queries import mapped_units
from strandline.sources import triples


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x STRING")
    return [r.y for r in rows.select(column(F.col("x")).alias("y")).collect()]


def test_ontology_size():
    assert (len(ontology.CLASSES), len(ontology.RELATIONS), len(set(ontology.LEGAL_EDGES))) == (15, 16, 98)


def test_unit_keys(spark):
    names = ["第06章 系統安全技術與規範_e5.pdf", "教材_第10章_資訊安全管理.pdf", "ch3_習題解答.pdf", "iPAS_模組4-保護組織.pdf", "other.json", None]
    assert one(spark, fn.unit_key, *names) == ["CH06", "CH10", "CH03", "MOD04", None, None]


def test_units(spark):
    files = ["第06章 系統安全技術與規範_e5.pdf", "教材_第10章_資訊安全管理.pdf", "iPAS_網路安全簡介_模組4-保護組織.pdf", "other_type.json", "ch6_習題解答.pdf", "期末_exam_1.json"]
    got = {r.file: (r.unit, r.category) for r in mapped_units(spark.createDataFrame([(f,) for f in files], "file STRING")).collect()}
    assert list(map(got.get, files)) == [("06_系統安全技術與規範", "章節"), ("10_資訊安全管理", "章節"), ("M_保護組織", "模組"), ("UNMATCHED", "UNMATCHED"), ("06_系統安全技術與規範", "章節"), ("SKIP", "題庫")]


def test_answers(spark):
    assert one(spark, fn.answer_letters, "b, A or b", "", "xyz") == ["AB", "", ""]


@pytest.mark.parametrize("a, b, f1", [("AB", "BC", 0.5), ("", "", 1.0), ("A", "", 0.0), ("ABC", "ABC", 1.0)])
def test_set_f1(spark, a, b, f1):
    assert spark.range(1).select(fn.set_f1(F.lit(a), F.lit(b)).alias("y")).first().y == f1


def test_lenient_json(spark):
    assert one(spark, fn.lenient_json, 'Sure [1, {"a": 2}] ok', '{"a": 1}', "none", "[broken") == ['[1, {"a": 2}]', '{"a": 1}', None, None]
    assert one(spark, lambda c: fn.lenient_json(c, False), 'x ```json\n{"a": 1}\n``` y') == ['{"a": 1}']


def test_strip_all_white_space(spark):
    assert one(spark, fn.name_key, "　 Foo Bar\t") == ["foo bar"]


def test_buckets(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 9, 10, 49, 50, 99, 100, 101)], "n INT")
    got = sizes.groupBy(fn.size_bucket(F.col("n")).alias("b")).count().collect()
    assert {r.b: r["count"] for r in got} == {"1-2": 2, "3-9": 2, "10-49": 2, "50-99": 2, ">=100": 2}
    assert one(spark, fn.bucket_middle, "3-9", "12+", ">=100") == [6.0, 12.0, None]


def test_triple_files(spark, tmp_path):
    folder = tmp_path / "a.json"
    folder.mkdir()
    triple = {"subject": {"name": "x", "type": "tool"}, "relation": "uses", "object": {"name": "y", "type": "technique"}, "source_index": 1}
    (folder / "chunk_1.json").write_text(json.dumps([triple, triple]))
    (folder / "chunk_2.json").write_text("[]")
    (folder / "chunk_3.json").write_text("{broken")
    rows = triples.read_triples(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0].subject.name == "x"
    kept = triples.read_triples(spark, str(tmp_path), schemas.VALIDATED_TRIPLE)
    assert triples.originals(kept).first().has_original is False


def test_chunk_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(451)))), (2, ""), (3, None)], "doc_id LONG, text STRING")
    assert [(r.doc_id, r.chunk, r.n_tokens) for r in triples.chunk_windows(docs, "doc_id", "text").orderBy("chunk").collect()] == [(1, 1, 451), (1, 2, 1)]


def test_backup_and_csv(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x", "A"), ("b", None, "B"), ("b", None, "B")], "id STRING, label STRING, name STRING")
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("a", "s", "b")], "src STRING, rel STRING, dst STRING")
    triples.backup(nodes, edges, str(tmp_path / "b"))
    assert tuple(triples.verify(spark, str(tmp_path / "b")).first()) == (3, 3, 3, 2, 3)
    assert [t.count() for t in triples.restore(spark, str(tmp_path / "b"))] == [2, 2]
    rows = spark.createDataFrame([("a", "t", "b", "t", 0.5, "same", 0.9, None)], schemas.MERGE_DECISION)
    triples.write_csv(rows, str(tmp_path / "c"))
    assert triples.read_decisions(spark, str(tmp_path / "c")).first().confidence == 0.9
