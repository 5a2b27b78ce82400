"""The entry module, with and without the text operators, and the streams."""

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from strandline.streaming import toggles

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin"})


def test_the_rest_passes_without_the_text_operators(tmp_path):
    """Some of the rest's own tests, run where the text operators are deleted."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    tests = ["tests/test_text.py", "tests/test_secrets.py", "tests/test_evidence.py"]
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *tests], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_toggle_stream(spark, tmp_path):
    rows = spark.createDataFrame([("u", "n1"), ("u", "n1"), ("u", "n2")], "user STRING, node STRING")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = toggles.progress(stream, ["user", "node"]).writeStream.format("memory").queryName("toggles").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert [r.node for r in spark.table("toggles").where(F.col("on")).collect()] == ["n2"]
