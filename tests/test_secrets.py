from strandline.plans import table_queries

KEY = "sk-" + "a" * 24
LINES = [
    (f"{KEY} in C:\\x", ["OPENAI_API_KEY", "PATH"]), (f"{KEY} gsk_{'b' * 20}", ["GROQ_API_KEY", "OPENAI_API_KEY"]), ("NEO4J_PASSWORD=hunter2", ["ENV NEO4J_PASSWORD"]),
    (f'OPENAI_API_KEY = "{KEY}"', ["ENV OPENAI_API_KEY", "OPENAI_API_KEY"]), ("export GROQ_API_KEY_2=abc", ["ENV GROQ_API_KEY_2"]), ("NVIDIA_API_KEY_3 = v", ["ENV NVIDIA_API_KEY_3"]),
    ("GEMINI_API_KEY='x' # local", ["ENV GEMINI_API_KEY"]), ("NVIDIA_API_KEY=abc", []), ("MY_NEO4J_PASSWORD=abc", []), ("密NEO4J_PASSWORD=abc", []),
    ('NEO4J_PASSWORD = os.getenv("NEO4J_PASSWORD")', []), ("NEO4J_PASSWORD=", []), ("NEO4J_PASSWORD=  ", []), ('NEO4J_PASSWORD="ChangeMe"', []), ("GOOGLE_API_KEY=<your key>", []),
    ("NEO4J_PASSWORD='none' ", []), ("GOOGLE_API_KEY=your_api_key_here", []), ("plain text", []), ('token = "' + "0a" * 20 + '"', []),
]


def test_every_kind_of_a_line(spark, tmp_path):
    rows = [(1, "\n".join(line for line, _ in LINES)), (2, None)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.line_no, r.kind) for r in table_queries.QUERIES["secret_scan"](spark, str(tmp_path)).collect())
    assert got == [(1, n, kind) for n, (_, kinds) in enumerate(LINES, 1) for kind in kinds]
