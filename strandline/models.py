"""The place of external models: a client turns a batch of inputs into answers, and Spark deals out the batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import lenient_json

Client = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], list[list[float]]]


Sampler = Callable[[list[str], float], list[str]]


def tempered(sampler: Sampler, temperature: float) -> Client:
    """A client that asks a sampler at a temperature; a retry is the same sampler at another one."""
    return partial(_sampled, sampler, temperature)


def _sampled(sampler: Sampler, temperature: float, prompts: list[str]) -> list[str]:
    return sampler(prompts, temperature)


def stub(prompts: list[str]) -> list[str]:
    """A deterministic answer to each prompt: a verdict and a confidence drawn from its digest."""
    out = []
    for p in prompts:
        n = int(hashlib.md5(p.encode()).hexdigest()[:8], 16)
        out.append(f'{{"decision": "{"same" if n % 3 else "different"}", "confidence": {n % 100 / 100}}}')
    return out


def ask(rows: DataFrame, key: str, prompt: str, client: Client = stub, batch: int = 64, log: str | None = None) -> DataFrame:
    """(key, answer) of each row; the client gets at most ``batch`` prompts at once. Ask distinct prompts only, filter before.

    With a ``log`` the prompts and answers are appended to that folder and the answers read back from it by key, so that keys in it aren't asked again
    and a lost job goes on where it stopped.
    """
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers: list[str] = []
            for i in range(0, len(b), batch):
                answers += client(b[prompt].iloc[i : i + batch].tolist())
            yield pd.DataFrame({key: b[key], "prompt": b[prompt], "answer": answers})

    schema = f"{key} {kind}, prompt string, answer string"
    asked = rows.select(key, prompt)
    if not log:
        return asked.mapInPandas(work, schema).drop("prompt")
    asked.limit(0).mapInPandas(work, schema).write.mode("append").parquet(log)  # so that there is a folder
    done = rows.sparkSession.read.schema(schema).parquet(log)
    asked.join(done.select(key), key, "left_anti").mapInPandas(work, schema).write.mode("append").parquet(log)
    return rows.sparkSession.read.schema(schema).parquet(log).join(asked.select(key).distinct(), key, "left_semi").select(key, "answer")


# The fields of answers.
TRIPLES = "ARRAY<STRUCT<subject: STRUCT<name: STRING, type: STRING>, relation: STRING, object: STRUCT<name: STRING, type: STRING>, reasoning: STRING>>"
VERDICT = "STRUCT<response: STRING, reason: STRING, standard_subject: STRING, standard_object: STRING>"
CHOICE = r"^[A-D]{1,4}$"


def triples_of(answers: DataFrame, key: str) -> DataFrame:
    """key, source_index (from 1) and the fields of each triple in an answer, which holds any number; records without relation are left out."""
    found = F.from_json(lenient_json(F.col("answer")), TRIPLES)
    rows = answers.select(key, F.posexplode(found).alias("_pos", "t")).where("t.relation IS NOT NULL")
    return rows.select(key, (F.col("_pos") + 1).alias("source_index"), "t.*")


def verdict(answer: Column) -> Column:
    """response, reason and standard names of an answer; 'error' if it doesn't parse."""
    found = F.from_json(lenient_json(answer, array_first=False), VERDICT)
    named = lambda n: F.coalesce(found[n], F.lit("error" if n == "response" else "")).alias(n)
    return F.struct(*(named(n) for n in ("response", "reason", "standard_subject", "standard_object")))


def choice(answer: Column) -> tuple[Column, Column]:
    """The letters of an answer {"answer": ...} and its error: null, parse (no JSON) or schema (letters of another form)."""
    letters = F.get_json_object(lenient_json(answer, array_first=False), "$.answer")
    fits = F.rlike(letters, F.lit(CHOICE))
    return F.when(fits, letters), F.when(letters.isNull(), "parse").when(~fits, "schema")


def embed(rows: DataFrame, text: str, client: Embedder, size: int, cache: str, batch: int = 64) -> DataFrame:
    """text, vector of each distinct text. Known ones come from the folder ``cache``, which keeps a table per ``size``; the others are asked and appended.

    If a batch fails its texts are asked one by one; one that fails alone has no vector, isn't kept, and is asked again next time.
    """
    path, schema = f"{cache}/size={size}", f"{text} string, vector array<double>"

    def vectors(texts: list[str]) -> list[list[float] | None]:
        try:
            return list(client(texts))
        except Exception:  # whatever the client raises
            return [None] if len(texts) == 1 else [v for t in texts for v in vectors([t])]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list[list[float] | None] = []
            for i in range(0, len(b), batch):
                found += vectors(b[text].iloc[i : i + batch].tolist())
            yield pd.DataFrame({text: b[text], "vector": [v if v is not None and len(v) == size else None for v in found]})

    spark = rows.sparkSession
    asked = rows.select(text).where(F.col(text).isNotNull()).distinct()
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path)
    asked.join(known.select(text), text, "left_anti").mapInPandas(work, schema).where("vector IS NOT NULL").write.mode("append").parquet(path)
    return asked.join(spark.read.schema(schema).parquet(path), text, "left")
