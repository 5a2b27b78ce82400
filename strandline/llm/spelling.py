"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

Of two words that differ by one code point, the shorter cut into two halves keeps one of them whole in the longer: the first half at the
start, the second at the end, where a word of one more code point has it shifted by one. So every word is indexed by the two
halves of its length, and probes the halves that words of its own length and of one less would have. What a word and its key leave open
is again a pair of texts one edit apart: a group that many words share is split by cutting what is open into halves once more, until groups
are small. So no group emits all its pairs, and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandline.llm.common import Workspace, bounded_batches

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_N = 6, 5
SLIPS = 199  # one in so many distinct runs of a document loses a code point
GROUP = 32  # words under a key; beyond, the key is made longer
HELD = 1 << 18  # words that a task counts before it passes them on
HELD_BYTES = 32 << 20


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, slips: int | None = SLIPS) -> DataFrame:
    """word, n: the runs of letters in whole texts, A-Z in lower case, of at least that length after slips, and how often each occurs.

    Counts are summed within a task, of at most HELD words at a time, before they are shuffled; so a word that is everywhere is a row per task.
    A null text has no runs; a null id counts as an empty one. Rows with one id slip alike.
    """
    bounded_batches(docs.sparkSession)
    runs = re.compile(f"{RUN}{{{least_length},}}").findall  # a shorter run can't become a word

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        size = 0
        table = lambda: pd.DataFrame({"word": list(held), "n": list(held.values())})
        for batch in batches:
            for key, text in zip(batch["_id"], batch["_text"]):
                head = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(runs(text.encode().lower().decode())).items():
                    if slips:
                        h = zlib.crc32(run.encode(), head)
                        if h % slips == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                    if run not in held:
                        size += len(run)
                    held[run] += n
                if len(held) >= HELD or size >= HELD_BYTES:
                    yield table()
                    held.clear()
                    size = 0
        if held:
            yield table()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text"))
    counted = rows.mapInPandas(count, StructType([StructField("word", StringType()), StructField("n", LongType())]))
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def halved(rows: DataFrame) -> DataFrame:
    """Each row under both keys that the next cut gives it. rows: word, n, longer, _head, _tail, _open.

    A key holds what a word shares with all of its group: its first code points (_head), its last ones (_tail), and how many are open between
    in the shorter words (_open); the longer ones have one more.
    """
    first, last = F.floor(F.col("_open") / 2).cast("int"), F.ceil(F.col("_open") / 2).cast("int")
    until = F.length("word") - F.length("_tail")
    head = F.struct(F.substring(F.col("word"), F.lit(1), F.length("_head") + first).alias("_head"), F.col("_tail"), last.alias("_open"))
    tail = F.struct(F.col("_head"), F.substring(F.col("word"), until - last + 1, F.length("_tail") + last).alias("_tail"), first.alias("_open"))
    return rows.select("word", "n", "longer", F.explode(F.array(head, tail)).alias("_key")).select("word", "n", "longer", "_key.*")


def candidates(words: DataFrame, work: Workspace, group: int = GROUP) -> DataFrame:
    """a, b, n_a, n_b: pairs of words (word, n) that share a key; every pair one edit apart is among them. Equally long ones have a < b, else a is the shorter.

    Groups of up to ``group`` words are joined. Larger ones get longer keys as long as two code points are open; what then shares a key differs
    in one or two letters, so a group is bounded by the alphabet.
    """
    key = ["_head", "_tail", "_open"]
    roles = F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")
    none = F.lit("")
    rows = words.select("word", "n", roles).withColumns({"_head": none, "_tail": none, "_open": F.length("word") - F.col("longer").cast("int")})
    rows = work.stage(halved(rows), "keys-0")
    out, turn = None, 0
    while rows is not None:
        large = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.count_if(~F.col("longer")).alias("_short")).where((F.col("_n") > group) & (F.col("_short") > 0) & (F.col("_open") > 1))
        large = work.stage(large.select(*key), f"large-{turn}")
        small = rows.join(large, key, "left_anti")
        a = small.where("not longer").select(*key, F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = small.select(*key, F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
        found = a.join(b, key).where("longer or a < b").select("a", "b", "n_a", "n_b")
        out = found if out is None else out.unionByName(found)
        turn += 1
        rows = None if large.isEmpty() else work.stage(halved(rows.join(large, key, "left_semi")), f"keys-{turn}")
    return out.distinct()


def near(words: DataFrame, work: Workspace, group: int = GROUP) -> DataFrame:
    """The candidates one edit apart, each once."""
    return work.stage(candidates(words, work, group).where(F.levenshtein("a", "b", 1) == 1), "near")


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """word, root of forms (word, form): where the forms lead. Each round doubles the steps; a form is five times as frequent, so chains are short."""
    now = work.stage(forms.select("word", F.col("form").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        now = work.stage(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), f"roots-{turn}")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = LEAST_N, times: int = 5, slips: int | None = SLIPS, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of whole texts that occur at least least_n times, and what each is a variant of.

    form: the most frequent word one edit away (ties: the first in code-point order), if at least ``times`` as frequent as the word, else null; root: where
    forms lead, the word itself if it has none. Null and empty texts have no words, and rows with one id count each. Other columns of docs don't matter.
    An empty table gives no row.
    """
    work = Workspace(docs.sparkSession, "spelling")
    words = work.stage(word_counts(docs, id_col, text_col, slips=slips).where(F.col("n") >= least_n), "words")
    pairs = near(words, work, group)
    side = lambda x, y: pairs.select(F.col(x).alias("word"), F.col(y).alias("_other"), F.col(f"n_{y}").alias("_n"))
    best = side("a", "b").unionByName(side("b", "a")).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(F.negative("_n").alias("less"), "_other")).alias("_best"))
    frequent: Column = -F.col("_best.less") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("_best._other")).alias("form"), F.when(frequent, -F.col("_best.less")).alias("form_n"))
    found = work.stage(found, "forms")
    return found.join(roots(found.where("form IS NOT NULL"), work), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
