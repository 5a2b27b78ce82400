"""Quality rules that clean lines first and then judge the document by what is left.

Each line that has a word is tested for symbols, navigation, boilerplate and
missing punctuation. Lines that fail are removed. A document is rejected if it
is too short or repeats itself (the base rules), or if the removed lines held
more than ``max_removed`` of its word characters.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "cookie settings",
    "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled", "click here to",
    "sign up for our newsletter", "subscribe to our", "lorem ipsum", "powered by wordpress", "licensed under",
    "share this article", "share this page", "share this post", "skip to content", "skip to main content",
)
#: A mark that ends a sentence, in the scripts that the rules know, then closing marks, at the end of a word.
STOPPED = re.compile(r"[.!?…。！？؟।][\"'”’»›)\]}*_]*(?:\s|$)")
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, removed_chars long, n_removed_lines long, cleaned string"
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_share: float = 0.1  # of a line's word characters
    min_separators: int = 3  # of "|" alone between entries
    max_separator_share: float = 0.2  # of a line's words
    short_line_words: int = 8  # a shorter line without any sentence stop is a caption or a menu entry
    max_removed: float = 0.5


def solid(text: str) -> int:
    """Code points that aren't one of the six ASCII white-space characters."""
    return len(text) - sum(map(text.count, SPACE))


def line_fails(line: str, n_chars: int, phrases: list[str], rules: LineRules) -> bool:
    """Whether a line with n_chars word characters goes. phrases: the boilerplate that its text has anywhere."""
    if not STOPPED.search(line) and len(line.encode("utf-8", "surrogatepass").split()) < rules.short_line_words:
        return True
    if any(x in line for x in SYMBOLS) and sum(map(line.count, SYMBOLS)) > rules.max_symbol_share * n_chars:
        return True
    if "|" in line:
        words = line.encode("utf-8", "surrogatepass").split()
        if (n := words.count(b"|")) >= rules.min_separators and n >= rules.max_separator_share * len(words):
            return True
    return bool(phrases) and any(x in low for low in [line.lower()] for x in phrases)


def judge(text: str | None, rules: LineRules) -> tuple:
    """The row of RESULT for one text; a null text is empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = solid(text)
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = covered = 0
    if len(set(windows)) < len(windows):
        again = {w for w, n in Counter(windows).items() if n > 1}
        for i in [i for i, w in enumerate(windows) if w in again]:
            n_repeat += i + 3 - max(i, covered)
            covered = i + 3
    seen: set[str] = set()
    n_dup = removed = n_removed = 0
    kept_lines = []
    low = text.lower()
    phrases = [x for x in BOILERPLATE if x in low]
    for line in text.split("\n"):
        if n_chars := solid(line):
            if line in seen:
                n_dup += 1
            seen.add(line)
            if line_fails(line, n_chars, phrases, rules):
                removed += n_chars
                n_removed += 1
                continue
        kept_lines.append(line)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and removed <= rules.max_removed * word_chars
    cleaned = "\n".join(kept_lines) if n_removed else text
    return n_words, word_chars, sum(map(text.count, SYMBOLS)), n_dup, n_repeat, base_failed, kept, removed, n_removed, cleaned


def judged(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), out: str = "line_rules") -> DataFrame:
    """docs with one more column ``out``, a struct of RESULT. ``cleaned`` is the text without the lines that failed.

    Every row gives one row, whatever repeats; a null or empty text has no words, fails the base rules
    and is cleaned to an empty text. An earlier column of the name ``out`` is replaced; other columns stay.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]

    @pandas_udf(RESULT)
    def apply(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(x, rules) for x in text], columns=names)

    # Called non-deterministic so that a filter on its result doesn't make Spark work it out twice.
    return docs.withColumn(out, apply.asNondeterministic()(F.col(text_col)))


def keep_clean(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, with their cleaned texts and the lengths of these in n_chars, where there is such a column, in the columns of docs, whatever
    their names. A null or empty text has too few words and goes; repeated rows are judged alike, each for itself; a null id stays one. An empty table gives no row.
    """
    others = [c for c in docs.columns if c not in (text_col, "n_chars")]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others))).alias("_row")
    rows = judged(docs.select(row, F.col(f"`{text_col}`").alias("_text")), "_text", rules, "_rules").where("_rules.kept")
    cleaned = F.col("_rules.cleaned")
    new = {c: F.col(f"_row._{i}") for i, c in enumerate(others)} | {text_col: cleaned}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(cleaned).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new[c].alias(c) for c in docs.columns))
