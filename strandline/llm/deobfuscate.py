"""Toxicity scores of texts restored by a noisy-channel decoder.

Writers hide words by leetspeak ("1d10t"), spacing ("i d i o t", "i-d-i-o-t") and repetition ("idiiiot"). Each suspicious piece of
text is a lattice: every written character may stand for letters (at a cost), for nothing, or for itself. A Viterbi search finds
the letters that the channel and a character trigram model, counted over the texts, together make likeliest. Pieces that are
plain words have one path and stay. The restored words' presence, whole and as n-grams of characters, is scored by a
logistic model fitted on a bounded sample of labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from strandline.llm.common import Workspace, labelled_rows

#: What a written character may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, SYMBOLS = 0, 27, 28  # of the character model: the word's edge, a to z, any other letter
SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)} | {" ": EDGE}
#: Costs of the channel, in nats.
COST = {"leet": 0.7, "drop_mark": 9.0, "keep_mark": 12.0, "repeat": 0.7, "join": 0.2, "break": 1.0}
SPACED = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")
JOINED = re.compile(r"(?:[^\W_][.\-_*~]+){2,}[^\W_]$")
INNER = re.compile(r"[a-z][.\-_*~]+[a-z]")
# Pieces may be of any length, so each pattern takes time in proportion to it.
LETTER = re.compile(r"[a-z]")
MARK = re.compile(r"[0134567890@$!|+€£(*]")
TRIPLE = re.compile(r"([a-z])\1\1")
DOUBLE = re.compile(r"([a-z])\1")
WORDS = re.compile(r"[^\W\d_]+")
TRIM = "\"'“”‘’«»()[]{}<>.,;:?!…%#&=|"


def classes(text: str) -> np.ndarray:
    """The symbol of each character: a to z, another letter, or an edge for the rest."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes - np.uint32(96)
    out = np.where((low >= 1) & (low <= 26), low, np.where(codes >= 0xC0, OTHER, EDGE))
    return out.astype(np.int64)


def trigrams(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b over all texts; a table of SYMBOLS ** 3, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch["text"]:
                s = classes(text or "")
                keep = np.ones(len(s), bool)
                keep[1:] = (s[1:] != EDGE) | (s[:-1] != EDGE)
                s = np.concatenate([[EDGE, EDGE], s[keep], [EDGE]])
                total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"code": used, "n": total[used]})

    n = np.zeros(SYMBOLS**3)
    for r in docs.select(F.col(text_col).alias("text")).mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        n[r["code"]] = r["n"]
    n = n.reshape((SYMBOLS,) * 3)
    pair = n.sum(axis=0)
    single = pair.sum(axis=0) + 1.0
    p1 = single / single.sum()
    p2 = (pair + 5 * p1) / (pair.sum(axis=1, keepdims=True) + 5)
    return np.log((n + 5 * p2) / (n.sum(axis=2, keepdims=True) + 5))


# ---------------------------------------------------------------- the decoder


def emissions(piece: str) -> Iterator[list[tuple[str, float]]]:
    """For each written character what it may stand for, with its cost. "" is nothing, " " an edge."""
    for i, c in enumerate(piece):
        options: dict[str, float] = {}
        if c in LETTERS or c.isalpha():
            options[c] = 0.0
            if i and piece[i - 1] == c:
                options[""] = COST["repeat"] if i < 2 or piece[i - 2] != c else 0.0
        elif c == " ":
            options = {"": COST["join"], " ": COST["break"]}
        elif c in LEET:
            options = {x: COST["leet"] for x in LEET[c]} | {"": COST["drop_mark"]}
            if i and piece[i - 1] == c:
                options[""] = COST["repeat"]
            if c.isdigit():
                options[c] = COST["keep_mark"]
        else:
            options = {"": COST["join"], " ": COST["break"]}
        yield list(options.items())


def decode(piece: str, log_p: np.ndarray) -> str:
    """The likeliest letters behind a piece in lower case, in one pass whatever its length."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}  # with the letters so far, the last one first
    for options in emissions(piece):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in states.items():
            for c, cost in options:
                if not c or (c == " " and b == EDGE):
                    key, value = (a, b), (score - cost, text)
                else:
                    s = SYMBOL.get(c, OTHER)
                    key, value = (b, s), (score - cost + log_p[a, b, s], (text, c))
                if key not in after or value[0] > after[key][0]:
                    after[key] = value
        states = after
    text = max(((score + log_p[a, b, EDGE], text) for (a, b), (score, text) in states.items()), key=lambda x: x[0])[1]
    out = []
    while text:
        text, c = text
        out.append(c)
    return "".join(reversed(out))


def suspicious(piece: str) -> bool:
    """Whether a piece in lower case could hide a word."""
    return len(piece) > 2 and bool(LETTER.search(piece) and MARK.search(piece) or TRIPLE.search(piece) or len(DOUBLE.findall(piece)) > 1 or JOINED.match(piece))


def lettered(piece: str) -> bool:
    """Whether a third or more of a piece is letters; of others the decoded word has to be likely."""
    return sum(c.isalpha() for c in piece) * 3 >= len(piece)


def likely(word: str, log_p: np.ndarray) -> bool:
    """Whether the character model holds a decoded word for likelier than letters drawn evenly."""
    s = [EDGE, EDGE, *(SYMBOL.get(c, OTHER) for c in word), EDGE]
    return len(word) > 2 and sum(log_p[x] for x in zip(s, s[1:], s[2:])) > -math.log(27) * (len(s) - 2)


def restored_piece(piece: str, log_p: np.ndarray) -> str:
    """A piece between white space, in lower case, as it is or decoded."""
    core = piece.strip(TRIM)
    if suspicious(core):
        word = decode(core, log_p)
        if lettered(core):
            return word
        if likely(word, log_p):
            return f"{core} {word}"
    if INNER.search(core):  # a hyphen or a mark that splits a word
        return f"{core} {decode(core, log_p)}"
    if core != piece and suspicious(wide := piece.rstrip(".,;:?")):  # marks at its ends may be letters
        word = decode(wide, log_p)
        if lettered(wide) or likely(word, log_p):
            return f"{core} {word}"
    return core


def restored(text: str | None, log_p: np.ndarray) -> str:
    """The text in lower case with its suspicious pieces decoded; white space is not kept."""
    low = (text or "").lower()
    out = [restored_piece(p, log_p) for p in low.split()]
    return " ".join([*out, *spaced(low, log_p)])


def spaced(low: str, log_p: np.ndarray) -> list[str]:
    """Decoded runs of single characters with white space between, each in one pass."""
    return [decode(" ".join(m[0].split()), log_p) for m in SPACED.finditer(low)]


# ---------------------------------------------------------------- the score


@dataclass(frozen=True)
class ToxicityParams:
    rows_per_class: int = 4000  # labelled rows that are drawn, by a hash of the id
    bytes_per_class: int = 24 << 20
    features: int = 600  # size of the model: those with most evidence, of twelve times as many that are compared
    least_rows: int = 5  # of the sample that a feature occurs in
    evidence: float = 30.0  # least G-squared; there are millions of n-grams, some look telling by chance
    ridge: float = 0.02
    seed: int = 2


@dataclass
class ToxicityModel:
    log_p: np.ndarray
    weights: dict[str, float]
    constant: float
    cache: dict[str, frozenset[str]] = field(default_factory=dict, repr=False)

    def of_piece(self, piece: str) -> frozenset[str]:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            found = self.cache[piece] = frozenset(f for f in features_of(restored_piece(piece, self.log_p)) if f in self.weights)
        return found

    def present(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        pieces = low.split()
        out: set[str] = set().union(*map(self.of_piece, set(pieces)))
        if sum(map((1).__eq__, map(len, pieces))) > 3:
            for run in spaced(low, self.log_p):
                out |= {f for f in features_of(run) if f in self.weights}
        return out

    def score(self, text: str | None) -> float:
        z = self.constant + sum(map(self.weights.__getitem__, self.present(text)))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def features_of(restored_text: str) -> set[str]:
    """Words, and their n-grams of 4 to 6 characters, edges included."""
    out: set[str] = set()
    for w in WORDS.findall(restored_text):
        s = f" {w} "
        out.add(s)
        for n in (4, 5, 6):
            out.update(s[i : i + n] for i in range(len(s) - n + 1))
    return out


def signed_g2(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Twice the log likelihood ratio of a of n1 against b of n0 rows; below 0 if the second share is larger."""
    share = (a + b) / (n1 + n0)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    both = term(a, share * n1) + term(b, share * n0) + term(n1 - a, (1 - share) * n1) + term(n0 - b, (1 - share) * n0)
    return 2 * both * F.when(a / n1 >= b / n0, 1).otherwise(-1)


def chosen(counts: list, n: int) -> list[str]:
    """The n features with most evidence; of features that say the same about one word the longest."""
    kept: list[str] = []
    by_counts: dict[tuple[int, int], list[str]] = {}
    for r in sorted(counts, key=lambda r: (-abs(r["g2"]), -len(r["feature"]), r["feature"])):
        same = by_counts.setdefault((r["a"], r["b"]), [])
        if not any(r["feature"] in other for other in same):
            same.append(r["feature"])
            kept.append(r["feature"])
    return kept[:n]


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """The model from the labels of rows for training; the characters are counted over all texts for training.

    Labels besides 0 and 1 don't count; of ids labelled twice the higher label counts. Without labelled texts of both classes every
    score is the share of label 1, 0.5 if there is none.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    log_p = trigrams(docs.where(train), text_col)
    rows, totals = labelled_rows(docs, labels.where(train), id_col, text_col, label_col, params.rows_per_class, params.bytes_per_class, params.seed)
    rows = work.stage(rows.select("y", "text").repartition(24), "sample")
    drawn = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(drawn) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return ToxicityModel(log_p, {}, 0.0 if not totals else 30.0 if share else -30.0)
    shared = spark.sparkContext.broadcast(log_p)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, text in zip(batch["y"], batch["text"]):
                own[y].update(features_of(restored(text, shared.value)))
        names = list(own[0].keys() | own[1].keys())
        yield pd.DataFrame({"feature": names, "a": [own[1][x] for x in names], "b": [own[0][x] for x in names]})

    counts = rows.mapInPandas(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g2 = signed_g2(F.col("a"), F.col("b"), drawn[1], drawn[0])
    best = counts.where(F.col("a") + F.col("b") >= params.least_rows).withColumn("g2", g2).where(F.col("g2") > params.evidence).orderBy(F.desc("g2"), "feature").limit(params.features * 12)
    names = chosen(best.collect(), params.features)
    finder = spark.sparkContext.broadcast(ToxicityModel(log_p, dict.fromkeys(names, 1.0), 0.0))
    place = {x: i for i, x in enumerate(names)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "has": [sorted(place[f] for f in finder.value.present(t)) for t in batch["text"]]})

    sample = rows.mapInPandas(present, "y int, has array<int>").collect()  # at most 2 * rows_per_class rows
    x = np.zeros((len(sample), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(sample):
        x[i, r["has"]] = 1
    y = np.array([r["y"] for r in sample])
    weights = np.where(y == 1, totals[1] / drawn[1], totals[0] / drawn[0])
    w = logistic(x, y, weights * len(y) / weights.sum(), params.ridge)
    return ToxicityModel(log_p, dict(zip(names, w[:-1].tolist())), float(w[-1]))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method; the last input, the constant, is free of the ridge."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weights * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out, a double from 0 to 1, higher for likelier toxic. Null and empty texts get the score of a text without
    any feature. Every row gives one row; a column of the name out is replaced, other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in text], dtype="float64")

    return docs.withColumn(out, score(F.col(text_col)))
