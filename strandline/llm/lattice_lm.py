"""Language-model scores from subword lattices.

An existing vocabulary gives the pieces; a word's probability is the sum over all its segmentations into pieces, by a forward
recursion in log space. Pieces start a word or continue it, never cross it, so the lattice of a text falls apart into those of
its words: a word's marginal is worked out once, however often it occurs. Bytes are pieces too, so every text has a
probability, and the probabilities of all words sum to one. ``score`` is that of the pieces alone: each word's marginal and the
chance that the text goes on, then the chance that it ends.

The vocabulary file's scores are merge ranks. They only set the start (Zipf's law on the rank); expectation-maximisation over
all training words, by their counts, makes them probabilities of this corpus.

``mixed_score`` has one edge more across the whole lattice of a word that training texts hold, with its count less a discount; the mass
of the discounts is what the pieces' edges share: P(word) = (max(c - d, 0) + d * V * marginal(word)) / N, and P(end) = c(end) / N.

Words seen often (more than 1 in ``1 / FREQUENT`` tokens, so at most that many of them) are sent to all tasks; a text's
other words are joined by shuffle, so no table that grows with the corpus is broadcast.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BYTES_LOWER, Workspace, bounded_batches

FREQUENT = 5e-6
SHARED_BYTES = 256  # of a word that is sent to all tasks
LONG = 1024  # bytes; longer words are walked one by one, in memory that is a few numbers for each byte
ROUNDS = 4
END = b""  # the end of a text in the table of words; no word is empty
START = b" "  # stands before a word, as the vocabulary's word mark
PRIOR = 0.05  # added to each piece's count, so that none has probability 0


# ---------------------------------------------------------------- the vocabulary


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[bytes, ...]:
    """Surfaces of the pieces of a sentencepiece file by rank: those of one word, and all single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    seen: dict[bytes, None] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            surface = sp.id_to_piece(i).replace("▁", " ").encode().translate(BYTES_LOWER)
            if b" " not in surface[1:]:
                seen.setdefault(surface)
    for b in range(256):
        seen.setdefault(bytes([b]))
    return tuple(seen)


class Lattice:
    """The pieces as a trie of arrays, walked for all words of one length at once."""

    def __init__(self, surfaces: tuple[bytes, ...]):
        self.size = len(surfaces)
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, surface in enumerate(surfaces):
            node = 0
            for byte in surface:
                if (below := children[node].get(byte)) is None:
                    below = children[node][byte] = len(children)
                    children.append({})
                    piece.append(-1)
                node = below
            piece[node] = i
        self.children, self.pieces = children, piece
        self.piece = np.array(piece, np.int32)
        self.below = np.zeros((len(children), 256), np.int32)  # 0: no such piece
        for node, own in enumerate(children):
            self.below[node, list(own)] = list(own.values())

    def edges(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) for words (an array of bytes, a row per word), by start."""
        m, length = words.shape
        for start in range(length):
            rows, nodes = np.arange(m), np.zeros(m, np.int32)
            for end in range(start + 1, length + 1):
                nodes = self.below[nodes, words[rows, end - 1]]
                alive = nodes > 0
                if not alive.all():
                    rows, nodes = rows[alive], nodes[alive]
                if not len(rows):
                    break
                own = self.piece[nodes]
                some = own >= 0
                yield (start, end, rows, own) if some.all() else (start, end, rows[some], own[some])

    def forward(self, words: np.ndarray, log_p: np.ndarray, edges: list | None = None) -> np.ndarray:
        """Log marginals up to each place; a row per place."""
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for start, end, rows, own in self.edges(words):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + log_p[own])
            if edges is not None:
                edges.append((start, end, rows, own))
        return alpha

    def edges_from(self, word: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of a word's pieces from start on."""
        node, children, pieces = 0, self.children, self.pieces
        for end in range(start, len(word)):
            node = children[node].get(word[end])
            if node is None:
                return
            if pieces[node] >= 0:
                yield end + 1, pieces[node]

    def forward_long(self, word: bytes, log_p: list[float]) -> array:
        """Log marginals up to each place of one word."""
        alpha = array("d", [-math.inf]) * (len(word) + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for start in range(len(word)):
            own = alpha[start]
            for end, piece in self.edges_from(word, start):
                x, y = own + log_p[piece], alpha[end]
                alpha[end] = (x + log1p(exp(y - x)) if y > -math.inf else x) if x >= y else y + log1p(exp(x - y))
        return alpha

    def expected_long(self, word: bytes, log_p: list[float], out: np.ndarray, weight: float) -> None:
        """Adds to out what expected() gives for one word."""
        alpha = self.forward_long(word, log_p)
        beta = array("d", bytes(8)) * (len(word) + 1)
        exp, log, total = math.exp, math.log, alpha[-1]
        counts: Counter = Counter()
        for start in range(len(word) - 1, -1, -1):
            through = [(log_p[piece] + beta[end], piece) for end, piece in self.edges_from(word, start)]
            top = max(x for x, _ in through)
            beta[start] = top + log(sum(exp(x - top) for x, _ in through))
            before = alpha[start] - total
            for x, piece in through:
                counts[piece] += exp(before + x)
        out[list(counts)] += weight * np.fromiter(counts.values(), float, len(counts))

    def expected(self, words: np.ndarray, log_p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations, each word as often as its weight."""
        edges: list = []
        alpha = self.forward(words, log_p, edges)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        out = np.zeros(self.size)
        for start, end, rows, own in reversed(edges):
            through = log_p[own] + beta[end, rows]
            out += np.bincount(own, weights[rows] * np.exp(alpha[start, rows] + through - alpha[-1, rows]), self.size)
            beta[start, rows] = np.logaddexp(beta[start, rows], through)
        return out


@lru_cache(maxsize=2)
def lattice_of(vocabulary: str) -> Lattice:
    return Lattice(pieces(vocabulary))


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, array of bytes) of the words of up to LONG bytes, each after START, in groups of one length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes[sizes <= LONG]):
        rows = np.flatnonzero(sizes == n)
        step = max(1, 1_000_000 // (int(n) + 1))
        for part in range(0, len(rows), step):
            own = rows[part : part + step]
            yield own, np.frombuffer(b"".join(START + words[i] for i in own), np.uint8).reshape(len(own), int(n) + 1)


def log_marginals(lattice: Lattice, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
    """Natural logs of the words' probabilities."""
    out = np.zeros(len(words))
    for rows, group in by_length(words):
        out[rows] = lattice.forward(group, log_p)[-1]
    own = log_p.tolist()
    for i, word in enumerate(words):
        if len(word) > LONG:
            out[i] = lattice.forward_long(START + word, own)[-1]
    return out


# ---------------------------------------------------------------- on Spark


def start_probabilities(n: int) -> np.ndarray:
    p = 1 / (np.arange(n) + 100.0)
    return np.log(p / p.sum())


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES_LOWER).split()


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """word (binary), n: the occurrences in training rows, 0 for words of other rows only; END counts the training rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Counter = Counter()
        other: set = set()
        for batch in batches:
            for text, use in zip(batch["text"], batch["train"]):
                words = split_words(text)
                if use:
                    own.update(words)
                    own[END] += 1
                else:
                    other.update(words)
            if len(own) + len(other) > 200_000:
                yield emit(own, other)
                own, other = Counter(), set()
        yield emit(own, other)

    def emit(own: Counter, other: set) -> pd.DataFrame:
        rest = [w for w in other if w not in own]
        return pd.DataFrame({"word": [*own, *rest], "n": [*own.values(), *[0] * len(rest)]}).astype({"n": "int64"})

    rows = docs.select(F.col(text_col).alias("text"), train.alias("train"))
    return rows.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, by expectation-maximisation over all training words of (word, n), staged, each n times.

    Each round sends the pieces' probabilities out and one sum per piece back, both bounded by the vocabulary.
    """
    spark = words.sparkSession
    n_pieces = len(pieces(vocabulary))
    log_p = start_probabilities(n_pieces)
    known = words.where("n > 0 and octet_length(word) > 0").select("word", "n")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lattice, total = lattice_of(vocabulary), np.zeros(n_pieces)
            for batch in batches:
                own, n = batch["word"].tolist(), batch["n"].to_numpy(float)
                for rows, group in by_length(own):
                    total += lattice.expected(group, shared.value, n[rows])
                for word, times in zip(own, n):
                    if len(word) > LONG:
                        lattice.expected_long(START + word, shared.value.tolist(), total, times)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"piece": used, "n": total[used]})

        sums = np.full(n_pieces, PRIOR)
        for r in known.mapInPandas(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row per piece at most
            sums[r["piece"]] += r["n"]
        log_p = np.log(sums / sums.sum())
    return log_p


def discount(words: DataFrame) -> tuple[int, int, int, float]:
    """Tokens N, distinct tokens V, ends, and the discount n1 / (n1 + 2 * n2) of staged word counts."""
    some = lambda c: F.sum(F.when(c, 1).otherwise(0))
    is_word = F.octet_length("word") > 0
    r = words.agg(F.sum("n").alias("n"), some(F.col("n") > 0).alias("v"), F.sum(F.when(~is_word, F.col("n"))).alias("e"), some(is_word & (F.col("n") == 1)).alias("n1"), some(is_word & (F.col("n") == 2)).alias("n2")).first()
    n1, n2 = r["n1"] or 0, r["n2"] or 0
    return r["n"] or 0, r["v"] or 0, r["e"] or 0, min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def scores(docs: DataFrame, vocabulary: str, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: its id, held_out (not train), n_tokens, n_known, train_tokens, base_score, score, mixed_score and score_per_token.

    score is the log10 probability of the whole text by its lattices of pieces, mixed_score that with the edges of known words, base_score
    that of its words and end by add-0.1 counts; score_per_token is score over n_tokens.
    Null and empty texts are their end alone. Rows that repeat are counted each, in training as in the result. If no row is for
    training, the pieces keep the start's probabilities, every word is unknown and an end has probability 0.01. A null in train
    counts as false. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lattice")
    bounded_batches(spark, rows=1000, mb=16)
    train = F.coalesce(train, F.lit(False))
    words = work.stage(word_counts(docs, text_col, train), "words")
    bounded_batches(spark, rows=100_000, mb=8)  # words are short, and arrays of many are scored at once
    n, v, ends, d = discount(words)
    log_p = fit(words, vocabulary)
    shared = spark.sparkContext.broadcast(log_p)
    scale = math.log10(n + 0.1 * (v + 1)) if n else -1.0
    n_words = v - (ends > 0)
    free = d * n_words / n if n and ends else 0.99  # the pieces' mass

    p_end = min(ends / n, 0.999) if ends else 0.01
    end = (float(ends > 0), math.log10(ends + 0.1) - scale, math.log10(ends / n if ends else 0.01), math.log10(p_end))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = lattice_of(vocabulary)
        for batch in batches:
            own = batch["word"].tolist()
            c = batch["n"].to_numpy(float)
            whole = np.maximum(c - d, 0) / max(n, 1)
            lattices = log_marginals(lattice, own, shared.value)
            batch["lattice"] = (lattices + math.log1p(-p_end)) / math.log(10)
            with np.errstate(divide="ignore"):
                batch["mixed"] = np.logaddexp(np.log(whole), lattices + math.log(free)) / math.log(10)
            batch.loc[[w == END for w in own], ["mixed", "lattice"]] = end[2:]
            batch["base"] = np.log10(c + 0.1) - scale
            yield batch

    marked = work.stage(words.mapInPandas(mark, "word binary, n long, lattice double, mixed double, base double"), "marked")
    work.drop("words")
    # At most 1 / FREQUENT words can be this frequent; longer ones, such as texts without white space, are joined like the rare ones.
    top = marked.where((F.col("n") >= max(1, FREQUENT * n)) & (F.octet_length("word") <= SHARED_BYTES)).collect()
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): (float(r["n"] > 0), r["base"], r["mixed"], r["lattice"]) for r in top} | {END: end})

    def per_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_words = frequent.value
        for batch in batches:
            ids, sizes, known, base, mixed, score, rare = [], [], [], [], [], [], []
            for rid, text in zip(batch["rid"], batch["text"]):
                own = Counter(split_words(text))
                k, b, m, s = known_words[END]
                left = []
                for w, times in own.items():
                    if (x := known_words.get(w)) is not None:
                        k += times * x[0]
                        b += times * x[1]
                        m += times * x[2]
                        s += times * x[3]
                    else:
                        left.append({"word": w, "times": times})
                ids.append(rid)
                sizes.append(own.total() + 1)
                known.append(int(k))
                base.append(b)
                mixed.append(m)
                score.append(s)
                rare.append(left)
            yield pd.DataFrame({"rid": ids, "id": batch["id"], "train": batch["train"], "n_tokens": sizes, "k": known, "b": base, "m": mixed, "s": score, "rare": rare})

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = rows.mapInPandas(per_text, f"rid long, id {kind}, train boolean, n_tokens long, k long, b double, m double, s double, rare array<struct<word:binary,times:long>>")
    bounded_batches(spark, rows=1000, mb=16)
    texts = work.stage(texts, "texts")
    pairs = texts.select("rid", F.explode("rare").alias("x")).select("rid", "x.word", F.col("x.times").alias("times"))
    joined = pairs.join(marked, "word")
    sums = joined.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(F.col("times") * F.col("base")).alias("b2"), F.sum(F.col("times") * F.col("mixed")).alias("m2"), F.sum(F.col("times") * F.col("lattice")).alias("s2")
    ).withColumnRenamed("rid", "_rid")
    out = texts.drop("rare").join(sums, F.col("rid") == F.col("_rid"), "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return out.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", plus("k", "k2", 0).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("b", "b2", 0.0).alias("base_score"), plus("s", "s2", 0.0).alias("score"),
        plus("m", "m2", 0.0).alias("mixed_score"), (plus("s", "s2", 0.0) / F.col("n_tokens")).alias("score_per_token"),
    )
