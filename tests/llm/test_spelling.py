"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from strandline.llm import spelling
from strandline.llm.common import Workspace

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id LONG, text STRING, word STRING, n STRING, _head STRING, `a.b` STRING"


def counts(rows, slips=199):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if slips and h % slips == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += len(run) >= 6
    return {w: n for w, n in out.items() if n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, slips=199, least=5):
    words = {w: n for w, n in counts(rows, slips).items() if n >= least}
    form, near = {}, {}
    for w, n in words.items():
        others = [o for o in words if one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words.get(form[w])))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abßéÉZ×"
    base = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(25)]
    def vary(w):
        k, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
    words = [(w, rng.choice([200, 40, 9])) for w in base] + [(vary(w), rng.choice([30, 6, 5, 4])) for w in base for _ in range(6)]
    words += [(vary(vary(w)), 5) for w in base]
    words += [("chainabé", 260), ("chainab", 50), ("chainb", 6), ("chainabé×", 7)]
    tokens = [w for w, n in words for _ in range(n)]
    rng.shuffle(tokens)
    rows = [(i, rng.choice([" ", ", ", "\n", "1"]).join(tokens[i * 50 : i * 50 + 50])) for i in range(len(tokens) // 50 + 1)]
    return rows + [(900, None), (901, ""), (None, "someword " * 7), (902, "q" * 5000 + " " + "short run"), rows[0], rows[0]]


@pytest.mark.parametrize("group", [32, 2])
def test_variants_equal_all_pairs(spark, group):
    for seed in (1, 2) if group > 2 else (3,):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "w", "n", "h", "x") for d, t in rows], SCHEMA).repartition(3)
        found = spelling.variants(docs, group=group)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        want = expected(rows)
        assert {tuple(r) for r in found.collect()} == want and any(w[2] not in (w[0], w[1]) for w in want) and any(w[1] for w in want)


def test_words_that_share_halves_are_not_all_paired(spark):
    rng = random.Random(4)
    words = sorted({"prefix" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(1500)} | {"".join(rng.choices("abcdefgh", k=6)) + "suffix" for _ in range(1500)})
    table = spark.createDataFrame([(w, 5) for w in words], "word STRING, n LONG")
    pairs = {(r.a, r.b) for r in spelling.near(table, Workspace(spark, "t")).collect()}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    assert pairs == {(a, b) for v in holes.values() for a in v for b in v if a < b}
    assert spelling.candidates(table, Workspace(spark, "t")).count() < 40 * len(words)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(1, "lonely words here", "w", "n", "h", "x")], SCHEMA)
    assert spelling.variants(few).count() == 0
    assert [tuple(r) for r in spelling.variants(few, least_n=1, slips=None).orderBy("word").collect()] == [("lonely", None, "lonely", 1, 0, None)]
