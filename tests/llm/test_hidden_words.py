"""Hidden words of any length and form in the decoder of op2."""

import random
import time

import pytest

from strandline.llm import deobfuscate

WORDS = "the river ran past old stone houses toward a quiet market town where people met and talked about the weather you are such stupid idiot moron".split()


@pytest.fixture(scope="module")
def log_p(spark):
    pick = random.Random(2)
    docs = spark.createDataFrame([(" ".join(pick.choices(WORDS, k=200)),) for _ in range(60)], "text STRING")
    return deobfuscate.trigrams(docs, "text")


@pytest.mark.parametrize("shift", range(8))
def test_a_long_spaced_run_has_no_seams(log_p, shift):
    letters = "a" * (shift % 2) + "theriverranpastoldstonehousestowardaquiet"[shift:] + "stupid" + "townwherepeoplemet"
    assert "stupid" in deobfuscate.spaced(" ".join(letters), log_p)[0].replace(" ", "")


def test_long_chains_and_repeats(log_p):
    chain = deobfuscate.restored("y.o.u.a.r.e.s.u.c.h.a.s.t.u.p.i.d.i.d.i.o.t", log_p).replace(" ", "")
    assert "stupid" in chain and "idiot" in chain
    assert "stupid" in deobfuscate.restored("st" + "u" * 40 + "pid", log_p).split()
    assert " stup" in deobfuscate.features_of("stupid" + "x" * 40)


def test_heavy_leet_is_decided_by_the_model(log_p):
    assert "idiot" in deobfuscate.restored("you 1d107 you", log_p).split()
    assert deobfuscate.restored("x9386", log_p) == "x9386"


@pytest.mark.parametrize("gap", ["\t", "  ", "\n", "  "])
def test_any_white_space_between_letters(log_p, gap):
    assert "stupid" in deobfuscate.restored(gap.join("stupid"), log_p).split()


def test_time_is_in_proportion_to_the_length(log_p):
    began = time.time()
    for text in ("abcde" * 40_000, "_" * 40_000 + "é;é", "a1" * 10_000, " ".join("stupid" * 3_000)):
        deobfuscate.restored(text, log_p)
    assert time.time() - began < 60


def costs(piece, log_p):
    """Every reading of a piece: (cost, letters)."""
    readings = [(0.0, "")]
    for options in deobfuscate.emissions(piece):
        readings = [(cost + own, text if c == " " and (not text or text.endswith(" ")) else text + c) for cost, text in readings for c, own in options]
    for cost, text in readings:
        s = [deobfuscate.EDGE, deobfuscate.EDGE, *(deobfuscate.SYMBOL.get(c, deobfuscate.OTHER) for c in text), deobfuscate.EDGE]
        yield cost - sum(log_p[x] for x in zip(s, s[1:], s[2:])), text


@pytest.mark.parametrize("piece", ["m0r0n", "1d1ot", "s-t-u", "stuuupd", "$tup1d", "m o r", "a!!b", "4(3"])
def test_viterbi_finds_the_best_of_all_readings(log_p, piece):
    all_readings = list(costs(piece, log_p))
    best = min(all_readings)[0]
    found = deobfuscate.decode(piece, log_p)
    assert abs(min(c for c, t in all_readings if t == found) - best) < 1e-9
