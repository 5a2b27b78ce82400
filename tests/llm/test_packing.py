"""Packing: the encoder against the tokenizer, plans against what they must cover, documents against their ids."""

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id LONG, text STRING, source STRING, length STRING, part STRING, _row STRING, ids STRING, `a.b` STRING"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(3)
    alpha = [" "] * 8 + list("abcXYZ019.,;:!?'\"()-\n\t\r\x0b\x0c") + "'s|'ll| '|é|ß|×|中|👍|́| | |\x1c|\x85|​|<|endoftext|>|½|٣|\n\n|  |the|ing|<|endoftext|>".split("|") + ["<|endoftext|>"]
    encoder = packing.ByteEncoder(BPE, max_pieces=500)
    for text in ["".join(rng.choices(alpha, k=rng.randint(0, 25))) for _ in range(8000)]:
        assert next(encoder.encode([text])) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def holds(slots, counts, longest):
    use, cover = defaultdict(list), defaultdict(list)
    for s in slots:
        for i in range(s.n):
            use[s.sequence + i].append((s.at, s.size))
            cover[s.length, s.first + i].append((s.cut, s.size))
    gapless = lambda parts: all(a == sum(n for _, n in sorted(parts)[:i]) for i, (a, _) in enumerate(sorted(parts)))
    assert sorted(use) == list(range(len(use))) and all(gapless(x) and sum(n for _, n in x) <= longest for x in use.values())
    assert set(cover) == {(k, i) for k, n in counts.items() for i in range(n)} and all(gapless(x) and sum(n for _, n in x) == k for (k, _), x in cover.items())
    filled = [sum(n for _, n in x) for x in use.values()]
    return sum(longest - n for n in filled if n & (n - 1)) / max(sum(filled), 1), len(use)


@pytest.mark.parametrize("seed", range(60))
def test_plans_cover_each_piece_once(seed):
    rng = random.Random(seed)
    longest = rng.choice([8, 16, 64, 100, 1024])
    counts = {rng.randint(1, longest): rng.randint(1, 10 ** rng.randint(0, 3)) for _ in range(rng.randint(0, 60))}
    padding = rng.choice([0, 0.005, 0.1])
    padded, _ = holds(packing.shortest_pack_first(counts, longest, padding), counts, longest)
    assert padded * sum(k * n for k, n in counts.items()) <= padding * sum(k * n for k, n in counts.items()) + longest


def test_a_hot_length_is_cut_and_others_stay_whole():
    counts = {700: 5000, 513: 300, 60: 10}
    slots = packing.shortest_pack_first(counts)
    assert holds(slots, counts, 1024)[0] <= 0.006 and any(s.size < s.length for s in slots)
    assert [s.size for s in packing.shortest_pack_first({600: 10, 424: 10})] == [600, 424]
    assert [(s.at, s.n) for s in packing.shortest_pack_first({1024: 7})] == [(0, 7)]
    big = packing.shortest_pack_first({k: 10**12 for k in range(1, 1025)})
    assert len(big) < 10_000 and sum(s.size * s.n for s in big) == 10**12 * 1024 * 1025 // 2


def rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices(["the", "of", "ing", "é", "ation", "x"], k=rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(int(rng.expovariate(1 / 250)))) for _ in range(150)] + [" ".join(word() for _ in range(9000))]
    hot = " ".join(word() for _ in range(300))
    return list(enumerate(texts + [None, "", " \n ", "<|endoftext|> x"])) + [(500 + i, hot) for i in range(120)] + [(3, texts[3]), (3, texts[3]), (None, "no id"), (None, None)]


def test_documents_lie_in_sequences(spark, tokenizer):
    own = rows()
    docs = spark.createDataFrame([(d, t, "s", "l", "p", "r", "i", "x") for d, t in own], SCHEMA).repartition(5)
    placed, kept = packing.packed(docs, BPE)
    placed = placed.cache()
    found = placed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for s in by_sequence.values():
        assert [a for a, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    expected = defaultdict(list)
    for d, t in own:
        expected[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    read = {r.sequence_id: list(r.ids) for r in packing.sequences(placed, kept).collect()}
    for r in found:
        by_doc[r.doc_id].append((r.start, read[r.sequence_id][r.offset : r.offset + r.length], r.ids_crc32, r.doc_tokens))
    assert by_doc.keys() == expected.keys()
    for d, parts in by_doc.items():
        assert all(zlib.crc32(array("I", ids).tobytes()) == crc for _, ids, crc, _ in parts)
        whole = [x for ids in expected[d] for x in ids]
        assert sorted(x for _, ids, _, _ in parts for x in ids) == sorted(whole) and {n for *_, n in parts} == {len(x) for x in expected[d]}
        if len(expected[d]) == 1:
            assert [x for _, ids, _, _ in sorted(parts, key=lambda p: p[0]) for x in ids] == whole
            assert [s for s, *_ in sorted(parts, key=lambda p: p[0])] == [sum(len(y) for _, y, _, _ in sorted(parts, key=lambda p: p[0])[:i]) for i in range(len(parts))]
    total = sum(len(x) for v in expected.values() for x in v)
    assert len(by_sequence) * 1024 <= 1.01 * total + 1024


def test_no_documents(spark):
    placed, kept = packing.packed(spark.createDataFrame([], SCHEMA), BPE)
    assert placed.count() == 0 and packing.sequences(placed, kept).count() == 0
