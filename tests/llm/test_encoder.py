"""Ids of the shard encoder against the tokenizer itself."""

import json
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm.token_shards import Encoder, encoded, separable

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PICK = random.Random(7)
POINTS = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
TEXTS = (
    [f"a{chr(c)}B {chr(c)}'s x{chr(c)}́ {chr(c)}" for c in range(0x600)]
    + ["".join(chr(c) for c in PICK.choices(POINTS, k=6)) + " W̊ " + "".join(chr(PICK.randrange(0x250)) for _ in range(30)) for _ in range(1500)]
    + ["<|endoftext|>x", "<|ENDOFTEXT|> <|startoftext|>", "W̊ İ it's It'S \x0f\x1c\x1d x\x85y ꟋꟜ", "", " \t\n", "x" * 100 + " " + "y" * 100, "\x0f"]
)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_ids_are_the_tokenizers(path):
    whole = Tokenizer.from_file(path)
    encoder = Encoder(path, max_pieces=300)
    assert list(encoder.encode(TEXTS)) == [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in TEXTS]


def test_which_files_allow_pieces():
    spec = json.load(open(WORD_BPE, encoding="utf-8"))
    assert separable(spec) and not separable(json.load(open(BYTE_BPE, encoding="utf-8")))
    assert not separable(spec | {"normalizer": {"type": "Replace", "pattern": {"String": "a b"}, "content": "c"}})
    assert not separable(spec | {"added_tokens": [{"content": "a b"}]}) and not separable(spec | {"pre_tokenizer": {"type": "Whitespace"}})


def test_another_file_and_clashing_columns(spark):
    rows = [(i, t, "x") for i, t in enumerate(["it's 12 o'clock\n\nnow", None, "\x0f a  b "])]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, _id STRING")
    whole = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: r.n_tokens for r in encoded(docs, BYTE_BPE, end_id=50256).collect()}
    assert got == {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in rows}


@pytest.mark.parametrize("text", ["ab3+" * 1_250_000, "é" * 2_500_000])
def test_five_million_characters_without_white_space(text):
    ids = next(Encoder(WORD_BPE).encode([text]))
    assert len(ids) % 4 == 0 and len(ids) > 4 * 100_000
