"""The pipeline against brute force, stage by stage."""

import math
import random
import struct
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
import reference as ref

import corpus_pipeline
from strandline.llm import line_rules


def fixture(tmp_path, spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("the of nd er ing th an re on ti".split(), k=rng.randint(1, 4))) for _ in range(400)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(9, 20))).capitalize() + "."
    texts = ["\n".join(line() for _ in range(rng.randint(3, 12))) for _ in range(50)]
    bench = " ".join(rng.choices(words, k=25))
    texts += [texts[1], texts[2] + "\nHome | About | Us | More", f"{texts[4]}\n{bench.capitalize()}.", "short", "", None, "a | b | c | d | e\n" * 30]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, bench)], "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    return [(r[0], r[1], r[3]) for r in rows], [(0, bench)]


def mix_key(doc_id):
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 1), 42)
    h = xxhash.xxh64_intdigest(str(doc_id).encode(), seed)
    return h - (1 << 64) if h >> 63 else h


def copies(rows):
    """How often each document is taken: whole epochs, and in the last those before the cut, the one at it if half of it fits."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(ref.WORD.findall(t))
    out = Counter()
    for s, target in ref.targets(sizes).items():
        budget = math.floor(target + 1e-9)
        left = budget - budget // sizes[s] * sizes[s]
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: mix_key(r[0])):
            n = len(ref.WORD.findall(t))
            part = max(0, min(n, left))
            left -= n
            out[d] = budget // sizes[s] + (2 * part >= n)
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    rows, bench = fixture(tmp_path, spark)
    rules = line_rules.LineRules()
    kept = [(d, r[9], s) for d, t, s in rows if (r := line_rules.judge(t, rules))[6]]
    first = {c for _, _, c in ref.groups([(d, t) for d, t, _ in kept])}
    alone = [r for r in kept if r[0] in first]
    hit = {d for d, _, n, _ in ref.contamination([(d, t) for d, t, _ in alone], bench) if n}
    clean = [r for r in alone if r[0] not in hit]
    assert len(rows) > len(kept) > len(alone) > len(clean) > 40
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, [kept, alone, clean]):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((d, t) for d, t, _ in want), name
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    times = copies(clean)
    assert Counter(r.doc_id for r in mixed.collect()) == +times
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, Counter()
    for d, t, _ in sorted(clean):
        for _ in range(times[d]):
            ids = [*full.encode(t, add_special_tokens=False).ids, 1]
            want[(d, start, len(ids), ref.crc(ids))] += 1
            start += len(ids)
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_registered_queries(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
