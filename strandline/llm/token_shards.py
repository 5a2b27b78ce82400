"""Token-id shards with Elias-Fano document boundaries.

A shard is one row of a Parquet file, so Spark's commit protocol makes it whole or absent:
``ids`` holds the concatenated ids of its documents as little-endian 16- or 32-bit integers, and the
document ends are an increasing sequence in Elias-Fano form: the low bits packed, the high bits as
a unary bit vector with the place of every SELECT_STEP-th one bit sampled, so that select(i) reads a few
bytes. That takes about 2 + log2(mean length) bits a document in place of 64.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from strandline.llm.common import Workspace, bounded_batches

SELECT_STEP = 64
SHARD_TOKENS = 1 << 20  # a shard is closed once it has as many; a longer document makes a longer shard


# ---------------------------------------------------------------- Elias-Fano


def ef_encode(ends: np.ndarray) -> dict:
    """ends: increasing, the last is the universe."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    ends = ends.astype(np.uint64)
    low = ((ends[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (ends >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
    high[ones] = 1
    return {"ef_bits": bits, "ef_low": np.packbits(low.ravel(), bitorder="little").tobytes(), "ef_high": np.packbits(high, bitorder="little").tobytes(), "ef_select": ones[::SELECT_STEP].astype("<u4").tobytes()}


def ef_select(i: int, ef_bits: int, ef_low: bytes, ef_high: bytes, ef_select: bytes) -> int:
    """The i-th end (from 0), read from the samples on."""
    at = int(np.frombuffer(ef_select, "<u4", 1, 4 * (i // SELECT_STEP))[0])
    left = i % SELECT_STEP
    byte = at // 8
    current = ef_high[byte] >> (at % 8) << (at % 8)
    while (have := current.bit_count()) <= left:
        left -= have
        byte += 1
        current = ef_high[byte]
    for _ in range(left):
        current &= current - 1
    one = 8 * byte + (current & -current).bit_length() - 1
    first = i * ef_bits
    word = int.from_bytes(ef_low[first // 8 : (first + ef_bits + 7) // 8], "little") >> (first % 8)
    return (one - i) << ef_bits | (word & ((1 << ef_bits) - 1))


def ef_decode(n: int, ef_bits: int, ef_low: bytes, ef_high: bytes) -> np.ndarray:
    """All ends at once."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(ef_high, np.uint8), bitorder="little"))[:n]
    low = np.unpackbits(np.frombuffer(ef_low, np.uint8), count=n * ef_bits, bitorder="little").reshape(n, ef_bits).astype(np.int64)
    return ((ones - np.arange(n)) << ef_bits) + (low << np.arange(ef_bits)).sum(axis=1)


# ---------------------------------------------------------------- tokens


def separable(spec: dict) -> bool:
    """Whether a tokenizer file gives a text the ids of its pieces between ASCII white space, one after the other: it never looks
    across white space (canonical composition and letter case don't), drops it, and no added token holds or eats any. Such a split
    also parts an ASCII letter or digit from the marks after it; no added token may end with one of those."""
    parts = lambda key, inner: (spec.get(key) or {}).get(inner) or [spec.get(key) or {}]
    normal = all(
        n.get("type") in ("NFC", "Lowercase") or (n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " ") for n in parts("normalizer", "normalizers")
    )
    first, *rest = parts("pre_tokenizer", "pretokenizers")
    # Alternatives of the split: letters, numbers, what is neither, or a mark with letters.
    wanted = re.split(r"\|(?![^\[]*\])", first.get("pattern", {}).get("Regex", " "))
    solid = all(re.fullmatch(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+?", x) for x in wanted)
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and solid
    within = all(r.get("type") == "ByteLevel" and not r.get("add_prefix_space") and not r.get("use_regex", True) for r in rest)
    added = all(not x.get("lstrip") and not x.get("rstrip") and not x.get("single_word") and not re.search(r"\s|[.,;:!?#$%&*]$", x["content"]) for x in spec.get("added_tokens", []))
    return normal and split and within and added and spec.get("truncation") is None


class Encoder:
    """Ids of texts by a tokenizer file. All ids come from the tokenizer itself; where its rules allow (separable), it is asked once for
    each piece between ASCII white space, in place of each text. Of those seen lately, up to twice ``max_pieces`` are remembered."""

    #: Small letters of Latin-1. Of a text of them alone the tokenizer makes one word, letter by letter: plain_letters() makes sure of it.
    LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    REMEMBERED = 64  # bytes; longer pieces hardly occur again
    MARKS = b".,;:!?#$%&*"
    ENDS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def __init__(self, path: str, max_pieces: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = separable(spec)
        # Where letter case is dropped, pieces are shared in lower case (of ASCII), unless an added token could arise or a letter stands
        # before a combining mark of U+0300 to U+037F, with which it could compose in one case only.
        lower = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}]))
        self.added = tuple(x["content"].encode().lower() for x in spec.get("added_tokens", [])) if lower else (b"",)
        # A control character that stands between pieces has an id that no other text has.
        mark = self.ids_of(["\x01"])[0]
        self.mark = mark if self.by_piece and len(mark) == 4 and self.ids_of(["\x01 \x01"])[0] == 2 * mark else b""
        self.plain = self.plain_letters() if self.by_piece else {}
        self.is_plain = re.compile(f"[{''.join(map(chr, self.plain))}]+" if self.plain else "(?!)").fullmatch
        self.model = self.tokenizer.model
        self.max_pieces = max_pieces
        self.ids: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def plain_letters(self) -> dict[int, str]:
        """What the tokenizer's model sees for each of LETTERS. Empty unless its normaliser leaves every pair of them as it is and its
        splitter leaves it whole, so that words of them can be handed to the model at once."""
        t = self.tokenizer
        seen = {c: t.pre_tokenizer.pre_tokenize_str(c) for c in self.LETTERS}
        if any(len(x) != 1 for x in seen.values()):
            return {}
        for a in self.LETTERS:
            for b in self.LETTERS:
                whole = t.pre_tokenizer.pre_tokenize_str(a + b)
                if (t.normalizer and t.normalizer.normalize_str(a + b) != a + b) or [x for x, _ in whole] != [seen[a][0][0] + seen[b][0][0]]:
                    return {}
        return {ord(c): x[0][0] for c, x in seen.items()}

    def ids_of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; those of plain letters by the tokenizer's model, the others by the tokenizer."""
        out: list[bytes | None] = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            if self.is_plain(word := piece.decode("utf-8", "replace")):
                out[i] = array("I", [t.id for t in self.model.tokenize(word if piece.isascii() else word.translate(self.plain))]).tobytes()
            else:
                rest.append(i)
        for i, ids in zip(rest, self.ids_of_texts([pieces[i] for i in rest])):
            out[i] = ids
        return out

    def ids_of_texts(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; as one text of all, which is quicker, if none holds the mark."""
        if not self.mark or len(pieces) < 2 or any(b"\x01" in x for x in pieces):
            return self.ids_of([x.decode("utf-8", "replace") for x in pieces])
        ids = np.array(self.tokenizer.encode_batch_fast([b" \x01 ".join(pieces).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * np.flatnonzero(ids == int.from_bytes(self.mark, "little"))
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as 32-bit integers, little-endian as all platforms that Spark runs Python on."""
        for text in texts:
            if not self.by_piece:
                yield self.ids_of([text])[0]
                continue
            raw = text.encode("utf-8", "surrogatepass")
            low = raw.lower()
            if b"\xcc" not in raw and b"\xcd" not in raw and not any(x in low for x in self.added):
                raw = low
            pieces = raw.split()
            if len(self.ids) > self.max_pieces:
                self.before, self.ids = self.ids, {}
            known, before = self.ids, self.before
            found = list(map(known.get, pieces))
            gaps = [i for i, x in enumerate(found) if x is None] if None in found else []
            missing = {pieces[i] for i in gaps}
            own = {x: before[x] for x in missing if x in before}
            new = [x for x in missing if x not in own]
            # What ends in marks after a letter or digit, as the word and its marks.
            cut = {x: core for x in new if (core := x.rstrip(self.MARKS)) != x and core and core[-1] in self.ENDS}
            own.update((c, before[c]) for c in cut.values() if c not in known and c in before)
            asked = {c for x in new for c in ((cut[x], x[len(cut[x]) :]) if x in cut else (x,)) if c not in known and c not in own}
            own.update(zip(asked, self.ids_of_pieces(list(asked))))
            own.update((x, b"".join([own[y] if y in own else known[y] for y in (c, x[len(c) :])])) for x, c in cut.items())
            if own:
                for i in gaps:
                    found[i] = own[pieces[i]]
                known.update(own if max(map(len, own)) <= self.REMEMBERED else {x: ids for x, ids in own.items() if len(x) <= self.REMEMBERED})
            yield b"".join(found)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a Python worker, which share what it remembers."""
    return Encoder(path)


# ---------------------------------------------------------------- shards


def _schema(name: str, kind: DataType, ddl: str) -> StructType:
    return StructType([StructField(name, kind), *StructType.fromDDL(ddl).fields])


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None, name: str = "shards") -> DataFrame:
    """Tokenizes whole texts (null: empty), appends end_id to each and writes the shards in ascending id order; the shard table.

    Null ids come first; rows with equal ids stand next to each other, in the order of a hash of the text and then the text, and may be
    dealt over several parts. Every row is a document.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "tokens")
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType
    schema = _schema("doc_ids", ArrayType(id_type), "part int, seq int, n_docs long, n_tokens long, id_bytes int, ids binary, ef_bits int, ef_low binary, ef_high binary, ef_select binary")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        wide = max(encoder.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        chunks: list[bytes] = []
        ends: list[int] = []
        total = 0

        def shard() -> pd.DataFrame:
            ids = b"".join(chunks)
            row = {"doc_ids": doc_ids, "part": part, "seq": seq, "n_docs": len(ends), "n_tokens": total, "id_bytes": 4 if wide else 2}
            row["ids"] = ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
            return pd.DataFrame([row | ef_encode(np.array(ends))])

        for batch in batches:
            keys = [None if x is None or x != x else x for x in batch["_id"].tolist()]
            for key, ids in zip(keys, encoder.encode([x or "" for x in batch["_text"]])):
                doc_ids.append(key)
                chunks += ids, end
                total += len(ids) // 4 + 1
                ends.append(total)
                if total >= SHARD_TOKENS:
                    yield shard()
                    doc_ids, chunks, ends, total, seq = [], [], [], 0, seq + 1
        if ends:
            yield shard()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_order"))
    rows = rows.repartitionByRange("_id", "_order").sortWithinPartitions("_id", "_order", "_text").drop("_order")
    return work.stage(rows.mapInPandas(build, schema), name, **{"parquet.block.size": str(16 << 20)})


def placed(shards: DataFrame) -> DataFrame:
    """The shards with _base, the ids of all shards before. Parts are summed first, so one task sees a row per part, not per shard."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    base = parts.select(F.col("part").alias("_part"), (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    within = shards.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("_within"))
    within = within.join(base, F.col("part") == F.col("_part")).select("part", "seq", (F.col("_base") + F.col("_within")).alias("_base"))
    return within


def read_documents(shards: DataFrame) -> DataFrame:
    """A row per document, from the files: its id, start (ids of all documents before), n_tokens and ids_crc32."""
    id_type = shards.schema["doc_ids"].dataType.elementType
    schema = _schema("doc_id", id_type, "part int, seq int, _start long, n_tokens long, ids_crc32 long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                ends = ef_decode(s.n_docs, s.ef_bits, s.ef_low, s.ef_high)
                starts = np.concatenate([[0], ends[:-1]])
                ids = memoryview(np.frombuffer(s.ids, f"<u{s.id_bytes}").astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                keys = pd.Series(list(s.doc_ids), dtype=object)
                yield pd.DataFrame({"doc_id": keys, "part": s.part, "seq": s.seq, "_start": starts, "n_tokens": ends - starts, "ids_crc32": crc})

    rows = shards.mapInPandas(read, schema)
    out = rows.join(placed(shards.select("part", "seq", "n_tokens")), ["part", "seq"])
    return out.select("doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def fetch(shards: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<long>, the end id last) of the documents named in wanted: two selects each, without decoding their shards' other ends."""
    id_type = shards.schema["doc_ids"].dataType.elementType
    at = shards.select("part", "seq", F.posexplode("doc_ids").alias("place", "_doc")).join(wanted.select(F.col(id_col).alias("_want")).distinct(), F.col("_doc") == F.col("_want"), "left_semi")
    places = at.groupBy("part", "seq").agg(F.collect_list(F.struct("place", "_doc")).alias("_found"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                coded = {"ef_bits": s.ef_bits, "ef_low": s.ef_low, "ef_high": s.ef_high, "ef_select": s.ef_select}
                ids = np.frombuffer(s.ids, f"<u{s.id_bytes}")
                rows = [(f["_doc"], ids[ef_select(f["place"] - 1, **coded) if f["place"] else 0 : ef_select(f["place"], **coded)].astype(np.int64).tolist()) for f in s.found]
                yield pd.DataFrame({"doc_id": pd.Series([r[0] for r in rows], dtype=object), "ids": [r[1] for r in rows]})

    rows = shards.drop("doc_ids").join(places, ["part", "seq"]).withColumnRenamed("_found", "found")
    return rows.mapInPandas(read, StructType([StructField("doc_id", id_type), StructField("ids", ArrayType(LongType()))])).withColumnRenamed("doc_id", id_col)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs and reads them back: read_documents of write_shards. An empty table gives no shard and no row."""
    return read_documents(write_shards(docs, tokenizer, end_id, id_col, text_col)).withColumnRenamed("doc_id", id_col)
