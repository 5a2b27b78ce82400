"""Packing documents into training sequences, shortest pack first over the histogram of lengths.

A document's ids are cut every LONGEST; what remains is a shorter piece. How many pieces there are of each length is all that the plan needs: a
table of LONGEST counts, whatever the corpus. Lengths are placed from the longest down, each into the packs that have most space; many equal
pieces go into many equal packs in one step, so a step handles ranges: of pieces of one length by their rank, and of sequences by their
number. Where equal lengths leave too much open, the emptiest packs are taken apart and their pieces cut to fill the others. The plan is a few
thousand ranges; each piece finds its own by its length and rank.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from strandline.llm.common import Workspace, bounded_batches

LONGEST = 1024
PADDING = 0.005  # of all ids; above, packs are taken apart


# ---------------------------------------------------------------- ids


TOKEN_ID = attrgetter("id")


class ByteEncoder(dict):
    """Ids of texts by a tokenizer file: a table from pieces of text to their ids, which asks the tokenizer for what it lacks.

    Byte-level splitting takes a space with what follows it, leaves other white space alone, and looks ahead at white space only; so a text's ids are those
    of its pieces: a run without white space, with the space before it; the rest of white space before such a run, its last mark alone; white space at the
    end. It also parts an ASCII letter or digit from the marks after it. Where the file has other rules, or a text white space beyond ASCII or the text of an
    added token, the text goes to the tokenizer whole. At most ``max_pieces`` are remembered, and what a text adds; then the table starts anew.
    """

    PIECE = re.compile(rb" ?[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]")
    OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
    MARKS = b".,;:!?"
    ENDS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    REMEMBERED = 64  # bytes
    #: Letters of Latin-1 after at most one space: one word to the splitter, so the tokenizer's model can be asked at once.
    PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

    def __init__(self, path: str, max_pieces: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        spec = json.loads(open(path, encoding="utf-8").read())
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not any(spec.get(x) for x in ("normalizer", "post_processor", "truncation"))
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.plain = self.tokenizer.model, self.PLAIN.fullmatch
        # What the model sees for each byte that plain words have.
        seen = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
        self.letters = {b: x for c in (" ", *map(chr, range(0xC0, 0x100))) for b, x in zip(c.encode(), seen(c))} if self.by_piece else {}
        self.max_pieces = max_pieces

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        word = piece[1:] if piece[0] == 32 else piece
        if word.isalpha():  # ASCII letters
            ids = self.of_word((self.letters[32] if word is not piece else "") + word.decode())
        elif piece[-1] in self.MARKS and (core := piece.rstrip(self.MARKS)) and core[-1] in self.ENDS:
            ids = self[core] + self[piece[len(core) :]]
        elif self.plain(piece):
            ids = self.of_word(piece.decode("latin-1").translate(self.letters))
        else:
            ids = self.whole(piece.decode())
        if len(piece) <= self.REMEMBERED:
            self[piece] = ids
        return ids

    def of_word(self, word: str) -> bytes:
        return array("I", map(TOKEN_ID, self.model.tokenize(word))).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as 32-bit integers, little-endian."""
        for text in texts:
            if not self.by_piece or any(x in text for x in self.added) or self.OTHER_SPACE.search(text):
                yield self.whole(text)
                continue
            if len(self) > self.max_pieces:
                self.clear()
            yield b"".join(map(self.__getitem__, self.PIECE.findall(text.encode())))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> ByteEncoder:
    """One for all tasks of a Python worker, which share what it remembers."""
    return ByteEncoder(path)


# ---------------------------------------------------------------- plan


@dataclass(frozen=True)
class Slot:
    """Of the pieces of ``length``, those of ranks first to first + n - 1 lie with their ids from ``cut`` on, ``size`` of them, at ``at`` of the sequences from ``sequence`` on, one in each."""

    length: int
    first: int
    n: int
    cut: int
    size: int
    sequence: int
    at: int


def shortest_pack_first(counts: dict[int, int], longest: int = LONGEST, padding: float = PADDING) -> list[Slot]:
    """Places counts[length] pieces of each length. Each rank of a length is covered by slots that don't overlap; sequences are numbered from 0.

    Pieces stay whole unless more than ``padding`` of all ids would be padded. A sequence of a power of two ids isn't padded.
    """
    slots: list[Slot] = []
    packs: dict[int, list[tuple[int, int]]] = {}  # by space left: (first sequence, how many)
    spaces: list[int] = []  # a heap of their negatives
    made = 0

    def leave(space: int, first: int, n: int) -> None:
        if space not in packs:
            packs[space] = []
            heapq.heappush(spaces, -space)
        packs[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if spaces and -spaces[0] >= length:
                space = -spaces[0]
                first, n = packs[space].pop()
                if not packs[space]:
                    del packs[space]
                    heapq.heappop(spaces)
            else:
                space, first, n = longest, made, left
                made += left
            take = min(n, left)
            if take < n:
                leave(space, first + take, n - take)
            slots.append(Slot(length, rank, take, 0, length, first, longest - space))
            leave(space - length, first, take)
            rank, left = rank + take, left - take
    total = sum(length * n for length, n in counts.items())
    loose = sorted(((space, first, n) for space in packs for first, n in packs[space] if space and (longest - space) & (longest - space - 1)), reverse=True)
    open_ids = sum(space * n for space, _, n in loose)
    surplus = min(open_ids // longest, math.ceil((open_ids - padding * total) / longest))
    return _filled(slots, loose, surplus, longest) if surplus > 0 else slots


def _split(slots: list[Slot], ranges: list[tuple[int, int]]) -> tuple[list[Slot], list[Slot]]:
    """Slots within the ranges of sequences (first, n), which don't overlap, and those outside; the sequences outside are numbered anew, without gaps."""
    ranges = sorted(ranges)
    starts = [a for a, _ in ranges]
    gone = np.concatenate([[0], np.cumsum([n for _, n in ranges])]).tolist()
    inside, outside = [], []
    for s in slots:
        at, end = s.sequence, s.sequence + s.n
        i = int(np.searchsorted(starts, at, "right"))
        while at < end:
            if i and at < sum(ranges[i - 1]):
                upto = min(end, sum(ranges[i - 1]))
                inside.append(replace(s, first=s.first + at - s.sequence, n=upto - at, sequence=at))
            else:
                upto = min(end, starts[i]) if i < len(starts) else end
                outside.append(replace(s, first=s.first + at - s.sequence, n=upto - at, sequence=at - gone[i]))
            at = upto
            i += i < len(starts) and at >= starts[i]
    return inside, outside


def _filled(slots: list[Slot], loose: list[tuple[int, int, int]], surplus: int, longest: int) -> list[Slot]:
    """The plan without the ``surplus`` emptiest packs (space, first, n; the emptiest first), whose pieces are cut to fill the next emptiest."""
    apart, targets, left = [], [], surplus
    for space, first, n in loose:
        take = min(n, left)
        if take:
            apart.append((first, take))
        if n > take:
            targets.append((space, first + take, n - take))
        left -= take
    order = sorted(apart)
    starts, gone = [a for a, _ in order], np.concatenate([[0], np.cumsum([n for _, n in order])]).tolist()
    free, out = _split(slots, apart)
    # Heaps of the packs with most space and of the longest pieces.
    targets = [(-space, first - gone[int(np.searchsorted(starts, first, "right"))], n) for space, first, n in targets]
    stock = [(-s.size, s.length, s.first, s.n, s.cut) for s in free]
    heapq.heapify(targets)
    heapq.heapify(stock)
    while stock:
        size, length, first, n, cut = heapq.heappop(stock)
        space, sequence, packs = heapq.heappop(targets)
        take, part = min(n, packs), min(-size, -space)
        out.append(Slot(length, first, take, cut, part, sequence, longest + space))
        if n > take:
            heapq.heappush(stock, (size, length, first + take, n - take, cut))
        if packs > take:
            heapq.heappush(targets, (space, sequence + take, packs - take))
        if -size > part:
            heapq.heappush(stock, (size + part, length, first, take, cut + part))
        if -space > part:
            heapq.heappush(targets, (space + part, sequence, take))
    return out


# ---------------------------------------------------------------- documents


PIECES = "start long, length int, doc_tokens long, ids_crc32 long, ids binary, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, work: Workspace, end_id: int = 0, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of whole texts (null: empty), each with end_id at its end, cut every ``longest``: _id, start, length, doc_tokens, ids_crc32, ids, part, nth, _row.

    ids are 32-bit integers, little-endian; nth counts the pieces of one length in a part of the input, so ranks need no sort.
    """
    bounded_batches(docs.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seen, part = encoder_of(tokenizer), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, rows = [], []
            for key, ids in zip(batch["_id"].tolist(), encoder.encode([x or "" for x in batch["_text"]])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, longest):
                    own = ids[4 * start : 4 * (start + longest)]
                    length = len(own) // 4
                    keys.append(None if key is None or key != key else key)
                    rows.append((start, length, total, zlib.crc32(own), own, part, seen[length]))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["start", "length", "doc_tokens", "ids_crc32", "ids", "part", "nth"])
            out.insert(0, "_id", pd.Series(keys, dtype=object))
            yield out

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = StructType([StructField("_id", docs.schema[id_col].dataType), *StructType.fromDDL(PIECES).fields])
    return work.stage(rows.mapInPandas(build, schema).withColumn("_row", F.monotonically_increasing_id()), "pieces")


@pandas_udf(LongType())
def crc_of(ids: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([zlib.crc32(x[4 * a : 4 * (a + n)]) for x, a, n in zip(ids, start, size)], dtype="int64")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = LONGEST, padding: float = PADDING, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Where each piece lies: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, with _row and cut, the row of pieces() and where in it; and those pieces.

    Every id of a document lies in one piece; sequences are gapless from offset 0 and hold at most ``longest`` ids. Null and empty texts are a piece with the end
    id alone. Rows with one id, repeated or null, are documents of their own. Other columns of docs don't matter. An empty table gives no row.
    """
    work = Workspace(docs.sparkSession, "packing")
    rows = pieces(docs, tokenizer, work, end_id, longest, id_col, text_col)
    counts = work.stage(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``longest`` rows
    slots = shortest_pack_first(histogram, longest, padding)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = rows.drop("ids").join(base, ["length", "part"]).withColumn("_rank", F.col("_base") + F.col("nth"))
    plan = docs.sparkSession.createDataFrame([(s.length, s.first, s.n, s.cut, s.size, s.sequence, s.at) for s in slots], "length int, _first long, _n long, cut int, _size int, _sequence long, _at int")
    # A plan is made of ranges over ``longest`` lengths, however many pieces there are.
    found = ranked.join(F.broadcast(plan), "length").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n")))
    found = found.select(
        F.col("_id"), (F.col("start") + F.col("cut")).alias("start"), F.col("_size").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"),
        F.col("_at").cast("long").alias("offset"), "_row", "cut", (F.col("_size") < F.col("length")).alias("_torn"),
    )
    if any(s.size < s.length for s in slots):
        found = work.stage(found, "found")
        torn = found.where("_torn").drop("ids_crc32").join(rows.select("_row", "ids"), "_row").withColumn("ids_crc32", crc_of("ids", "cut", "length"))
        found = found.where("NOT _torn").unionByName(torn.drop("ids"))
    return found.drop("_torn").withColumnRenamed("_id", id_col), rows


def sequences(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """sequence_id, ids (array<int>): the sequences themselves, not padded, of what packed() returns."""
    parts = placed.join(rows.select("_row", "ids"), "_row").select("sequence_id", "offset", F.substring("ids", 4 * F.col("cut") + 1, (4 * F.col("length")).cast("int")).alias("ids"))
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    @pandas_udf("array<int>")
    def joined(x: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(p["ids"] for p in y), "<i4") for y in x])

    return whole.select("sequence_id", joined("parts").alias("ids"))
