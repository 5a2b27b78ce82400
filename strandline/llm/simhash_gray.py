"""SimHash near-duplicates through a hierarchical index in Gray order.

The 64 bits are cut into blocks, ``bits`` + 1 of them while there are few fingerprints, more when there are many. Fingerprints that
differ in at most ``bits`` bits agree on all but ``bits`` blocks, so for one choice of the other blocks they fall into one group of the
top level: those with equal bits in the chosen blocks. Four copies of a fingerprint are enough up to about 2 ** 28 of them, ten to 2 ** 37.

Each group is sorted by Gray rank, in which neighbours share long bit patterns. Leaves, and groups of leaves above them, factor
out the bits that all their members share, as (mask, value). Two nodes are compared only if the differences that their
patterns accumulate are at most ``bits``: first larger nodes, then leaves, then fingerprints.

A comparison yields a spanning forest of its links, at most one row per fingerprint, so that thousands of near copies don't
give all their pairs; connected components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from strandline.llm.common import BYTES_LOWER, Workspace, bounded_batches

BITS = 3
SEED = 42
SHINGLE = 3
GROUP = 4096  # fingerprints that a group holds, about
LEAF, FAN = 32, 16  # fingerprints in a leaf, leaves in a node above


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; 0 for a text without words. A text of fewer words than a shingle has one shingle of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(BYTES_LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return digest(join(words), seed)
    grams = zip(*(words[i:] for i in range(shingle)))
    hashes = np.array([digest(join(g), seed) for g in grams], np.uint64)
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


@pandas_udf(LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], np.uint64).view(np.int64))


def gray_rank(code: Column) -> Column:
    """Where code stands in Gray order, as a long that sorts so."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


# ---------------------------------------------------------------- comparison of two groups


def patterns(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, value) of each run of ``size`` codes: the bits that all share, and those bits."""
    at = np.arange(0, len(codes), size)
    every, some = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
    return ~(every ^ some), every


def near_nodes(a: tuple, b: tuple, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes whose shared patterns differ in at most ``bits`` bits."""
    differ = (a[1][:, None] ^ b[1][None, :]) & a[0][:, None] & b[0][None, :]
    return np.nonzero(np.bitwise_count(differ) <= bits)


def padded(codes: np.ndarray) -> np.ndarray:
    """Codes in whole leaves, filled up with the last one."""
    return np.concatenate([codes, np.repeat(codes[-1:], -len(codes) % LEAF)]).reshape(-1, LEAF)


def links(a: np.ndarray, b: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) at most ``bits`` apart, in batches."""
    upper = LEAF * FAN
    pa, pb = patterns(a, LEAF), patterns(b, LEAF)
    la, lb = padded(a), padded(b)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in zip(*near_nodes(patterns(a, upper), patterns(b, upper), bits)):
        sa, sb = slice(i * FAN, (i + 1) * FAN), slice(j * FAN, (j + 1) * FAN)
        x, y = near_nodes((pa[0][sa], pa[1][sa]), (pb[0][sb], pb[1][sb]), bits)
        leaves.append((x + i * FAN, y + j * FAN))
    if not leaves:
        return
    x, y = (np.concatenate(k) for k in zip(*leaves))
    for part in range(0, len(x), 256):
        xs, ys = x[part : part + 256], y[part : part + 256]
        p, i, j = np.nonzero(np.bitwise_count(la[xs][:, :, None] ^ lb[ys][:, None, :]) <= bits)
        if len(p):
            yield np.minimum(xs[p] * LEAF + i, len(a) - 1), np.minimum(ys[p] * LEAF + j, len(b) - 1)


def forest(n: int, edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each node's component."""
    root = np.arange(n)
    for i, j in edges:
        while True:
            ri, rj = root[i], root[j]
            if not len(open_ := np.flatnonzero(ri != rj)):
                break
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while len(np.flatnonzero((up := root[root]) != root)):
                root = up
    return root


def compare_groups(batches: Iterator[pd.DataFrame], bits: int = BITS) -> Iterator[pd.DataFrame]:
    """Rows (a, b: arrays of codes in Gray order, same: whether they are one group) to rows (u, v) that link them."""
    for batch in batches:
        for same, a, b in zip(batch["same"], batch["a"], batch["b"]):
            a = np.asarray(a, np.int64)
            codes = a if same else np.concatenate([a, np.asarray(b, np.int64)])
            own, other = a.view(np.uint64), codes.view(np.uint64)[0 if same else len(a) :]
            shift = 0 if same else len(a)
            root = forest(len(codes), ((i, j + shift) for i, j in links(own, other, bits)))
            moved = np.flatnonzero(root != np.arange(len(codes)))
            if len(moved):
                yield pd.DataFrame({"u": codes[moved], "v": codes[root[moved]]})


def masks(n: int, bits: int, group: int) -> list[int]:
    """The bits on which groups of about ``group`` of n fingerprints agree: one mask for each choice of all but ``bits`` blocks."""
    k = max(0, (max(1, n) // group).bit_length())
    blocks = next((m for m in range(bits + 1, 64) if 64 // m * (m - bits) >= k), 63)
    size, chosen = 64 // blocks, blocks - bits
    k = min(k, size * chosen)
    # k bits, dealt over the chosen blocks as evenly as they go
    widths = [k // chosen + (i < k % chosen) for i in range(chosen)]
    return sorted({sum(((1 << w) - 1) << size * block for block, w in zip(choice, widths)) for choice in combinations(range(blocks), chosen)})


def near_pairs(codes: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """u, v: links that connect all codes (column fp, distinct, staged) within ``bits`` bits of each other."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(codes.count(), bits, group)]
    rows = codes.select("fp", F.explode(F.array(*map(F.lit, signed)).cast("array<long>")).alias("mask"))
    rows = rows.withColumn("node", F.col("fp").bitwiseAND(F.col("mask")))
    # Groups much larger than planned are dealt into parts, each of which meets the others.
    sizes = rows.groupBy("mask", "node").count().where("count > 1")
    sizes = sizes.select(F.col("mask").alias("_mask"), F.col("node").alias("_node"), F.ceil(F.col("count") / (2 * group)).alias("parts"))
    dealt = rows.join(sizes, (F.col("mask") == F.col("_mask")) & (F.col("node") == F.col("_node"))).withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    ranked = F.sort_array(F.collect_list(F.struct(gray_rank(F.col("fp")).alias("rank"), "fp")))["fp"]
    groups = dealt.groupBy("mask", "node", "part", "parts").agg(ranked.alias("codes"))
    alone = groups.where("parts = 1").select(F.lit(True).alias("same"), F.col("codes").alias("a"), F.array().cast("array<long>").alias("b"))
    split = groups.where("parts > 1")
    left = split.select("mask", "node", "part", F.col("codes").alias("a"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("other"))
    right = split.select("mask", "node", F.col("part").alias("other"), F.col("codes").alias("b"))
    pairs = left.join(right, ["mask", "node", "other"]).select((F.col("part") == F.col("other")).alias("same"), "a", "b")
    return alone.union(pairs).mapInPandas(lambda batches: compare_groups(batches, bits), "u long, v long")


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """node, root: the smallest node of each component of the edges (u, v). Alternating large-star and small-star steps;
    each step's edges are written, so that a lost executor costs one step. A hub's rows are pre-aggregated and joined, not gathered."""
    current = work.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state, step = None, 0
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.stage(large.where("u <> v").distinct(), f"{name}-{step}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("_u").alias("u"), F.col("m").alias("v")))
        after = work.stage(small.where("u <> v").distinct(), f"{name}-{step + 1}")
        work.drop(f"{name}-{step}-large")
        work.drop(f"{name}-{step}")
        step += 1
        current = after
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """A row per row of docs: its id, _fp (a signed 64-bit fingerprint) and _component, the smallest id it is linked to, itself included.

    Null or empty texts have fingerprint 0 and link like any other; rows that repeat have equal fingerprints. A null id is
    larger than all others: a component of null ids alone has a null _component. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "simhash")
    bounded_batches(docs.sparkSession)
    rows = work.stage(docs.select(F.col(id_col).alias("_id"), fingerprints(F.col(text_col)).alias("_fp")), "rows")
    codes = work.stage(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("first")), "codes")
    roots = components(near_pairs(codes.select("fp"), bits), work)
    named = codes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = work.stage(named, "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("_component")).select(F.col("root").alias("_root"), "_component")
    by_code = named.join(smallest, F.col("root") == F.col("_root")).select("fp", "_component")
    return rows.join(by_code, F.col("_fp") == F.col("fp")).select(F.col("_id").alias(id_col), "_fp", "_component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One document of each component, that of the smallest id; of rows that share this id, the one with the smallest text.

    Rows without an id go if they are linked to one with an id; of the others one stays for each fingerprint.
    """
    rows = near_duplicates(docs, id_col, text_col, bits)
    named = rows.where(F.col(id_col) == F.col("_component")).select(F.col(id_col).alias("_kept")).distinct()
    # Whatever the columns of docs are called, they travel as one.
    whole = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    kept = whole.join(named, F.col("_id") == F.col("_kept"), "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("_text")))
    alone = rows.where(F.col("_component").isNull()).select(F.col("_fp").alias("_kept")).distinct()
    nameless = whole.where(F.col("_id").isNull()).withColumn("_fp", fingerprints(F.col("_text"))).join(alone, F.col("_fp") == F.col("_kept"), "left_semi")
    nameless = nameless.withColumn("_n", F.row_number().over(Window.partitionBy("_fp").orderBy("_text")))
    first = kept.select("_row", "_n").union(nameless.select("_row", "_n")).where("_n = 1")
    return first.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
