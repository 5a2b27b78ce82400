"""Entity resolution: candidate pairs within blocks, capped selection, sequential merging, thresholds."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from strandline.sources.staging import Steps

TILE = 512


def _compared(met: DataFrame, keys: list[str], sides: tuple[str, str], compare: Callable, schema: str) -> DataFrame:
    """What compare(key, ids, vectors, other ids, other vectors) makes of each row of met: the columns keys, and two tiles in the columns sides.

    Tiles go to Python as rows of single vectors, one pair of tiles after the other, since a batch counts rows: of whole tiles it would hold gigabytes. A
    task holds a batch of vectors and one pair.
    """
    side = lambda name, right: F.transform(name, lambda r: F.struct(F.lit(right).alias("right"), r["id"].alias("id"), r["v"].alias("v")))
    rows = met.select(*keys, F.inline(F.concat(side(sides[0], False), side(sides[1], True))))

    def whole(key, held):
        right, ids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        v = np.concatenate([x[2] for x in held])
        return compare(key, ids[~right], v[~right], ids[right], v[right])

    def run(batches):
        key, held = None, []  # of the pair that may go on in the next batch
        for batch in batches:
            if batch.empty:
                continue
            k = batch[keys].to_numpy()
            cuts = [0, *(np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1), len(k)]
            right, ids = batch["right"].to_numpy(bool), batch["id"].to_numpy()
            for i, j in zip(cuts, cuts[1:]):
                if held and tuple(k[i]) != key:
                    yield whole(key, held)
                    held = []
                key = tuple(k[i])
                held.append((right[i:j], ids[i:j], np.array(list(batch["v"].iloc[i:j]), float)))
        if held:
            yield whole(key, held)

    return rows.mapInPandas(run, schema)


def similar_pairs(vectors: DataFrame, least: float = 0.8) -> DataFrame:
    """id_a < id_b of one block (id, block, v) whose cosine is at least ``least``.

    A block is dealt into tiles of about TILE vectors; each pair of tiles meets once and is compared as a matrix product, so a large block is many
    tasks' work and no pair of rows is built that doesn't pass.
    """
    parts = vectors.groupBy("block").count().select("block", F.ceil(F.col("count") / TILE).alias("parts"))
    dealt = vectors.join(parts, "block").withColumn("tile", F.pmod(F.xxhash64("id"), "parts"))
    packed = dealt.groupBy("block", "tile").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    pairs = packed.select("block", F.col("tile").alias("t1"), F.col("rows").alias("a")).join(packed.select("block", F.col("tile").alias("t2"), F.col("rows").alias("b")), "block").where("t1 <= t2")

    def compare(key, ia, va, ib, vb):
        block, t1, t2 = key
        na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
        sim = (va @ vb.T) / np.maximum(na[:, None] * nb[None, :], 1e-300)
        i, j = np.nonzero(sim >= least)
        x, y = ia[i], ib[j]
        keep = x < y if t1 == t2 else np.ones(len(x), bool)
        return pd.DataFrame({"block": block, "id_a": np.minimum(x, y)[keep], "id_b": np.maximum(x, y)[keep], "similarity": sim[i, j][keep]})

    return _compared(pairs, ["block", "t1", "t2"], ("a", "b"), compare, "block long, id_a long, id_b long, similarity double")


def tiles(vectors: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, block, v) of each block in tiles of about TILE (block, t_<side>, <side>: the rows), and how many a block has (block, n_<side>)."""
    parts = vectors.groupBy("block").count().select("block", F.ceil(F.col("count") / TILE).alias(f"n_{side}"))
    dealt = vectors.join(parts, "block").withColumn(f"t_{side}", F.pmod(F.xxhash64("id"), F.col(f"n_{side}")))
    return dealt.groupBy("block", f"t_{side}").agg(F.collect_list(F.struct("id", "v")).alias(side)), parts


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10, above: float = 0.8) -> DataFrame:
    """The k nearest corpus rows (id, block, v) of each query of the same block, of cosine above ``above``: qid, id, similarity to four digits, place; of equal ones the smallest ids.

    A tile of queries meets each tile of its block's corpus as a matrix product, which hands on k rows of a query at most; so no pair is a row
    unless it may be among the nearest, and a large block is the work of many tasks.
    """
    (q, nq), (c, nc) = tiles(queries, "q"), tiles(corpus, "c")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = q.join(nc, "block").select("block", "t_q", every("n_c").alias("t_c"), "q").join(c.join(nq, "block").select("block", "t_c", every("n_q").alias("t_q"), "c"), ["block", "t_q", "t_c"])

    def best(key, iq, vq, ic, vc):
        order = np.argsort(ic, kind="stable")
        ic, vc = ic[order], vc[order]
        norms = np.maximum(np.linalg.norm(vq, axis=1)[:, None] * np.linalg.norm(vc, axis=1)[None, :], 1e-300)
        sim = np.floor(vq @ vc.T / norms * 1e4 + 0.5) / 1e4
        sim[(sim <= above) | (iq[:, None] == ic[None, :])] = -np.inf
        first = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # equal ones by id
        found = np.take_along_axis(sim, first, axis=1)
        i, j = np.nonzero(found > -np.inf)
        return pd.DataFrame({"qid": iq[i], "id": ic[first[i, j]], "similarity": found[i, j]})

    scored = _compared(met, ["block", "t_q", "t_c"], ("q", "c"), best, "qid long, id long, similarity double")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))).where(F.col("place") <= k)


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts in lower case."""
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")


GROUP = 512  # names of a block that share a rare letter; more are dealt into parts


def fuzzy_pairs(names: DataFrame, least: float = 0.75, group: int = GROUP) -> DataFrame:
    """block, name_a < name_b, ratio: names of one block (block, name) whose sequence ratio is at least ``least``.

    The ratio is at most twice the letters that two names share, counted with repeats, over all their letters. So each name is a set of numbered letters (the
    first a, the second a), the rarest in the block first; names that share enough have one in common among their first few. Pairs meet under the
    rarest letter that they have in common there, once; what shares too few letters is dropped before the ratio is worked out. A letter of
    many names is dealt into parts, which meet in pairs, so no block and no letter is one task.
    """
    low = F.split(F.lower("name"), "")
    rows = names.where("name IS NOT NULL AND name <> ''").select("block", "name").distinct()
    numbered = F.transform(low, lambda c, i: F.concat(F.size(F.filter(F.slice(low, F.lit(1), i + 1), lambda x: x == c)).cast("string"), c))
    letters = rows.select("block", "name", F.explode(numbered).alias("letter"))
    counts = letters.groupBy("block", "letter").agg(F.count("*").alias("n"))
    ranked = letters.join(counts, ["block", "letter"]).groupBy("block", "name").agg(F.array_sort(F.collect_list(F.struct("n", "letter"))).alias("all"))
    ranked = ranked.select("block", "name", F.col("all.letter").alias("all"), F.size("all").alias("size"))
    shared = F.ceil(F.col("size") * (least / (2 - least)) - 1e-9)  # letters in common with any name of ratio ``least``
    ranked = ranked.withColumn("first", F.slice("all", F.lit(1), (F.col("size") - shared + 1).cast("int")))
    under = ranked.withColumn("letter", F.explode("first"))
    parts = under.groupBy("block", "letter").agg(F.ceil(F.count("*") / group).alias("parts"))
    dealt = under.join(parts, ["block", "letter"]).withColumn("part", F.pmod(F.xxhash64("name"), "parts"))
    key = ["block", "letter", "p", "q"]
    a = dealt.select("*", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("q")).withColumnRenamed("part", "p")
    b = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("p")).withColumnRenamed("part", "q")
    side = lambda d, s: d.select(*key, *(F.col(c).alias(f"{c}_{s}") for c in ("name", "all", "first", "size")))
    pairs = side(a, "x").join(side(b, "y"), key).where("(p < q OR name_x < name_y) AND name_x <> name_y")
    enough = lambda n: 2.0 * n >= least * (F.col("size_x") + F.col("size_y")) - 1e-9
    pairs = pairs.where(enough(F.least("size_x", "size_y"))).where(F.get(F.array_intersect("first_x", "first_y"), F.lit(0)) == F.col("letter")).where(enough(F.size(F.array_intersect("all_x", "all_y"))))
    pairs = pairs.select("block", F.least("name_x", "name_y").alias("name_a"), F.greatest("name_x", "name_y").alias("name_b"))
    return pairs.withColumn("ratio", sequence_ratio("name_a", "name_b")).where(F.col("ratio") >= least)


def capped_pairs(pairs: DataFrame, cap: int = 10) -> DataFrame:
    """Pairs (block, id_a, id_b, similarity), most similar first, each accepted if both ends are in fewer than ``cap`` accepted ones.

    The outcome is that of the sequence, found in rounds: a pair that is among the first of those still open at both its ends, as many as
    each end has room for, is accepted whatever becomes of the others; an end without room drops its pairs. Ties go by id_a, then id_b.
    """
    steps = Steps(pairs.sparkSession, "capped")
    key = ["block", "id_a", "id_b"]
    left, found = steps(pairs.select(*key, "similarity"), "pairs"), []
    used = None
    while not left.isEmpty():
        ends = left.select(*key, "similarity", F.explode(F.array("id_a", "id_b")).alias("id"))
        place = F.row_number().over(Window.partitionBy("block", "id").orderBy(F.desc_nulls_last("similarity"), "id_a", "id_b"))
        first = ends.withColumn("place", place).where(F.col("place") <= cap)
        if used is not None:
            first = first.join(used, ["block", "id"], "left").where(F.col("place") <= cap - F.coalesce("n", F.lit(0)))
        found.append(steps(first.groupBy(*key).count().where("count = 2").select(*key), "accepted"))
        every = reduce(DataFrame.unionByName, found)
        used = steps(every.select("block", F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("block", "id").agg(F.count("*").alias("n")), "used")
        full = used.where(F.col("n") >= cap).select("block", "id")
        rest = left.join(found[-1], key, "left_anti").join(full.withColumnRenamed("id", "id_a"), ["block", "id_a"], "left_anti").join(full.withColumnRenamed("id", "id_b"), ["block", "id_b"], "left_anti")
        left = steps(rest.select(*key, "similarity"), "open")
    return pairs.join(reduce(DataFrame.unionByName, found), key, "left_semi").select(*pairs.columns) if found else pairs


def sequential_merge(pairs: DataFrame) -> DataFrame:
    """Pairs (block, ord, id_a, id_b) with outcome: b is merged into a if both still exist, in order; else not_found.

    This isn't the transitive closure: a pair that names a vanished node does nothing. The outcome is that of the sequence, found in rounds: a pair is
    merged once no open pair before it could take away one of its nodes; pairs after it that name the vanished node are then not found. There are as many
    rounds as the longest row of decisions that wait for each other.
    """
    steps = Steps(pairs.sparkSession, "merge")
    key = ["block", "ord"]
    left = steps(pairs.where("id_a <> id_b").select("block", "ord", "id_a", "id_b"), "pairs")
    merged = []
    while not left.isEmpty():
        threat = left.groupBy("block", F.col("id_b").alias("id")).agg(F.min("ord").alias("first"))
        both = left.join(threat.toDF("block", "id_a", "first_a"), ["block", "id_a"], "left").join(threat.toDF("block", "id_b", "first_b"), ["block", "id_b"])
        now = steps(both.where("first_b = ord AND (first_a IS NULL OR first_a > ord)").select("block", "ord", "id_b"), "merged")
        merged.append(now)
        open_pairs = left.join(now.select(*key), key, "left_anti")
        for end in ("id_a", "id_b"):
            gone = now.select(F.col("block").alias("g"), F.col("ord").alias("since"), F.col("id_b").alias("gone"))
            open_pairs = open_pairs.join(gone, (F.col("block") == F.col("g")) & (F.col(end) == F.col("gone")) & (F.col("since") < F.col("ord")), "left_anti")
        left = steps(open_pairs.select("block", "ord", "id_a", "id_b"), "open")
    done = reduce(DataFrame.unionByName, merged).select(*key, F.lit("merged").alias("outcome")) if merged else left.select(*key, F.lit("merged").alias("outcome"))
    return pairs.join(done, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_found"))).select(*pairs.columns, "outcome")


def final_names(merged: DataFrame) -> DataFrame:
    """id, into: where each merged node's edges end up when its target was merged later; chains are followed within a block, each round doubling the steps."""
    steps = Steps(merged.sparkSession, "names")
    now = steps(merged.where("outcome = 'merged'").select("block", F.col("id_b").alias("id"), F.col("id_a").alias("into")), "into")
    while True:
        onward = now.select("block", F.col("id").alias("into"), F.col("into").alias("last"))
        if now.join(onward, ["block", "into"], "left_semi").isEmpty():
            return now.select("id", "into")
        now = steps(now.join(onward, ["block", "into"], "left").select("block", "id", F.coalesce("last", "into").alias("into")), "into")


def by_threshold(decisions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Decisions (decision, confidence) counted, and those that say 'same' with confidence of at least each threshold."""
    t = F.broadcast(decisions.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold DOUBLE"))
    same = (F.col("decision") == "same") & (F.col("confidence") >= F.col("threshold"))
    return decisions.join(t, how="cross").groupBy("threshold").agg(F.count("*").alias("total"), F.sum(same.cast("long")).alias("same"))
