"""Mixing sources to target weights with exact token budgets.

Each document gets a hash-random key. Keys are uniform, so fixed ranges of the key space, each cut into as many again, are range
partitions of even size without sampling: about the cube root of the rows at each of the two levels. Sizes are summed per (source, range)
and prefix-summed; in the range where a source's budget ends the same is done with the finer ranges, and only the rows of one of those, about
a cube root of all again, are sorted to find the document at the cut. The decision for a source is one small row (epochs, key and id at the
cut, words left for it), which every document compares itself with. No text and no source moves to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, Workspace
from strandline.operators.ranges import running


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, work: Workspace, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """sizes (_source, _source_size) with the column _target, in words.

    Sources in code-point order, null last, get the weights in turn and share ``share`` of all words. A target stops
    at ``max_epochs`` times the source; what is above is shared by weight among the others until none is above.
    That ends where every target is min(cap, level * weight): sources sorted by cap / weight are filled in one pass.
    """
    turn = running(sizes, [F.col("_source").asc_nulls_last()], [], work.stage, "turns")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    turn = turn.select("_source", "_source_size", w.alias("_w"), (F.col("_source_size") * F.lit(float(max_epochs))).alias("_cap")).withColumn("_full", F.col("_cap") / F.col("_w"))
    filled = running(turn, [F.col("_full"), F.col("_source").asc_nulls_last()], ["_cap", "_w"], work.stage, "filled")
    every = turn.agg(F.sum("_source_size").alias("size"), F.sum("_w").alias("w")).first()
    level = (F.lit(share * (every["size"] or 0)) - F.col("_before__cap")) / (F.lit(every["w"] or 1.0) - F.col("_before__w"))
    # The first source that isn't filled up by then sets the level.
    final = filled.select("_rank", "_full", level.alias("level")).where("level < _full").agg(F.min(F.struct("_rank", "level"))["level"]).first()[0]
    target = F.col("_cap") if final is None else F.least("_cap", F.col("_w") * F.lit(final))
    return turn.select("_source", "_source_size", target.alias("_target"))


def keyed(docs: DataFrame, id_col: str, source_col: str, size: Column, seed: int) -> DataFrame:
    """The rows of docs as a struct _row, whatever their columns' names, with _id, _source, _size and the hash-random _key."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    name = F.col(id_col).cast("string")
    return docs.select(whole, name.alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("_size"), F.xxhash64(F.lit(seed), name).alias("_key"))


def cut_range(ranged: DataFrame, column: str, goal: DataFrame) -> DataFrame:
    """_source, column, _rest, _start: in which range of each source the words _rest end that follow _start; goal: _source, _rest, _start."""
    sums = ranged.groupBy("_source", column).agg(F.sum("_size").alias("_sum")).alias("r")
    found = sums.join(goal.alias("g"), F.col("r._source").eqNullSafe(F.col("g._source"))).select("r._source", column, "_sum", "_rest", "_start")
    found = found.withColumn("_end", F.col("_start") + F.sum("_sum").over(Window.partitionBy("_source").orderBy(column)))
    return found.where("_end - _sum <= _rest and _rest < _end").select("_source", column, "_rest", (F.col("_end") - F.col("_sum")).alias("_start"))


def cuts(rows: DataFrame, n_rows: int, work: Workspace, **mix) -> DataFrame:
    """One row per source: _source, _source_size, _target, _epochs, _cut_key, _cut_id, _left, _unit. rows: _id, _source, _size, _key, staged."""
    fan = max(1, round(n_rows ** (1 / 3)))
    # The range of a key: its upper 31 bits, as an unsigned number, times the number of ranges.
    upper = F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-(1 << 63))), 33)
    ranged = rows.withColumns({"_range": F.shiftright(upper * fan, 31), "_fine": F.shiftright(upper * (fan * fan), 31)})
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    goal = targets(sizes, work, **mix)
    whole = F.floor("_target").cast("long")
    goal = goal.withColumn("_epochs", F.when(F.col("_source_size") > 0, F.floor(whole / F.col("_source_size"))).otherwise(0).cast("long"))
    goal = work.stage(goal.withColumn("_rest", whole - F.col("_epochs") * F.col("_source_size")), "goal")
    last = cut_range(ranged, "_range", goal.select("_source", "_rest", F.lit(0).cast("long").alias("_start")))
    within = ranged.alias("d").join(last.alias("l"), F.col("d._source").eqNullSafe(F.col("l._source")) & (F.col("d._range") == F.col("l._range"))).select("d.*")
    within = work.stage(within, "within")
    fine = cut_range(within, "_fine", last.drop("_range"))
    near = within.alias("d").join(fine.alias("l"), F.col("d._source").eqNullSafe(F.col("l._source")) & (F.col("d._fine") == F.col("l._fine")))
    units = near.groupBy("d._source", "_key", "_id", "_rest", "_start").agg(F.sum("_size").alias("_unit"))
    ends = units.withColumn("_end", F.col("_start") + F.sum("_unit").over(Window.partitionBy("_source").orderBy("_key", "_id")))
    cut = ends.where("_end - _unit <= _rest and _rest < _end")
    cut = cut.select("_source", F.col("_key").alias("_cut_key"), F.col("_id").alias("_cut_id"), (F.col("_rest") - F.col("_end") + F.col("_unit")).alias("_left"), "_unit")
    return goal.alias("g").join(cut.alias("c"), F.col("g._source").eqNullSafe(F.col("c._source")), "left").select("g.*", "_cut_key", "_cut_id", "_left", "_unit")


def decided(small: DataFrame, rows: DataFrame, work: Workspace, **mix) -> DataFrame:
    """small (as keyed, or rows) with _source_size, _target and _taken. rows: _id, _source, _size and _key of the same documents, staged."""
    plan = work.stage(cuts(rows, rows.count(), work, **mix), "cuts")  # one row per source
    out = small.alias("d").join(plan.alias("p"), F.col("d._source").eqNullSafe(F.col("p._source")))
    early = (F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & (F.coalesce("_id", F.lit("")) < F.coalesce("_cut_id", F.lit(""))))
    at = (F.col("_key") == F.col("_cut_key")) & F.col("_id").eqNullSafe(F.col("_cut_id"))
    part = F.when(at, F.floor(F.col("_left") * F.col("_size") / F.col("_unit"))).when(early, F.col("_size")).otherwise(0)
    taken = F.col("_epochs") * F.col("_size") + F.coalesce(part, F.lit(0))
    return out.select("d.*", "_source_size", "_target", taken.cast("long").alias("_taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, seed: int = 1, carry: list[str] | None = None, **mix) -> DataFrame:
    """Columns of docs (those in carry, or all) with _size, _source_size, _target and _taken: the words the mix takes of each row, repeats counted.

    A whole epoch takes every row of the source; in the last, rows before the cut are taken whole and the row at the cut
    in part, so that a source gives exactly its target, rounded down. Rows with one id and source are taken together;
    at the cut they share what is left by size, rounded down. Rows of size 0 take 0. A null source is a source of its own,
    a null id an id. An empty table gives an empty result. A column of docs with the name of an added one isn't returned.
    """
    work = Workspace(docs.sparkSession, "mix")
    added = ["_size", "_source_size", "_target", "_taken"]
    wanted = [c for c in (docs.columns if carry is None else carry) if c not in added]
    small = keyed(docs, id_col, source_col, word_count(F.col("text")) if size is None else size, seed)
    lean = wanted == [id_col]
    rows = work.stage(small.select(*([F.struct(F.col(f"_row.`{id_col}`")).alias("_row")] if lean else []), "_id", "_source", "_size", "_key"), "sizes")
    out = decided(rows if lean else small, rows.drop("_row"), work, **mix)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in wanted), *added)


def repeat_epochs(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1, **mix) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each time a document is taken. The row at a source's cut is
    taken if at least half of its words are within the budget, since texts aren't torn."""
    work = Workspace(docs.sparkSession, "mix")
    small = keyed(docs, id_col, source_col, word_count(F.col(text_col)), seed)
    out = decided(small, work.stage(small.drop("_row"), "sizes"), work, **mix)
    times = F.when(F.col("_size") > 0, F.floor((F.col("_taken") * 2 + F.col("_size")) / (F.col("_size") * 2))).otherwise(0).cast("int")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), times))).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
