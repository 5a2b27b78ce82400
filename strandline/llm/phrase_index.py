"""Benchmark decontamination with a distributed positional inverted index.

One pass over the texts inverts every batch of documents into a segment of the index: a row per (segment, term) holds the term's
postings, the places of its occurrences in the words of all the segment's documents, in ascending order. All words are indexed, so an
index serves any benchmark. A frequent term's postings are as many rows as there are segments, and no key gathers them.

Each window of a test item (or the whole of a shorter item) is looked up by its rarest terms in three steps, each a join on the
index's rows, of which only those of the wanted terms are read in full: the postings of the rarest term, less its offset, give candidate places;
those at which the two next rarest terms' offset-adjusted postings are, too, stay; and of these the postings of all the window's other
terms decide. So exact matches are the intersection of all the offset-adjusted lists.

With ``slop`` above 0 a word may also stand up to slop places from where the rarest term puts it; items that match so only are
returned as proximity matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import BYTES_LOWER, LOWER, UPPER, Workspace, bounded_batches

#: Every byte that separates words, as a space; A-Z as a-z.
SEPARATED = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in BYTES_LOWER)
WINDOW = 10
RAREST = 3  # terms of a window whose lists are intersected before the others'


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number, to be staged), item_id (as text), words: the items that have words."""
    # The class is that of SEPARATED: what is left between separators.
    words = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col(id_col).cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0).dropDuplicates().withColumn("item", F.monotonically_increasing_id())


# ---------------------------------------------------------------- the index


class Numbers(dict):
    """Numbers of terms, in the order in which they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def inverted(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """terms, the ends of their postings, the postings by term (places in the words of all texts), and the number of words of each text."""
    words = [(text or "").encode("utf-8", "surrogatepass").translate(SEPARATED).split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    numbers = Numbers()
    flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    by_term = np.sort(flat << 32 | np.arange(len(flat)))
    return list(numbers), np.cumsum(np.bincount(flat, minlength=len(numbers))), (by_term & 0xFFFFFFFF).astype(np.int32), sizes


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index of all rows of docs, to be staged: a row per segment and term (segment, term, n, postings), and one per segment without a
    term that names its documents (ids, sizes: words of each). A segment holds one batch of rows, whose texts have fewer than 2 ** 31 words."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, ends, postings, sizes = inverted(batch["_text"].to_pylist())
            n = len(terms)
            offsets = np.concatenate([[0], ends, [len(postings)]]).astype(np.int32)
            own = pa.array([*[0] * (n + 1), len(sizes)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, batch["_rid"][0].as_py())),  # of the segment's first row: no other has it
                    pa.concat_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array([None], pa.string())]),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(postings)),
                    pa.ListArray.from_arrays(own, batch["_id"]),
                    pa.ListArray.from_arrays(own, pa.array(sizes)),
                ],
                ["segment", "term", "n", "postings", "ids", "sizes"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(build, f"segment long, term string, n int, postings array<int>, ids array<{kind}>, sizes array<long>")


def indexed_documents(indexed: DataFrame) -> DataFrame:
    """segment, doc, _id, first, n_words: every row that was indexed; its words have the places from first on."""
    rows = indexed.where("term IS NULL").select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("doc", "x"))
    before = Window.partitionBy("segment").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a batch has
    return rows.select("segment", "doc", F.col("x.ids").alias("_id"), F.coalesce(F.sum("x.sizes").over(before), F.lit(0)).alias("first"), F.col("x.sizes").alias("n_words"))


# ---------------------------------------------------------------- the search


def terms_of(items: DataFrame, postings: DataFrame) -> DataFrame:
    """item, offset, term, df of every word of the items; df, how often the term is indexed, is 0 for one that isn't."""
    counts = postings.groupBy("term").agg(F.sum("n").alias("df")).withColumnRenamed("term", "_term")
    at = items.select("item", F.posexplode("words").alias("offset", "term")).join(counts, F.col("term") == F.col("_term"), "left")
    return at.select("item", "offset", "term", F.coalesce("df", F.lit(0)).alias("df"))


def windows_of(items: DataFrame, at: DataFrame, window: int) -> DataFrame:
    """item, start, n (words of the window) and rarest, the offsets in the item of its RAREST rarest terms (ties: the first).

    Each word goes to the windows that hold it, ``window`` at most, so a long item is as many small groups as it has windows. A window with a
    term that isn't indexed can't match and isn't returned.
    """
    sizes = items.select("item", F.greatest(F.size("words") - window, F.lit(0)).alias("last"))
    starts = F.sequence(F.greatest(F.col("offset") - window + 1, F.lit(0)), F.least("offset", "last"))
    held = at.join(sizes, "item").select("item", F.struct("df", "offset").alias("x"), F.explode(starts).alias("start"))
    rows = held.groupBy("item", "start").agg(F.array_sort(F.collect_list("x")).alias("own")).where(F.col("own")[0]["df"] > 0)
    return rows.select("item", "start", F.size("own").alias("n"), F.slice("own", 1, RAREST)["offset"].alias("rarest"))


def standing(postings: DataFrame, places: DataFrame, terms: DataFrame, slop: int, work: Workspace, name: str) -> DataFrame:
    """segment, lookup, place, offset, near: which of the terms (lookup, offset, term) stand where they belong when their item's first word
    is put at the places (segment, lookup, place), or (near) up to slop words beside."""
    shifts = F.array(*(F.lit(i) for i in range(-slop, slop + 1)))
    rows = places.join(terms.withColumnRenamed("lookup", "_lookup"), F.col("lookup") == F.col("_lookup")).select("segment", "lookup", "place", "offset", "term", F.explode(shifts).alias("shift"))
    rows = work.stage(rows.withColumn("posting", F.col("place") + F.col("offset") + F.col("shift")).where("posting >= 0"), f"{name}-wanted", compression="lz4")
    asked = rows.groupBy(F.col("segment").alias("_segment"), F.col("term").alias("_term")).agg(F.collect_set("posting").alias("asked"))
    wanted = work.stage(terms.select(F.col("term").alias("_term")).distinct(), f"{name}-terms")
    lists = postings.join(wanted, F.col("term") == F.col("_term"), "left_semi").join(asked.hint("merge"), (F.col("segment") == F.col("_segment")) & (F.col("term") == F.col("_term")))
    found = work.stage(lists.select("segment", "term", F.explode(F.array_intersect("postings", "asked")).alias("posting")), f"{name}-found")
    rows = rows.join(found, ["segment", "term", "posting"], "left_semi")
    return rows.groupBy("segment", "lookup", "place", "offset").agg((F.min(F.abs("shift")) > 0).alias("near"))


def matches(indexed: DataFrame, items: DataFrame, work: Workspace, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """segment, doc, item, kind ('exact' or 'near'), start, end (words of the document): where windows of the items (as item_words
    gives them) occur. indexed: staged. Windows of an item with the same rarest terms are one lookup."""
    terms = work.stage(items.select(F.explode("words").alias("_term")).distinct(), "terms")
    postings = work.stage(indexed.join(terms, F.col("term") == F.col("_term"), "left_semi").select("segment", "term", "n", "postings"), "postings", compression="lz4")
    at = work.stage(terms_of(items, postings), "at")
    windows = windows_of(items, at, window).groupBy("item", "rarest").agg(F.collect_list(F.struct("start", "n")).alias("windows"))  # ``window`` windows at most
    lookups = work.stage(windows.withColumn("lookup", F.monotonically_increasing_id()), "lookups")
    named = at.select("item", "offset", "term")
    rarest = work.stage(lookups.select("lookup", "item", F.posexplode("rarest").alias("nth", "offset")).join(named, ["item", "offset"]).select("lookup", "nth", "offset", "term"), "rarest")
    first = work.stage(rarest.where("nth = 0").select("lookup", "offset", F.col("term").alias("_term")), "first")
    rows = postings.join(first, F.col("term") == F.col("_term")).select("segment", "lookup", "offset", F.explode("postings").alias("posting"))
    places = work.stage(rows.select("segment", "lookup", (F.col("posting") - F.col("offset")).alias("place")), "places", compression="lz4")
    # The next rarest terms of the windows.
    key = ["segment", "lookup", "place"]
    more = rarest.where("nth > 0")
    need = more.groupBy("lookup").agg(F.count("*").alias("need")).withColumnRenamed("lookup", "_lookup")
    have = standing(postings, places, more, slop, work, "next").groupBy(*key).agg(F.count("*").alias("have"))
    all_next = have.join(need, F.col("lookup") == F.col("_lookup")).where("have = need").select(*key)
    single = places.join(need, F.col("lookup") == F.col("_lookup"), "left_anti")  # windows of one word
    likely = work.stage(all_next.union(single), "likely")
    for name in ("places", "next-wanted", "next-found"):
        work.drop(name)
    # All terms of the windows that are left.
    own = lookups.select("lookup", "item", F.explode("windows").alias("x")).select("lookup", "item", "x.*")
    every = own.select("lookup", "item", F.explode(F.expr("sequence(start, start + n - 1)")).alias("offset")).distinct().join(named, ["item", "offset"]).select("lookup", "offset", "term")
    have = standing(postings, likely, every, slop, work, "all").groupBy(*key).agg(F.collect_list(F.struct("offset", "near")).alias("have"))
    named = lookups.select(F.col("lookup").alias("_lookup"), "item", "windows")
    rows = have.join(named, F.col("lookup") == F.col("_lookup")).select("segment", "item", "place", "have", F.explode("windows").alias("x"))
    within = F.filter("have", lambda x: x["offset"].between(F.col("x.start"), F.col("x.start") + F.col("x.n") - 1))
    rows = rows.withColumn("own", within).where(F.size("own") == F.col("x.n"))
    kind = F.when(F.exists("own", lambda x: x["near"]), F.lit("near")).otherwise(F.lit("exact"))
    begin = F.col("place") + F.col("x.start")
    return in_documents(indexed, rows.select("segment", "item", kind.alias("kind"), begin.cast("long").alias("start"), (begin + F.col("x.n")).cast("long").alias("end")))


def in_documents(indexed: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (segment, item, kind, start, end in the segment's words) by document, with its own places; those over two documents fall out."""
    docs = indexed_documents(indexed).where("n_words > 0").select("segment", F.col("first").alias("start"), F.struct("doc", "first", "n_words").alias("of"))
    both = spans.unionByName(docs, allowMissingColumns=True)
    upto = Window.partitionBy("segment").orderBy("start", F.col("of").isNull())
    rows = both.withColumn("of", F.last("of", ignorenulls=True).over(upto)).where("item IS NOT NULL AND end <= of.first + of.n_words")
    return rows.select("segment", "of.doc", "item", "kind", (F.col("start") - F.col("of.first")).alias("start"), (F.col("end") - F.col("of.first")).alias("end"))


def covered(spans: DataFrame) -> DataFrame:
    """segment, doc, n_hit: the places that the spans (segment, doc, start, end) cover, each once."""
    before = Window.partitionBy("segment", "doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    return rows.groupBy("segment", "doc").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "upto"), F.lit(0).cast("long"))).alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """A row per row of docs: its id, n_words, n_hit (words inside exact matches), items (ids as text, sorted) and near_items, those that match
    with slop only.

    Null or empty texts have no words and no hits; rows that repeat are counted alike and apart. An item without words is
    no item; items that repeat are one. An empty items table leaves every document clean.
    """
    work = Workspace(docs.sparkSession, "phrases")
    wanted = work.stage(item_words(items, item_id_col, item_text_col), "items")
    indexed = work.stage(index(docs, id_col, text_col), "index", compression="lz4")
    found = work.stage(matches(indexed, wanted, work, window, slop), "matches")
    exact = found.where("kind = 'exact'")
    named = found.select("segment", "doc", "item", "kind").distinct().join(wanted.select("item", "item_id"), "item")
    hit = covered(exact.select("segment", "doc", "start", "end").distinct())
    ids = named.groupBy("segment", "doc").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "exact", F.col("item_id")))).alias("items"), F.array_sort(F.collect_set(F.when(F.col("kind") == "near", F.col("item_id")))).alias("near_items")
    )
    none = F.array().cast("array<string>")
    out = indexed_documents(indexed).join(hit, ["segment", "doc"], "left").join(ids, ["segment", "doc"], "left")
    near = F.array_except(F.coalesce("near_items", none), F.coalesce("items", none))
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), near.alias("near_items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of docs without an exact match, in its columns. Rows of one id go together if any has a match."""
    hit = contamination(docs, items, id_col, text_col, **kwargs).where("n_hit > 0").select(F.col(id_col).alias("__hit")).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("__hit")), "left_anti")
