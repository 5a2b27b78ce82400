"""Finding spans in texts with DataFrame functions alone: regular expressions, positions in code points, digests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 48  # code points kept before and after a match
FOUND = "array<struct<kind:string,pos:int,gap:int,value:string,part:string,before:string,after:string>>"


@dataclass(frozen=True)
class Finder:
    """pattern: a Java expression whose leftmost matches that don't overlap are found; guard: a cheaper one that holds in any
    text with a match; group: that of the match to keep as ``part``."""

    kind: str
    pattern: str
    guard: str | None = None
    group: int = 0


def matches_of(text: Column, f: Finder) -> Column:
    """FOUND for one finder. The text between matches is what split() leaves, so gaps and matches add up to positions. A text's pieces and
    matches are held once over while its row is worked out."""
    pieces = F.split(text, f.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(f.pattern), F.lit(f.group)) if f.group else found
    first = F.array(F.lit(""))
    earlier = [F.concat(first, pieces).alias("pg"), F.concat(first, found).alias("pv")]  # the gap and the match before
    rows = F.arrays_zip(found.alias("v"), part.alias("p"), pieces.alias("g"), F.slice(pieces, 2, 1 << 30).alias("n"), *earlier)
    made = F.transform(
        F.filter(rows, lambda x: x["v"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(f.kind).alias("kind"), i.cast("int").alias("pos"), F.length(x["g"]).alias("gap"), x["v"].alias("value"), x["p"].alias("part"),
            F.right(F.concat(F.right(x["pg"], F.lit(CONTEXT)), F.right(x["pv"], F.lit(CONTEXT)), F.right(x["g"], F.lit(CONTEXT))), F.lit(CONTEXT)).alias("before"), F.left(x["n"], F.lit(CONTEXT)).alias("after"),
        ),
    )
    return F.when(F.rlike(text, F.lit(f.guard or f.pattern)), made.cast(FOUND)).otherwise(F.array().cast(FOUND))


def find(docs: DataFrame, finders: list[Finder], id_col: str, text_col: str) -> DataFrame:
    """_rid, _id, _found for every row of docs; to be staged, as _rid holds for one run only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), text.alias("_text"))
    return rows.select("_rid", "_id", F.flatten(F.array(*(matches_of(F.col("_text"), f) for f in finders))).alias("_found"))


def located(found: DataFrame) -> DataFrame:
    """A row per match of staged find(): _rid, kind, start, end (exclusive), value, part, before, after."""
    rows = found.where(F.size("_found") > 0).select("_rid", F.explode("_found").alias("x")).select("_rid", "x.*")
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("_rid", "kind").orderBy("pos"))
    rows = rows.withColumn("end", end.cast("long"))
    return rows.select("_rid", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "part", "before", "after")


def digests(spans: DataFrame, kinds: list[str], base: list[str]) -> DataFrame:
    """A row per _rid of spans (_rid, kind, start, end): n_<kind> of the base kinds, base_sha256, spans as text.

    Sorted by start, then the kinds' order, then end; a span that is found twice counts once.
    """
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    entry = F.struct(F.col("start"), order.alias("rank"), F.col("end"), F.col("kind"))
    rows = spans.groupBy("_rid").agg(F.array_sort(F.collect_set(entry)).alias("all"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = F.filter("all", lambda x: x["rank"] <= len(base))
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in base]
    return rows.select(F.col("_rid").alias("_of"), *counts, F.sha2(text(own).cast("binary"), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))


def per_document(found: DataFrame, spans: DataFrame, kinds: list[str], base: list[str], id_col: str) -> DataFrame:
    """A row per row of the staged find(): the id and digests(), which are of no span where nothing was found."""
    rows = found.select("_rid", "_id").join(digests(spans, kinds, base), F.col("_rid") == F.col("_of"), "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(F.col("_id").alias(id_col), *counts, F.coalesce("base_sha256", empty).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
