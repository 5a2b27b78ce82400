"""Evidence retrieval for questions: entity links, expansion to triples, first-wins filtering; sampling and state folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import lenient_json
from strandline.models import Client, ask
from strandline.sources.staging import Steps


GRAM = 3


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: the texts of inner that are within texts of outer (a column text each, distinct). A text meets those that hold the rarest of its
    grams only, and a text with a gram that none holds meets none."""
    grams = lambda size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda at: F.substring(F.col("text"), at, F.lit(size))))
    sized = lambda sizes: F.concat(*(F.when(F.length("text") >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in sizes))
    held = outer.select(F.col("text").alias("outer"), F.explode(sized(range(1, GRAM + 1))).alias("gram"))
    own = F.when(F.length("text") >= GRAM, grams(GRAM)).otherwise(F.array("text"))  # of a shorter text, itself
    asked = inner.where("text <> ''").select(F.col("text").alias("inner"), F.explode(own).alias("gram"))
    counts = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("inner", "r.gram")
    return rarest.join(held, "gram").where(F.contains("outer", "inner")).select("inner", "outer")


def link_entities(questions: DataFrame, names: DataFrame) -> DataFrame:
    """The entity that each (qid, mention) names, in lower case: an equal name, else one that holds the mention, else the longest one within it.

    Of several the first by name and id. Texts that hold each other are found by their rarest grams.
    """
    keyed = names.select("id", F.lower("name").alias("key")).where("key <> ''")
    asked = questions.select("qid", F.lower("mention").alias("key")).distinct()
    exact = asked.join(keyed, "key").groupBy("qid", "key").agg(F.min("id").alias("id"))
    rest = asked.join(exact, ["qid", "key"], "left_anti").where("key <> ''")
    open_keys = rest.select(F.col("key").alias("text")).distinct()
    first = keyed.groupBy(F.col("key").alias("text")).agg(F.min("id").alias("id"))
    every = first.select("text")
    holding = contained(open_keys, every).select(F.col("inner").alias("key"), F.col("outer").alias("text")).join(first, "text").groupBy("key").agg(F.min(F.struct("text", "id")).alias("outer"))
    within = contained(every, open_keys).select(F.col("outer").alias("key"), F.col("inner").alias("text")).join(first, "text")
    within = within.groupBy("key").agg(F.min(F.struct(F.negative(F.length("text")).alias("size"), "text", "id")).alias("inner"))
    loose = open_keys.withColumnRenamed("text", "key").join(holding, "key", "left").join(within, "key", "left").select("key", F.coalesce("outer.id", "inner.id").alias("id")).where("id IS NOT NULL")
    return exact.unionByName(rest.join(loose, "key"))


def relation_candidates(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, relations: the distinct relations that touch its linked ids (qid, id), sorted."""
    touching = edges.select(F.col("src").alias("id"), "rel").union(edges.select("dst", "rel")).distinct()
    return linked.select("qid", "id").distinct().join(touching, "id").groupBy("qid").agg(F.array_sort(F.collect_set("rel")).alias("relations"))


def first_neighbours(edges: DataFrame, ids: DataFrame, most: int = 50) -> DataFrame:
    """id, rel, way (out, in), other: of each of ids (id), relation and direction the first ``most`` by the other end. The order is that of the node, whoever asks,
    so a hub's neighbours are ranked once, and each task hands on ``most`` of them only."""
    own = ids.select("id").distinct()
    out = edges.select(F.col("src").alias("id"), "rel", F.lit("out").alias("way"), F.col("dst").alias("other")).join(own, "id", "left_semi")
    into = edges.select(F.col("dst").alias("id"), "rel", F.lit("in").alias("way"), F.col("src").alias("other")).join(own, "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "rel", "way").orderBy("other"))
    return out.union(into).withColumn("place", place).where(F.col("place") <= most).drop("place")


def hop(found: DataFrame, edges: DataFrame, tails: int = 30, relations: int = 10, most: int = 50) -> DataFrame:
    """Triples one hop further (qid, head, rel, tail): from the first tails of a question's triples over the first of their relations, up to most each."""
    place = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    start = found.select("qid", F.col("tail").alias("id")).distinct().withColumn("n", place(["qid"], "id")).where(F.col("n") <= tails).select("qid", "id")
    start = Steps(edges.sparkSession, "hop")(start)
    over = found.select("qid", "rel").distinct().withColumn("n", place(["qid"], "rel")).where(F.col("n") <= relations).select("qid", "rel")
    ahead = first_neighbours(edges, start, most).where("way = 'out'")
    return start.join(over, "qid").join(ahead, ["id", "rel"]).select("qid", F.col("id").alias("head"), "rel", F.col("other").alias("tail"))


def expand(linked: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Triples around linked ids (qid, id): for each id, relation and direction the first ``most`` by the other end."""
    ids = Steps(edges.sparkSession, "expand")(linked.select("qid", "id").distinct())  # so that the links aren't worked out for each use
    near = ids.join(first_neighbours(edges, ids, most), "id")
    out = F.col("way") == "out"
    return near.select("qid", F.when(out, F.col("id")).otherwise(F.col("other")).alias("head"), "rel", F.when(out, F.col("other")).otherwise(F.col("id")).alias("tail")).distinct()


def run_statistics(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Of a run over questions (qid) that found triples (qid): questions, filled, empty, share of filled ones in percent, mean_edges, max_edges."""
    each = questions.select("qid").join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    filled = F.count_if(F.col("n") > 0)
    return each.agg(F.count("*").alias("questions"), filled.alias("filled"), F.count_if(F.col("n") == 0).alias("empty"), F.round(100.0 * filled / F.count("*"), 2).alias("share"), F.round(F.avg("n"), 4).alias("mean_edges"), F.max("n").alias("max_edges"))


def first_wins(triples: DataFrame) -> DataFrame:
    """Per qid, in order of ord: a triple goes if its (head, rel) or (tail, rel) was kept before. A question is one task's work."""

    def work(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("ord")
        seen: set = set()
        keep = []
        for h, r, t in zip(own["head"], own["rel"], own["tail"]):
            fresh = (h, r) not in seen and (t, r) not in seen
            if fresh:
                seen |= {(h, r), (t, r)}
            keep.append(fresh)
        return own[keep]

    return triples.groupBy("qid").applyInPandas(work, triples.schema)


# The fields of answers, and the form of a line where there is no JSON.
CLAIMS = "STRUCT<sub_claims: ARRAY<STRUCT<sentence: STRING, entities: ARRAY<STRING>>>>"
RELATIONS = "STRUCT<selected_relations: ARRAY<STRING>>"
CLAIM_LINE = r"^\d+\.\s*(.+?)\s*[,，]?\s*Entity\s*set\s*[:：]\s*\[(.*?)\]\s*$"
MOST_ENTITIES, MOST_RELATIONS = 2, 10


def sub_claims(answers: DataFrame) -> DataFrame:
    """qid, place (from 1), sentence, entities (at most MOST_ENTITIES) of answers (qid, answer): from JSON, else from lines of CLAIM_LINE. Claims without sentence or entity are left out."""
    tidy = lambda names: F.slice(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""), 1, MOST_ENTITIES)
    claim = lambda sentence, names: F.struct(F.trim(sentence).alias("sentence"), tidy(names).alias("entities"))
    whole = lambda claims: F.filter(claims, lambda c: (c["sentence"] != "") & (F.size(c["entities"]) > 0))
    stated = F.from_json(lenient_json(F.col("answer"), array_first=False), CLAIMS)["sub_claims"]
    stated = whole(F.transform(stated, lambda c: claim(c["sentence"], F.coalesce(c["entities"], F.array().cast("array<string>")))))

    def of_line(line):
        names = F.transform(F.split(F.regexp_extract(line, CLAIM_LINE, 2), "##"), lambda x: F.btrim(F.trim(x), F.lit("'\"")))
        return claim(F.regexp_replace(F.regexp_extract(line, CLAIM_LINE, 1), "[,，。 ]+$", ""), names)

    lines = F.filter(F.transform(F.split("answer", "\r?\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(CLAIM_LINE)))
    both = F.when(F.size(stated) > 0, stated).otherwise(whole(F.transform(lines, of_line)))
    rows = answers.select("qid", F.posexplode(both).alias("_pos", "_c"))
    return rows.select("qid", (F.col("_pos") + 1).alias("place"), "_c.sentence", "_c.entities")


def chosen_relations(answer: Column, candidates: Column) -> Column:
    """The candidates that an answer names, in its order, at most MOST_RELATIONS: from JSON, else from its first list in brackets, else the first candidates."""
    bare = lambda names: F.transform(names, lambda x: F.btrim(F.trim(x), F.lit("'\"")))
    stated = bare(F.from_json(lenient_json(answer, array_first=False), RELATIONS)["selected_relations"])
    listed = bare(F.split(F.regexp_extract(answer, r"\[([^\[\]]*)\]", 1), ","))
    valid = lambda names: F.filter(names, lambda x: F.array_contains(candidates, x))
    found = F.when(F.size(valid(stated)) > 0, valid(stated)).when(F.size(valid(listed)) > 0, valid(listed)).otherwise(candidates)
    return F.slice(found, 1, MOST_RELATIONS)


def retrieve(questions: DataFrame, nodes: DataFrame, edges: DataFrame, claims_by: Client, relations_by: Client, again: Client | None = None) -> tuple[DataFrame, DataFrame]:
    """Evidence for questions (qid long, stem) from a graph, and what became of each question.

    Claims are asked for and parsed, with ``again`` once more for questions without one; their entities are linked to nodes; the relations that touch them are
    chosen by a model where there are more than MOST_RELATIONS; triples around them over these come first, then those one hop further; of equal ones the first
    counts, and first_wins thins them. Returns evidence (qid, head, rel, tail, ord) and outcomes (qid, outcome, n_claims), outcome first, retry or failed.
    """
    steps = Steps(questions.sparkSession, "evidence")
    edges = steps(edges.select("src", "rel", "dst"), "edges")
    claims = steps(sub_claims(ask(questions, "qid", "stem", claims_by)).withColumn("outcome", F.lit("first")), "claims")
    if again:
        rest = questions.join(claims.select("qid"), "qid", "left_anti")
        claims = claims.unionByName(steps(sub_claims(ask(rest, "qid", "stem", again)).withColumn("outcome", F.lit("retry")), "retry"))
    claims = claims.withColumn("cid", F.concat_ws("#", "qid", "place"))
    linked = link_entities(claims.select(F.col("cid").alias("qid"), F.explode("entities").alias("mention")), nodes)
    linked = steps(linked.select("qid", "id").distinct(), "linked")
    found = relation_candidates(linked, edges)
    few = found.where(F.size("relations") <= MOST_RELATIONS)
    many = found.where(F.size("relations") > MOST_RELATIONS)
    prompts = many.join(claims.select(F.col("cid").alias("qid"), "sentence"), "qid").withColumn("prompt", F.concat_ws("\n", "sentence", F.array_join("relations", ", ")))
    picked = many.join(ask(prompts, "qid", "prompt", relations_by), "qid").select("qid", chosen_relations(F.col("answer"), F.col("relations")).alias("relations"))
    over = few.unionByName(picked).select("qid", F.explode("relations").alias("rel"))
    near = expand(linked, edges).join(over, ["qid", "rel"], "left_semi").join(claims.select(F.col("cid").alias("qid"), F.col("qid").alias("of"), "place"), "qid")
    near = steps(near.groupBy(F.col("of").alias("qid"), "head", "rel", "tail").agg(F.min("place").alias("place")).withColumn("hop", F.lit(1)), "near")
    far = hop(near.select("qid", "head", "rel", "tail"), edges).withColumns({"place": F.lit(0), "hop": F.lit(2)})
    every = near.unionByName(far).groupBy("qid", "head", "rel", "tail").agg(F.min(F.struct("hop", "place")).alias("o"))
    ordered = every.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("o.hop", "o.place", "rel", "head", "tail"))).drop("o")
    outcomes = questions.select("qid").join(claims.groupBy("qid").agg(F.min("outcome").alias("outcome"), F.count("*").alias("n_claims")), "qid", "left")
    return first_wins(ordered), outcomes.select("qid", F.coalesce("outcome", F.lit("failed")).alias("outcome"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


PRIME = 2**61 - 1  # above any number of pairs


def sample_pairs(nodes: DataFrame, per_community: int = 20, least: int = 10, seed: int = 42) -> DataFrame:
    """Per community (id, name, community) of at least ``least`` nodes up to that many pairs of names within it and with others; no pair twice.

    community, pair_type (in, cross), other (the second name's community), a, b, place. Pairs are numbered and numbers are drawn by steps of a prime, so none
    is drawn twice and the pairs themselves are never listed. A pair that two communities draw belongs to the smaller one. Draws go on until every
    community has its pairs or no more are left.
    """
    steps = Steps(nodes.sparkSession, "pairs")
    big = nodes.groupBy("community").count().where(F.col("count") >= least).select("community")
    named = nodes.join(big, "community", "left_semi").where("name IS NOT NULL").select("community", "name").distinct()
    sizes = named.groupBy("community").agg(F.count("*").alias("n")).where("n >= 2")
    start = F.sum("n").over(Window.orderBy("community").rowsBetween(Window.unboundedPreceding, -1))  # a row per community
    sizes = steps(sizes.withColumn("start", F.coalesce(start, F.lit(0))), "sizes")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.xxhash64(F.lit(seed), "name"), "name")) - 1
    names = steps(named.withColumn("i", place).join(sizes, "community").select("community", "name", (F.col("start") + F.col("i")).alias("g")), "names")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    whole = lambda c: c.cast("decimal(38,0)")
    kinds = sizes.select("community", "n", "start", F.explode(F.array(F.lit("in"), F.lit("cross"))).alias("pair_type"), (F.lit(total) - F.col("n")).alias("rest"))
    inside = F.col("pair_type") == "in"
    kinds = kinds.withColumn("pairs", F.when(inside, (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(F.col("n") * F.col("rest"))).where("pairs > 0")
    first, second = names.toDF("community", "x", "ga"), names.toDF("other", "y", "gb")
    draws = 4 * per_community
    while True:
        p = (F.pmod(F.xxhash64(F.lit(seed), "community", "pair_type"), F.col("pairs")) + whole(F.lit(PRIME) % F.col("pairs")) * F.col("j")) % whole(F.col("pairs"))
        drawn = kinds.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("pairs"), F.lit(draws)).cast("long") - 1)).alias("j")).withColumn("p", p.cast("long"))
        # Within: all ordered pairs of n - 1 by n / 2 around a circle, which has each unordered pair once. Across: a name of the community by one of the rest.
        lap, at = F.floor(F.col("p") / F.col("n")), F.col("p") % F.col("n")
        own = F.when(inside, at).otherwise(F.floor(F.col("p") / F.col("rest")))
        far = F.when(inside, F.col("start") + (at + lap + 1) % F.col("n")).otherwise(F.col("p") % F.col("rest") + F.when(F.col("p") % F.col("rest") >= F.col("start"), F.col("n")).otherwise(0))
        drawn = drawn.select("community", "pair_type", "pairs", "j", (F.col("start") + own).cast("long").alias("ga"), far.cast("long").alias("gb"))
        pairs = drawn.join(first, ["community", "ga"]).join(second, "gb").where("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
        owner = pairs.groupBy("a", "b").agg(F.min(F.struct("community", F.col("pair_type") == "cross", "j", "pair_type", "other")).alias("o"))
        kept = owner.select("o.community", "o.pair_type", "o.other", "a", "b", "o.j").withColumn("place", F.row_number().over(Window.partitionBy("community", "pair_type").orderBy("j")))
        kept = steps(kept.where(F.col("place") <= per_community).drop("j"), "kept")
        have = kept.groupBy("community", "pair_type").agg(F.count("*").alias("have"))
        if kinds.where(F.col("pairs") > draws).join(have, ["community", "pair_type"], "left").where(F.coalesce("have", F.lit(0)) < per_community).isEmpty():
            return kept
        draws *= 4


def toggled(events: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """What is on after a toggle per event: keys with an odd number of events, and the last event's place."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.max(order).alias("last")).where("n % 2 = 1").select(*keys, "last")
