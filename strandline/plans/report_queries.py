"""Queries of reports, evaluations, merged graphs and model answers, each with its SQL where there is one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import models
from strandline.functions import report
from strandline.functions import text as fn
from strandline.operators import communities, evidence, funnel, graph, matching, stats
from strandline.plans.graph_binding import EDGES_SQL, G0, NODES_SQL, edges, nodes, side, table
from strandline.plans.table_queries import ANSWERS_SQL, F1_SQL, FILES_SQL, answers, file_names, vectors
from strandline.sources import triples as sources
from strandline.sources.staging import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- evaluations


@query(f"""WITH {ANSWERS_SQL}, a AS (SELECT coalesce(gold, '') g, coalesce(got, '') a FROM answers)
    SELECT length(g) gold_size, count(*) n, count(*) FILTER (g = a) correct, count(*) FILTER (length(a) < length(g)) under, count(*) FILTER (length(a) < length(g) AND length(a) = 1) under_to_one,
      count(*) FILTER (length(a) > length(g)) AS over, count(*) FILTER (length(a) = length(g) AND a <> g) wrong, round(sum({F1_SQL.replace('gold', 'g').replace('got', 'a')}), 4)::DOUBLE f1_sum FROM a GROUP BY 1""")
def error_patterns(spark, sf):
    """How answers of several letters go wrong, by the number of right letters, and the sum of their F1."""
    g, a = F.col("gold"), F.col("got")
    less, more, same = F.length(a) < F.length(g), F.length(a) > F.length(g), F.length(a) == F.length(g)
    return answers(spark, sf).groupBy(F.length(g).cast("long").alias("gold_size")).agg(
        F.count("*").alias("n"), F.count_if(g == a).alias("correct"), F.count_if(less).alias("under"), F.count_if(less & (F.length(a) == 1)).alias("under_to_one"),
        F.count_if(more).alias("over"), F.count_if(same & (a != g)).alias("wrong"), F.round(F.sum(fn.set_f1(g, a)), 4).alias("f1_sum"),
    )


@query("""WITH e AS (SELECT user_id, count(*) n FROM events GROUP BY 1), s AS (SELECT o_custkey, count(*) edges FROM orders GROUP BY 1)
    SELECT c_nationkey, count(*) evaluated, count(*) FILTER (coalesce(edges, 0) > 0) filled, round(100.0 * count(*) FILTER (coalesce(edges, 0) > 0) / count(*), 2)::DOUBLE share,
      round(avg(coalesce(edges, 0)), 4) mean_edges, max(coalesce(edges, 0)) max_edges FROM e JOIN customer ON user_id = c_custkey LEFT JOIN s ON c_custkey = o_custkey GROUP BY 1""")
def evaluated_subgraphs(spark, sf):
    """Evaluations that the bank knows, with the size of each one's subgraph, 0 where there is none."""
    done = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    size = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("edges"))
    bank = table(spark, sf, "customer")
    rows = done.join(bank, F.col("user_id") == F.col("c_custkey")).join(size, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    filled = F.count_if(F.col("edges") > 0)
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("evaluated"), filled.alias("filled"), F.round(100.0 * filled / F.count("*"), 2).alias("share"), F.round(F.avg("edges"), 4).alias("mean_edges"), F.max("edges").alias("max_edges"))


@query("SELECT user_id, count(*) mistakes, max(event_id) AS last FROM events WHERE value < 50 GROUP BY 1")
def mistake_store(spark, sf):
    """Mistakes appended to a store, which a second run of the same events leaves as it is."""
    path = fresh(spark, "mistakes")
    wrong = table(spark, sf, "events").where("value < 50").select("event_id", "user_id", "event_type")
    sources.append_new(wrong, ["event_id"], path)
    return sources.append_new(wrong, ["event_id"], path).groupBy("user_id").agg(F.count("*").alias("mistakes"), F.max("event_id").alias("last"))


# ---------------------------------------------------------------- statistics of reports


@query("""WITH c AS (SELECT c_nationkey g, c_mktsegment k, count(*) n FROM customer GROUP BY 1, 2), e AS (SELECT g, round(-sum(n / t * log2(n / t)), 6) h FROM (SELECT *, sum(n) OVER (PARTITION BY g) t FROM c) GROUP BY 1),
    w AS (SELECT round(-sum(n / t * log2(n / t)), 6) h FROM (SELECT k, sum(n) n, sum(sum(n)) OVER () t FROM c GROUP BY 1))
    SELECT w.h global_entropy, round(avg(e.h), 5) mean_entropy, round(median(e.h), 5) median_entropy, count(*) groups, count(*) FILTER (e.h < w.h) below_global FROM e, w GROUP BY w.h""")
def entropy_summary(spark, sf):
    found = stats.entropy_summary(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")
    return found.withColumns({c: F.round(c, 5) for c in ("mean_entropy", "median_entropy")})


@query("SELECT c_mktsegment, c_nationkey, count(*) n, (sum(count(*)) OVER (PARTITION BY c_mktsegment))::BIGINT unit_total, (sum(count(*)) OVER (PARTITION BY c_nationkey))::BIGINT group_total FROM customer GROUP BY 1, 2")
def unit_matrix(spark, sf):
    return stats.matrix(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query("""WITH r AS (SELECT l_linenumber > 1 has, CASE WHEN l_tax = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'duplicate' ELSE 'correct' END v, l_discount >= 0.05 s, l_returnflag <> coalesce(nullif(l_linestatus, 'O'), '') o FROM lineitem)
    SELECT count(*) total, count(*) FILTER (has) with_original, count(*) FILTER (has AND v IS NOT NULL) taken, count(*) FILTER (has AND v = 'duplicate') duplicate, count(*) FILTER (has AND v = 'correct') correct,
      count(*) FILTER (has AND v IS NULL) not_taken, count(*) FILTER (has AND v IS NOT NULL AND s) subject_renamed, count(*) FILTER (has AND v IS NOT NULL AND o) object_renamed FROM r""")
def standardisation(spark, sf):
    name = F.col("l_suppkey").cast("string")
    verdict = F.when(F.col("l_tax") == 0, None).when(F.col("l_returnflag") == "R", "duplicate").otherwise("correct")
    records = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") > 1).alias("has_original"), verdict.alias("response"), name.alias("subject"), F.when(F.col("l_discount") >= 0.05, F.concat(F.lit("S"), name)).otherwise(name).alias("original_subject"),
        F.col("l_returnflag").alias("object"), F.nullif("l_linestatus", F.lit("O")).alias("original_object"),
    )
    return funnel.outcomes(records)


@query("SELECT DISTINCT p_size, CASE p_size % 3 WHEN 2 THEN 'tabc' ELSE 't' || (p_size / 100)::DOUBLE END key, CASE p_size % 3 WHEN 2 THEN 'inf'::DOUBLE ELSE p_size / 100 END number FROM part")
def threshold_keys(spark, sf):
    """Thresholds given as numbers, as keys and as other words."""
    text = (F.col("p_size") / 100).cast("string")
    given = F.when(F.col("p_size") % 3 == 2, "abc").when(F.col("p_size") % 3 == 1, F.concat(F.lit("t"), text)).otherwise(text)
    keyed = table(spark, sf, "part").select("p_size", report.threshold_key(given).alias("key")).distinct()
    return keyed.withColumn("number", report.threshold_number(F.col("key")))


@query(G0 + " SELECT (SELECT count(*) FROM nodes)::VARCHAR node_count, (SELECT count(*) FROM edges)::VARCHAR rel_count, 'N/A' wcc_count, 'N/A' leiden_modularity")
def report_aliases(spark, sf):
    """A report's values, whatever they are called in the file that has them."""
    file = graph.overview(nodes(spark, sf), edges(spark, sf)).select("nodes", F.col("edges").alias("edge_count"))
    return file.select(*(report.first_present(file, n).alias(n) for n in ("node_count", "rel_count", "wcc_count", "leiden_modularity")))


# ---------------------------------------------------------------- units and searches

SHOWN_SQL = f"""WITH {FILES_SQL}, f AS (SELECT p_partkey, file, p_partkey % 5 form, regexp_extract(file, '(?:第|ch)([0-9]+)', 1) n FROM files),
    c AS (SELECT *, CASE WHEN form = 0 THEN regexp_extract(file, '章 ([^_.-]+)', 1) END title, CASE WHEN form < 2 THEN n::INT END no FROM f), t AS (SELECT no, arg_max(title, file) last_title FROM c WHERE form = 0 AND no <= 25 GROUP BY 1),
    shown AS (SELECT p_partkey, CASE WHEN form = 2 THEN regexp_extract(file, '(模組.*)[.]pdf', 1) WHEN form < 2 AND no <= 25 THEN '第' || lpad(n, 2, '0') || '章' || coalesce(' ' || coalesce(title, last_title), '') END shown FROM c LEFT JOIN t USING (no))"""


@query(SHOWN_SQL + " SELECT p_partkey, shown FROM shown")
def chapter_names(spark, sf):
    return report.chapter_names(file_names(spark, sf)).select("p_partkey", "shown")


@query(SHOWN_SQL + """ SELECT shown unit, sum(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END)::DOUBLE "count" FROM shown JOIN part USING (p_partkey) WHERE shown IS NOT NULL GROUP BY 1""")
def unit_histogram(spark, sf):
    freq = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double"))
    items = file_names(spark, sf).join(table(spark, sf, "part").select("p_partkey", freq.alias("freq")), "p_partkey")
    return report.unit_histogram(items)


@query(f"WITH {NODES_SQL} SELECT community, count(*) size FROM nodes WHERE community IS NOT NULL GROUP BY 1 HAVING contains(community::VARCHAR, '2') OR bool_or(contains(lower(name), 'customer#00000001'))")
def community_search(spark, sf):
    """Communities whose id or one of whose names holds a text."""
    hit = F.bool_or(F.contains(F.lower("name"), F.lit("customer#00000001")))
    rows = nodes(spark, sf).where("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("size"), hit.alias("hit"))
    return rows.where(F.contains(F.col("community").cast("string"), F.lit("2")) | F.col("hit")).select("community", "size")


@query(f"WITH {NODES_SQL} SELECT id, community FROM nodes WHERE community IN (SELECT community FROM nodes GROUP BY 1 HAVING count(*) >= 10)")
def visible_members(spark, sf):
    """Nodes of the communities that are shown, which a report lists as texts."""
    shown = nodes(spark, sf).groupBy("community").agg(F.count("*").alias("n")).where("n >= 10").select(F.col("community").cast("string").alias("shown"))
    return nodes(spark, sf).join(shown, F.col("community").cast("string") == F.col("shown"), "left_semi").select("id", "community")


@query(f"WITH {EDGES_SQL} SELECT src, rel, dst FROM edges ORDER BY src, rel, dst LIMIT 5000")
def raw_graph(spark, sf):
    """The first edges of a graph for drawing, at most 5,000 as the view has it."""
    return edges(spark, sf).orderBy("src", "rel", "dst").limit(5000)


# ---------------------------------------------------------------- merged graphs and vectors


@query("""WITH n AS (SELECT 's' || l_suppkey id, l_returnflag u FROM lineitem UNION SELECT 'p' || l_partkey, l_returnflag FROM lineitem), e AS (SELECT DISTINCT 's' || l_suppkey src, 'p' || l_partkey dst FROM lineitem WHERE l_returnflag IN ('A', 'R'))
    SELECT (SELECT count(DISTINCT id) FROM n WHERE u IN ('A', 'R')) nodes, (SELECT count(*) FROM e) edges""")
def united_units(spark, sf):
    """The graphs of two units as one."""

    def unit(flag: str) -> tuple[DataFrame, DataFrame]:
        own = table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("makes").alias("rel"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
        return own.select(F.col("src").alias("id")).union(own.select("dst")), own

    n, e = graph.united([unit("A"), unit("R")])
    return n.agg(F.count("*").alias("nodes")).join(e.agg(F.count("*").alias("edges")), how="cross")  # one row each


@query()
def merged_graph(spark, sf):
    """The graph of similar vectors after a sequential merge: edges moved to the nodes that are left."""
    rows = vectors(spark, sf)
    pairs = matching.capped_pairs(matching.similar_pairs(rows, 0.3))
    order = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("similarity"), "id_a", "id_b"))
    into = matching.final_names(matching.sequential_merge(pairs.withColumn("ord", order).select("block", "ord", "id_a", "id_b")))
    links = matching.similar_pairs(rows, 0.25).select(F.col("id_a").alias("src"), F.lit("like").alias("rel"), F.col("id_b").alias("dst"))
    return graph.rewired(links, into)


@query("""SELECT a.vec_id id_a, b.vec_id id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id * 2 + 1""")
def pair_similarity(spark, sf):
    """Given pairs with their cosine; a pair of which a vector is missing is left out."""
    rows = table(spark, sf, "embeddings")
    pairs = rows.select(F.col("vec_id").alias("id_a"), (F.col("vec_id") * 2 + 1).alias("id_b"))
    a, b = rows.select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("va")), rows.select(F.col("vec_id").alias("id_b"), F.col("embedding").alias("vb"))
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", F.round(fn.cosine(F.col("va"), F.col("vb")), 5).alias("similarity"))


@query("""WITH p AS (SELECT a.vec_id x, b.vec_id y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35) SELECT x id FROM p UNION SELECT y FROM p""")
def pair_names(spark, sf):
    """What is named in pairs, once and in order."""
    pairs = matching.similar_pairs(vectors(spark, sf), 0.35)
    return pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct().orderBy("id")


@query()
def seeded_vectors(spark, sf):
    """A unit vector for each kind of part, the same in every run."""
    return table(spark, sf, "part").select("p_type").distinct().withColumn("vector", report.seeded_vector(F.col("p_type")))


@query()
def community_grid(spark, sf):
    """Communities of the bound graph by resolution and least size; ids are numbered in each configuration."""
    return communities.grid(edges(spark, sf), communities.GAMMAS, communities.LEAST_SIZES, side).drop("gamma")


# ---------------------------------------------------------------- answers of models


def extract_stub(prompts: list[str]) -> list[str]:
    """A triple for each two words that follow each other, with words around the JSON."""
    out = []
    for p in prompts:
        words = p.split(" ")
        rows = [{"subject": {"name": a, "type": "word"}, "relation": "precedes", "object": {"name": b, "type": "word"}} for a, b in zip(words, words[1:])]
        out.append(f"Here they are: {json.dumps(rows)}")
    return out


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') w FROM benchmark) SELECT item_id, i::INT source_index, w[i] subject, w[i + 1] AS object FROM (SELECT *, unnest(range(1, len(w))) i FROM w)""")
def triple_extraction(spark, sf):
    """Triples from texts, any number from each."""
    texts = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt"))
    found = models.triples_of(models.ask(texts, "item_id", "prompt", extract_stub), "item_id")
    return found.select("item_id", "source_index", F.col("subject.name").alias("subject"), F.col("object.name").alias("object"))


@query("""SELECT CASE event_id % 4 WHEN 0 THEN 'AC' WHEN 1 THEN 'B' END letters, CASE event_id % 4 WHEN 2 THEN 'schema' WHEN 3 THEN 'parse' END error, count(*) n FROM events GROUP BY event_id % 4""")
def answer_choices(spark, sf):
    """Answers with words around them: right ones, one whose letters don't fit, one without JSON."""
    kind = F.col("event_id") % 4
    answer = F.when(kind == 0, '{"answer": "AC"}').when(kind == 1, 'Sure.\n```json\n{"answer": "B", "reasoning": "x"}\n```\nDone.').when(kind == 2, 'I say {"answer": "A or E"}.').otherwise("None of them")
    letters, error = models.choice(F.col("answer"))
    return table(spark, sf, "events").select(answer.alias("answer")).groupBy(letters.alias("letters"), error.alias("error")).agg(F.count("*").alias("n"))


@query("""SELECT CASE event_id % 3 WHEN 2 THEN 'error' WHEN 1 THEN 'correct' ELSE 'duplicate' END response, CASE event_id % 3 WHEN 0 THEN event_type ELSE '' END standard_subject, count(*) n FROM events GROUP BY ALL""")
def verdicts(spark, sf):
    """Verdicts of validation as fields; what doesn't parse is an error."""
    kind = F.col("event_id") % 3
    same = F.concat(F.lit('Thus: {"response": "duplicate", "reason": "known", "standard_subject": "'), F.col("event_type"), F.lit('"} (sic)'))
    answer = F.when(kind == 0, same).when(kind == 1, '{"response": "correct", "reason": "new"}').otherwise('{"response": ')
    found = table(spark, sf, "events").select(models.verdict(answer).alias("v"))
    return found.groupBy("v.response", "v.standard_subject").agg(F.count("*").alias("n"))


def embed_stub(texts: list[str]) -> list[list[float]]:
    """Eight numbers from a text's bytes; no batch with a text in it that names no finish."""
    if len(texts) > 1 and any(not t for t in texts):
        raise ValueError("empty text")
    return [[float(sum(t.encode()[i::8])) for i in range(8)] for t in texts]


def no_service(texts: list[str]) -> list[list[float]]:
    raise ConnectionError("no service")


@query("SELECT DISTINCT p_type, 8::INT size FROM part")
def embedding_cache(spark, sf):
    """Vectors of all kinds of parts, read from the cache by a second run that has no service."""
    cache, kinds = fresh(spark, "embeddings"), table(spark, sf, "part").select("p_type")
    models.embed(kinds, "p_type", embed_stub, 8, cache)
    return models.embed(kinds, "p_type", no_service, 8, cache).select("p_type", F.size("vector").alias("size"))


# ---------------------------------------------------------------- evidence


def claim_answer(qid: int, names: list[str]) -> str:
    """What a model may answer: JSON in a fence, numbered lines, or nothing of use."""
    if qid % 3 == 0:
        return "Sure:\n```json\n" + json.dumps({"sub_claims": [{"sentence": "They trade.", "entities": [*names, "third"]}, {"sentence": " ", "entities": names}]}) + "\n```"
    if qid % 3 == 1:
        return f"1. They trade, Entity set: ['{names[0]}' ## {names[1]}]\nnot a claim\n2. No entity Entity set: []"
    return "I can't tell."


def claims_stub(stems: list[str]) -> list[str]:
    return [claim_answer(int(s.split("|")[0]), s.split("|")[1:]) for s in stems]


def claims_again(stems: list[str]) -> list[str]:
    return [claim_answer(0, s.split("|")[1:]) for s in stems]


def relations_stub(prompts: list[str]) -> list[str]:
    return ["[" + ", ".join(p.split("\n")[-1].split(", ")[:3]) + "]" for p in prompts]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """qid, stem: a nation and a supplier to ask about for each benchmark item."""
    qid = F.col("item_id").cast("long")
    supplier = F.concat(F.lit("SUPPLIER#"), F.lpad((qid % 50).cast("string"), 9, "0"))
    return table(spark, sf, "benchmark").select(qid.alias("qid"), F.concat_ws("|", qid.cast("string"), F.concat(F.lit("NATION_"), (qid % 25).cast("string")), supplier).alias("stem"))


@query("""SELECT item_id::BIGINT qid, 1 AS place, CASE item_id % 3 WHEN 0 THEN 'They trade.' ELSE 'They trade' END sentence, 'NATION_' || (item_id % 25) || ',SUPPLIER#' || lpad((item_id % 50)::VARCHAR, 9, '0') entities FROM benchmark WHERE item_id % 3 < 2""")
def claim_parse(spark, sf):
    """Claims and their entities from answers of each form; answers without give none."""
    found = evidence.sub_claims(models.ask(questions(spark, sf), "qid", "stem", claims_stub))
    return found.select("qid", "place", "sentence", F.array_join("entities", ",").alias("entities"))


@query()
def evidence_retrieval(spark, sf):
    """The evidence that is kept for each question and how its claims were got: claims, links, relations, triples of one and two hops."""
    found, outcomes = evidence.retrieve(questions(spark, sf), nodes(spark, sf), edges(spark, sf), claims_stub, relations_stub, claims_again)
    return outcomes.join(found, "qid", "left")
