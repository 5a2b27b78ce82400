"""Smaller operators of the graph's views, reports and imports, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import models
from strandline.functions import text as fn
from strandline.operators import communities as moving
from strandline.operators import graph, matching, views
from strandline.operators.ranges import places
from strandline.plans.graph_binding import EDGES_SQL, G0, MENTIONS_SQL, edge_ends, edges, mentions, nodes, placed_edges, side as side_of, table
from strandline.plans.table_queries import FILES_SQL, file_names, vectors
from strandline.sources.staging import Steps

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


@query(G0 + " SELECT id, label FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def isolated_nodes(spark, sf):
    return nodes(spark, sf).join(edge_ends(spark, sf), "id", "left_anti").select("id", "label")


@query(f"WITH {EDGES_SQL}, e AS (SELECT src id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) degree, CASE WHEN count(*) <= 2 THEN 'ring' ELSE 'core' END place FROM e GROUP BY 1")
def degree_rings(spark, sf):
    ends = edges(spark, sf).select(F.col("src").alias("id")).union(edges(spark, sf).select("dst"))
    rows = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return rows.withColumn("place", F.when(F.col("degree") <= 2, "ring").otherwise("core"))


@query(G0 + """, s AS (SELECT community, count(*) n FROM nodes WHERE community IS NOT NULL GROUP BY 1), i AS (SELECT a.community, count(*) e FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.community = b.community GROUP BY 1)
    SELECT community, n, round(coalesce(e, 0) / n, 6) density, CASE WHEN coalesce(e, 0) / n < 0.3 OR n > 20 THEN 'tags' ELSE 'graph' END AS view FROM s LEFT JOIN i USING (community)""")
def edge_density(spark, sf):
    sizes = nodes(spark, sf).where("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("n"))
    inside = graph.with_communities(placed_edges(spark, sf), nodes(spark, sf)).where("src_cid = dst_cid").groupBy(F.col("src_cid").alias("community")).agg(F.count("*").alias("e"))
    density = F.coalesce("e", F.lit(0)) / F.col("n")
    view = F.when((density < 0.3) | (F.col("n") > 20), "tags").otherwise("graph")
    return sizes.join(inside, "community", "left").select("community", "n", F.round(density, 6).alias("density"), view.alias("view"))


@query(G0 + """, l AS (SELECT DISTINCT 'customer/' || c_name id FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F')
    SELECT community, count(*) size, count(l.id) learned, CAST(floor(100.0 * count(l.id) / count(*) + 0.5) AS INT) percent FROM nodes LEFT JOIN l USING (id) WHERE label = 'customer' GROUP BY 1""")
def progress_share(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    done = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("customer/"), "c_name").alias("id"), F.lit(1).alias("done")).distinct()
    rows = nodes(spark, sf).where("label = 'customer'").join(done, "id", "left").groupBy("community").agg(F.count("*").alias("size"), F.count("done").alias("learned"))
    return rows.withColumn("percent", F.floor(100.0 * F.col("learned") / F.col("size") + 0.5).cast("int"))


@query("""WITH c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR || '.0' ELSE c_nationkey::VARCHAR END cid FROM customer)
    SELECT coalesce(regexp_replace(cid, '[.]0$', ''), 'UNKNOWN') cid, count(*) n, row_number() OVER (ORDER BY TRY_CAST(coalesce(regexp_replace(cid, '[.]0$', ''), 'UNKNOWN') AS DOUBLE) NULLS LAST) place FROM c GROUP BY 1""")
def canonical_ids(spark, sf):
    """Ids as text, with and without a decimal, missing ones UNKNOWN; numbers first in order."""
    key = F.col("c_custkey")
    raw = F.when(key % 10 == 0, None).when(key % 3 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))).otherwise(F.col("c_nationkey").cast("string"))
    rows = table(spark, sf, "customer").groupBy(fn.canonical_id(raw).alias("cid")).agg(F.count("*").alias("n"))
    number = F.col("cid").try_cast("double")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(number.isNull(), number, "cid")).cast("long"))


@query(f"""WITH {FILES_SQL}, s AS (SELECT file, p_partkey % 4 s FROM files) SELECT CASE s WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'invalid' ELSE 'ok' END state, count(*) n FROM s GROUP BY 1""")
def file_states(spark, sf):
    """What became of each expected file: no output, an empty one, one that doesn't parse, a good one."""
    expected = file_names(spark, sf)
    outputs = expected.where("p_partkey % 4 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 1, "[]").when(F.col("p_partkey") % 4 == 2, "[{").otherwise('[{"a": 1}]').alias("body"))
    parsed = F.try_parse_json("body")
    state = F.when(F.col("body").isNull(), "missing").when(F.trim("body").isin("", "[]"), "empty").when(parsed.isNull(), "invalid").otherwise("ok")
    return expected.join(outputs, "p_partkey", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT page_id, '--[' || split_part(url, '/', 4) || ']-->' rel, split_part(url, '/', 3) host, coalesce(nullif(split_part(url, '/', 5), ''), '-') tail FROM pages)
    SELECT page_id, host || ' ' || rel || ' ' || tail evidence, host head, rel[4:-5] relation, tail FROM q""")
def evidence_text(spark, sf):
    """Triples as text and read back from it."""
    parts = F.split("url", "/")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    tail = F.when(at(4) == "", "-").otherwise(at(4))
    rows = table(spark, sf, "pages").select("page_id", F.concat(at(2), F.lit(" --["), at(3), F.lit("]--> "), tail).alias("evidence"))
    form = r"^(.*?) --\[(.*?)\]--> (.*)$"
    return rows.select("page_id", "evidence", *(F.regexp_extract("evidence", form, i).alias(n) for i, n in ((1, "head"), (2, "relation"), (3, "tail"))))


@query("""SELECT item_id, '(A) ' || split_part(text, ' ', 1) || chr(10) || '(B) ' || split_part(text, ' ', 2) || chr(10) || '(C) ' || split_part(text, ' ', 3) options, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END context FROM benchmark""")
def question_text(spark, sf):
    """Options of a question by letter, and its context cut to a length."""
    words = F.split("text", " ")
    options = F.create_map(*[x for i, c in ((2, "C"), (0, "A"), (1, "B")) for x in (F.lit(c), F.get(words, F.lit(i)))])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda x: F.concat(F.lit("("), x["key"], F.lit(") "), x["value"])), "\n")
    context = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", shown.alias("options"), context.alias("context"))


@query(f"WITH {MENTIONS_SQL}, f AS (SELECT name, arg_min(label, ord) first_label FROM mentions GROUP BY 1) SELECT label, first_label, count(*) n FROM mentions JOIN f USING (name) GROUP BY 1, 2")
def type_conflicts(spark, sf):
    """Mentions by their label and by the label of the name's first mention, which wins."""
    rows = mentions(spark, sf)
    first = graph.fold_nodes_by_name(rows).select("name", F.col("label").alias("first_label"))
    return rows.join(first, "name").groupBy("label", "first_label").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_partkey p, p_name nm, 1 side, l_quantity q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'), b AS (SELECT l_partkey, p_name, 2, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
    u AS (SELECT p, nm, min(side) first_side, max(q) q FROM (FROM a UNION ALL FROM b) GROUP BY 1, 2) SELECT first_side, count(*) n, count(DISTINCT nm) names, sum(q) q FROM u GROUP BY 1""")
def candidate_union(spark, sf):
    """Candidates of two sides, each once, the first side's first."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    side = lambda flag, n: lines.where(F.col("l_returnflag") == flag).select("l_partkey", "p_name", F.lit(n).alias("side"), "l_quantity")
    each = side("A", 1).unionByName(side("R", 2)).groupBy("l_partkey", "p_name").agg(F.min("side").alias("first_side"), F.max("l_quantity").alias("q"))
    return each.groupBy("first_side").agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("names"), F.sum("q").alias("q"))


@query("""WITH f AS (SELECT p_brand b, l_suppkey s, count(*) n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2) SELECT left(b, 7) unit, sum(n)::BIGINT summed, count(DISTINCT s) AS distinct_nodes FROM f GROUP BY 1""")
def chapter_totals(spark, sf):
    """Nodes of files regrouped by unit: summed over files, which counts shared ones again, and distinct."""
    rows = table(spark, sf, "part").join(table(spark, sf, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.left("p_brand", F.lit(7)).alias("unit")).agg(F.count("*").alias("summed"), F.countDistinct("l_suppkey").alias("distinct_nodes"))


@query("""WITH s AS (SELECT l_linenumber cfg, l_suppkey c, count(*) n FROM lineitem GROUP BY 1, 2) SELECT cfg, count(*) communities, max(n) largest, round(avg(n), 6) mean, median(n) middle, round(avg(CASE WHEN n < 3 THEN 1 ELSE 0 END), 6) small FROM s GROUP BY 1""")
def config_summary(spark, sf):
    """Size distributions of configurations."""
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("cfg"), "l_suppkey").agg(F.count("*").alias("n"))
    return sizes.groupBy("cfg").agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("middle"), F.round(F.avg((F.col("n") < 3).cast("int")), 6).alias("small"))


@query("""WITH x AS (SELECT o_custkey c, count(*) size, count(DISTINCT o_orderpriority) layers FROM orders GROUP BY 1 HAVING count(*) >= 10) SELECT c, size, layers FROM x ORDER BY layers DESC, size DESC, c DESC LIMIT 3""")
def example_communities(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("size"), F.countDistinct("o_orderpriority").alias("layers"))
    return rows.where("size >= 10").orderBy(F.desc("layers"), F.desc("size"), F.desc("c")).limit(3)


@query("""WITH r AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) a, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) b, count(*) n FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT count(*) total, sum(a)::BIGINT first, sum(b)::BIGINT AS second, round(100.0 * (sum(b) - sum(a)) / count(*), 4) delta, round(avg(n), 4) mean_n, max(n) max_n FROM r WHERE n > 0""")
def paired_slices(spark, sf):
    """Two conditions on the same subjects, their difference in points, error records left out."""
    has = lambda kind: F.max((F.col("event_type") == kind).cast("int"))
    rows = table(spark, sf, "events").where("event_type <> 'error'").groupBy("user_id").agg(has("view").alias("a"), has("purchase").alias("b"), F.count("*").alias("n"))
    delta = F.round(100.0 * (F.sum("b") - F.sum("a")) / F.count("*"), 4)
    return rows.agg(F.count("*").alias("total"), F.sum("a").alias("first"), F.sum("b").alias("second"), delta.alias("delta"), F.round(F.avg("n"), 4).alias("mean_n"), F.max("n").alias("max_n"))


@query("""SELECT source, count(*) records, count(l.doc_id) AS judged, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT empty, round(100.0 * count(l.doc_id) / count(*), 2)::DOUBLE share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def retrieval_stats(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    share = F.round(100.0 * F.count("l") / F.count("*"), 2)
    return rows.groupBy("source").agg(F.count("*").alias("records"), F.count("l").alias("judged"), F.sum(F.col("l").isNull().cast("long")).alias("empty"), share.alias("share"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'licensed under') AND NOT regexp_matches(lower(text), 'token')")
def contradiction_hints(spark, sf):
    """Texts with one sort of keyword and none of the other."""
    low = F.lower("text")
    return table(spark, sf, "documents").where(F.rlike(low, F.lit("licensed under")) & ~F.rlike(low, F.lit("token"))).select("doc_id")


@query()
def merge_stats(spark, sf):
    """What a sequential merge does to a graph of vectors, whose types are the remainders of their ids by 3."""
    rows = vectors(spark, sf)
    pairs = matching.capped_pairs(matching.similar_pairs(rows, 0.3))
    ordered = places(pairs, ["block"], [F.desc("similarity"), F.col("id_a"), F.col("id_b")], Steps(spark, "merge"), "pairs")
    merged = matching.sequential_merge(ordered.select("block", F.col("_place").alias("ord"), "id_a", "id_b"))
    links = matching.similar_pairs(rows, 0.25).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    types = rows.select("id", (F.col("id") % 3).alias("type"))
    return views.merge_statistics(merged, types, links, matching.final_names(merged))


@query()
def model_decisions(spark, sf):
    """Decisions of the stub model on the most similar pairs, counted by threshold."""
    pairs = matching.similar_pairs(vectors(spark, sf), 0.3).select(F.concat_ws("|", "id_a", "id_b").alias("pair"))
    answers = models.ask(pairs.withColumn("prompt", F.concat(F.lit("same? "), "pair")), "pair", "prompt")
    parsed = answers.select(F.get_json_object("answer", "$.decision").alias("decision"), F.get_json_object("answer", "$.confidence").cast("double").alias("confidence"))
    return matching.by_threshold(parsed, [0.5, 0.7, 0.9])


@query()
def community_detection(spark, sf):
    """Communities of the bound graph: id, community of every node; a node without edges is its own."""
    found = moving.communities(edges(spark, sf), side=side_of)
    return nodes(spark, sf).select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
