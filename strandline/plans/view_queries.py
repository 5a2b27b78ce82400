"""Queries of the views of a graph, of tolerant scans and of choices between configurations, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import ontology
from strandline.functions import report
from strandline.functions import text as fn
from strandline.operators import communities, evidence, funnel, graph, matching, views
from strandline.operators.ranges import running
from strandline.plans.graph_binding import EDGES_SQL, G0, NODES_SQL, TRIPLES_SQL, edges, inside_edges, nodes, placed_edges, side, table, triples
from strandline.plans.graph_queries import LAYER_SQL, linked_mentions
from strandline.plans.table_queries import FILES_SQL, file_names, vectors
from strandline.sources import triples as sources
from strandline.sources.staging import Steps, shared_dir

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


# ---------------------------------------------------------------- views


@query(G0 + " SELECT a.name source, a.label source_type, rel relationship, b.name target, b.label target_type FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id")
def edge_view(spark, sf):
    return views.edge_view(edges(spark, sf), nodes(spark, sf))


@query(G0 + """, t AS (SELECT src id, src, rel, dst FROM edges UNION ALL SELECT dst, src, rel, dst FROM edges WHERE src <> dst)
    SELECT id, src, rel, dst FROM t WHERE id IN (SELECT id FROM nodes WHERE label IN ('supplier', 'nation')) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rel, src, dst) <= 20""")
def surroundings(spark, sf):
    """The first 20 edges of each supplier and nation, as the view of a node has them."""
    return views.surroundings(edges(spark, sf), nodes(spark, sf).where("label IN ('supplier', 'nation')"))


@query(G0 + """ SELECT DISTINCT dst id, src AS other, 'prerequisite' side FROM edges WHERE dst LIKE 'nation/%' AND src <> dst UNION SELECT src, dst, 'dependent' FROM edges WHERE src LIKE 'nation/%'""")
def prerequisites(spark, sf):
    return views.around(edges(spark, sf), nodes(spark, sf).where("label = 'nation'"))


@query(G0 + LAYER_SQL + """ SELECT n.id, n.label, degree, row_number() OVER (PARTITION BY n.label ORDER BY degree DESC NULLS FIRST, n.name, n.id) place FROM nodes n LEFT JOIN l USING (id)""")
def node_order(spark, sf):
    """Nodes of each label in the order of the view, those without a degree first."""
    degrees = graph.intra_degree_layers(inside_edges(spark, sf), nodes(spark, sf)).select("id", "degree")
    return views.node_order(nodes(spark, sf).join(degrees, "id", "left"), ["label"]).select("id", "label", "degree", "place")


@query(G0 + LAYER_SQL + """ SELECT n.community, coalesce(layer, 0)::BIGINT layer, count(*) n FROM nodes n LEFT JOIN (SELECT id, layer FROM l WHERE degree > 0) USING (id) GROUP BY 1, 2""")
def layer_groups(spark, sf):
    """Nodes of each community by level; those without a level, here those that lead nowhere in it, are at level 0."""
    levels = graph.intra_degree_layers(inside_edges(spark, sf), nodes(spark, sf)).where("degree > 0").select("id", F.col("layer").cast("long").alias("layer"))
    rows = nodes(spark, sf).join(levels, "id", "left").withColumn("layer", F.coalesce("layer", F.lit(0).cast("long")))
    return rows.groupBy("community", "layer").agg(F.count("*").alias("n"))


@query(f"""WITH {FILES_SQL} SELECT count(DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'CH' || lpad(regexp_extract(file, '第([0-9]+)', 1), 2, '0') WHEN 1 THEN 'CH' || lpad(regexp_extract(file, 'ch([0-9]+)', 1), 2, '0')
    WHEN 2 THEN 'MOD' || lpad(regexp_extract(file, '模組([0-9]+)', 1), 2, '0') END) units, count(DISTINCT file) files FROM files""")
def unit_count(spark, sf):
    """How many chapters and modules all files belong to."""
    files = file_names(spark, sf)
    return files.agg(F.countDistinct(fn.unit_key(F.col("file"))).alias("units"), F.countDistinct("file").alias("files"))


@query(f"WITH {NODES_SQL} SELECT id, label || ',KGNode' labels, label AS type FROM nodes")
def common_label(spark, sf):
    return views.with_common_label(nodes(spark, sf)).select("id", F.array_join("labels", ",").alias("labels"), "type")


@query(f"""WITH {EDGES_SQL}, p AS (SELECT src, dst FROM edges WHERE rel IN ('uses', 'generates') UNION ALL SELECT dst, src FROM edges WHERE rel IN ('uses', 'generates') AND src <> dst) SELECT src id, count(*) degree FROM p GROUP BY 1""")
def projection(spark, sf):
    """Degrees in the graph of two relations without direction."""
    return views.projected(edges(spark, sf), ["uses", "generates"]).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


@query(f"WITH {TRIPLES_SQL} SELECT s_name || ' ' || s_type AS value, count(*) n FROM triples WHERE rel <> 'uses' GROUP BY 1 ORDER BY n DESC, value LIMIT 30")
def frequent_names(spark, sf):
    """The 30 most frequent subjects by name and type."""
    found = funnel.frequency(triples(spark, sf).where("rel <> 'uses'"), F.concat_ws(" ", "s_name", "s_type"))
    return views.limited(found, [F.desc("n"), F.col("value")], 30)


@query(f"""WITH {TRIPLES_SQL} SELECT s_type IN {tuple(ontology.CLASSES)} known_subject, rel IN {tuple(ontology.RELATIONS)} known_relation, o_type IN {tuple(ontology.CLASSES)} known_object, count(*) n FROM triples GROUP BY 1, 2, 3""")
def class_membership(spark, sf):
    """Whether the classes and the relation of each triple are among those of the ontology."""
    known = lambda c, names: F.col(c).isin(*names)
    rows = triples(spark, sf).select(known("s_type", ontology.CLASSES).alias("known_subject"), known("rel", ontology.RELATIONS).alias("known_relation"), known("o_type", ontology.CLASSES).alias("known_object"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under') AND NOT contains(lower(text), 'token') ORDER BY doc_id LIMIT 30")
def first_hints(spark, sf):
    """The first 30 texts with one sort of keyword and none of the other, as the report has them."""
    return views.hints(table(spark, sf, "documents"), "text", "doc_id", "licensed under", "token").select("doc_id")


# ---------------------------------------------------------------- units of files

LOOKUP_SQL = r"""WITH p AS (SELECT p_partkey, p_brand b, p_size s FROM part),
    m AS (SELECT DISTINCT CASE WHEN s % 2 = 0 THEN 'raw/' || b || '/' || s || '.pdf' ELSE 'raw\' || b || '\' || s || '.pdf' END source, 'CH' || right(b, 2) unit, b || lpad(s::VARCHAR, 3, '0') ord FROM p),
    k AS (SELECT unit, ord, unnest([source, regexp_extract(source, '([^/]*)/*$', 1), replace(source, '\', '/')]) key, unnest([0, 1, 2]) way FROM m),
    u AS (SELECT key, arg_max(unit, (ord, way)) unit FROM k GROUP BY 1),
    f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'raw\' || b || '\' || s || '.pdf' WHEN 1 THEN 'else/' || s || '.pdf' ELSE 'raw/' || b || '/' || s || '.pdf' END file FROM p)"""


@query(LOOKUP_SQL + r""" SELECT p_partkey, coalesce(x.unit, y.unit, z.unit) unit FROM f LEFT JOIN u x ON x.key = file LEFT JOIN u y ON y.key = regexp_extract(file, '([^/]*)/*$', 1) LEFT JOIN u z ON z.key = replace(file, '\', '/')""")
def unit_lookup(spark, sf):
    """Units of files that are named by their path, by their base name, or with other slashes."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("b"), F.col("p_size").cast("string").alias("s"), (F.col("p_size") % 2 == 0).alias("even"))
    path = lambda slash: F.concat(F.lit("raw"), F.lit(slash), "b", F.lit(slash), "s", F.lit(".pdf"))
    mapping = part.select(F.when(F.col("even"), path("/")).otherwise(path("\\")).alias("source"), F.concat(F.lit("CH"), F.right("b", F.lit(2))).alias("unit"), F.concat("b", F.lpad("s", 3, "0")).alias("ord")).distinct()
    form = F.col("p_partkey") % 3
    files = part.select("p_partkey", F.when(form == 0, path("\\")).when(form == 1, F.concat(F.lit("else/"), "s", F.lit(".pdf"))).otherwise(path("/")).alias("file"))
    return views.unit_lookup(files, mapping).select("p_partkey", "unit")


@query("""WITH r AS (SELECT p_partkey // 100 f, p_partkey, p_size, (p_partkey // 100) % 5 kind FROM part)
    SELECT CASE kind WHEN 0 THEN 'accepted' WHEN 1 THEN 'bad JSON' WHEN 2 THEN 'no array' WHEN 3 THEN 'empty' ELSE 'accepted' END outcome, count(DISTINCT f) files, count(*) FILTER (kind IN (0, 4)) records FROM r WHERE NOT (kind IN (0, 4) AND p_size % 7 = 0) GROUP BY 1
    UNION ALL SELECT 'no relation', count(DISTINCT f), count(*) FROM r WHERE kind IN (0, 4) AND p_size % 7 = 0""")
def scan_faults(spark, sf):
    """What a scan of files finds that hold a triple per part, a hundred to a file: good ones, cut ones, objects in place of arrays, empty ones, and records without relation."""
    file, kind = F.floor(F.col("p_partkey") / 100), F.floor(F.col("p_partkey") / 100) % 5
    thing = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("type"))
    record = F.struct(thing(F.col("p_name"), "part").alias("subject"), F.when(F.col("p_size") % 7 > 0, F.lit("has_a")).alias("relation"), thing(F.col("p_brand"), "brand").alias("object"))
    rows = table(spark, sf, "part").groupBy(file.alias("f"), kind.alias("kind")).agg(F.to_json(F.collect_list(record)).alias("body"))  # a hundred to a file
    body = F.when(F.col("kind") == 1, F.left("body", F.length("body") - 1)).when(F.col("kind") == 2, F.get(F.expr("from_json(body, 'array<string>')"), F.lit(0))).when(F.col("kind") == 3, F.lit("[]")).otherwise(F.col("body"))
    path = f"{shared_dir(spark)}/strandline/scan-{uuid.uuid4().hex}"
    rows.select("f", body.alias("body")).write.partitionBy("f").text(path)
    return sources.scan_counts(*sources.scan_triples(spark, path, pattern="*.txt"))


@query(G0 + " SELECT 'label' kind, label AS value, count(*) n FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', rel, count(*) FROM edges GROUP BY 2")
def backup_histograms(spark, sf):
    path = f"{shared_dir(spark)}/strandline/backup-{uuid.uuid4().hex}"
    sources.backup(nodes(spark, sf), edges(spark, sf), path)
    return sources.histograms(spark, path)


# ---------------------------------------------------------------- texts and numbers


@query("""WITH e AS (SELECT event_id, event_id % 6 kind, chr((65 + json_extract_string(props, '$.k')::INT % 4)::INT) letter, event_type t FROM events)
    SELECT event_id, CASE kind WHEN 0 THEN letter WHEN 1 THEN letter || ', D' WHEN 2 THEN letter || ' ,D' ELSE '' END answer, CASE kind WHEN 0 THEN t WHEN 1 THEN '' WHEN 2 THEN 'So ANSWER: the answer： "' || letter || ' ,D" for ' || t WHEN 3 THEN 'no letter for ' || t WHEN 5 THEN '["' || letter || '"]' ELSE '' END reasoning,
      CASE kind WHEN 2 THEN 'regex_fallback' WHEN 3 THEN 'no_match' WHEN 4 THEN 'empty' WHEN 5 THEN 'no_match' END parse_error FROM e""")
def answer_fields(spark, sf):
    """Answers to events in each form: JSON, JSON in a fence, a phrase, neither, nothing, an array."""
    kind, letter, t = F.col("event_id") % 6, F.substring(F.lit("ABCD"), F.get_json_object("props", "$.k").cast("int") % 4 + 1, F.lit(1)), F.col("event_type")
    fenced = F.concat(F.lit('Well:\n```json\n{"answer": " '), letter, F.lit(', D"}\n``` done'))
    raw = F.when(kind == 0, F.concat(F.lit('{"answer": "'), letter, F.lit('", "reasoning": "'), t, F.lit('"}'))).when(kind == 1, fenced).when(kind == 2, F.concat(F.lit('So ANSWER: the answer： "'), letter, F.lit(' ,D" for '), t))
    raw = raw.when(kind == 3, F.concat(F.lit("no letter for "), t)).when(kind == 4, F.lit("")).otherwise(F.concat(F.lit('["'), letter, F.lit('"]')))
    return table(spark, sf, "events").select("event_id", fn.answer_of(raw).alias("a")).select("event_id", "a.*")


@query("""SELECT p_partkey, round(list_reduce(list_transform(string_split(p_name || ':' || p_size, ''), lambda c: ascii(c)::UBIGINT), lambda h, c: (xor(h::UBIGINT, c::UBIGINT) * 16777619::UBIGINT) & 4294967295::UBIGINT, 2166136261::UBIGINT) / 4294967295, 9) place FROM part""")
def layout_places(spark, sf):
    """A place from 0 to 1 for each part, fixed by its name and size."""
    return table(spark, sf, "part").select("p_partkey", F.round(report.hash_to_unit(F.col("p_name"), F.col("p_size")), 9).alias("place"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE trunc(c_acctbal)::BIGINT END whole FROM customer")
def whole_numbers(spark, sf):
    """Balances given as texts with a point, between blanks, or with a word."""
    text, kind = F.col("c_acctbal").cast("string"), F.col("c_custkey") % 4
    given = F.when(kind == 1, F.concat(F.lit(" "), text, F.lit(" "))).when(kind == 3, F.concat(F.lit("about "), text)).otherwise(text)
    return table(spark, sf, "customer").select("c_custkey", fn.whole_number(given).alias("whole"))


@query("""WITH p AS (SELECT a.vec_id id_a, b.vec_id id_b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35)
    SELECT 'pair_' || CASE WHEN n < 100000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END pair_id, id_a, id_b FROM (SELECT *, row_number() OVER (ORDER BY id_a, id_b) n FROM p)""")
def pair_ids(spark, sf):
    """Similar pairs with numbers in order."""
    pairs = matching.similar_pairs(vectors(spark, sf), 0.35).select("id_a", "id_b")
    rows = running(pairs, [F.col("id_a"), F.col("id_b")], [], Steps(spark, "pairs"), "pairs")
    return rows.select(report.numbered("pair_", F.col("_rank"), 5).alias("pair_id"), "id_a", "id_b")


# ---------------------------------------------------------------- choices

THRESHOLDS_SQL = """WITH t AS (SELECT l_linenumber / 10 threshold, round(avg(CASE WHEN l_discount < 0.001 AND l_linenumber > 4 THEN 1 ELSE 0 END), 4) cross_rate, round(count(DISTINCT l_suppkey) / max(l_suppkey), 3) reduction,
    CASE WHEN l_linenumber > 1 THEN round(avg(l_discount), 6) END modularity FROM lineitem GROUP BY l_linenumber)"""


@query(THRESHOLDS_SQL + " SELECT threshold, cross_rate, reduction FROM t WHERE (SELECT min(cross_rate) FROM t) > 0 OR cross_rate = 0 ORDER BY reduction DESC, coalesce(modularity, 0) DESC, threshold LIMIT 1")
def threshold_choice(spark, sf):
    """Line numbers as thresholds: the one to go on with."""
    n = F.col("l_linenumber")
    cross = F.when((F.col("l_discount") < 0.001) & (n > 4), 1).otherwise(0)
    rows = table(spark, sf, "lineitem").groupBy(n).agg(F.round(F.avg(cross), 4).alias("cross_rate"), F.round(F.countDistinct("l_suppkey") / F.max("l_suppkey"), 3).alias("reduction"), F.round(F.avg("l_discount"), 6).alias("m"))
    rows = rows.select((n / 10).alias("threshold"), "cross_rate", "reduction", F.when(n > 1, F.col("m")).alias("modularity"))
    return views.best_threshold(rows).select("threshold", "cross_rate", "reduction")


@query(G0 + """, q AS (SELECT item_id qid, unnest(['NATION_' || (item_id % 25), 'SUPPLIER#' || lpad((item_id % 50)::VARCHAR, 9, '0')]) mention FROM benchmark),
    l AS (SELECT qid, lower(mention) k, min(nodes.id) id FROM q JOIN nodes ON lower(mention) = lower(name) GROUP BY 1, 2),
    x AS (SELECT DISTINCT qid, src head, rel, dst tail, 'out' way, l.id, dst other FROM l JOIN edges ON src = l.id UNION SELECT qid, src, rel, dst, 'in', l.id, src FROM l JOIN edges ON dst = l.id),
    e AS (SELECT DISTINCT qid, head, rel, tail FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY qid, id, rel, way ORDER BY other) <= 50)),
    c AS (SELECT item_id qid, count(e.qid) n FROM benchmark LEFT JOIN e ON e.qid = item_id GROUP BY 1)
    SELECT count(*) questions, count(*) FILTER (n > 0) filled, count(*) FILTER (n = 0) empty, round(100.0 * count(*) FILTER (n > 0) / count(*), 2)::DOUBLE share, round(avg(n), 4) mean_edges, max(n) max_edges FROM c""")
def retrieval_run(spark, sf):
    """What expansion gave for all questions: filled and empty ones, and the number of triples."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    return evidence.run_statistics(asked, evidence.expand(linked_mentions(spark, sf), edges(spark, sf)))


@query()
def community_choice(spark, sf):
    """Every configuration of the grid with what it is judged by, and which one is chosen."""
    steps = Steps(spark, "choice")
    links = steps(edges(spark, sf).select("src", "dst"))
    found = steps(communities.grid(links, communities.GAMMAS, communities.LEAST_SIZES, side))
    judged = steps(communities.judged(found, links))
    best = communities.chosen(judged).select("config", F.lit(True).alias("chosen"))
    return judged.join(best, "config", "left").fillna(False, ["chosen"])
