"""Queries of texts, units, statistics, matching and state over the tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text as fn
from strandline.operators import evidence, funnel, matching, stats
from strandline.plans.graph_binding import G0, edges, nodes, table
from strandline.sources import triples as sources

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


# ---------------------------------------------------------------- units and names


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """A source-file name of each form for every part."""
    part = table(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("n"), F.replace("p_name", F.lit(" "), F.lit("")).alias("t"))
    form = F.col("p_partkey") % 5
    name = (
        F.when(form == 0, F.concat(F.lit("第"), "n", F.lit("章 "), "t", F.lit("_e5.pdf")))
        .when(form == 1, F.concat(F.lit("ch"), "n", F.lit("_習題解答.pdf")))
        .when(form == 2, F.concat(F.lit("iPAS_模組"), "n", F.lit("-"), "t", F.lit(".pdf")))
        .when(form == 3, F.concat("t", F.lit("_exam_"), "n", F.lit(".json")))
        .otherwise(F.concat("t", F.lit("_"), "n", F.lit(".json")))
    )
    return part.select("p_partkey", name.alias("file"))


FILES_SQL = """files AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '第' || n || '章 ' || t || '_e5.pdf' WHEN 1 THEN 'ch' || n || '_習題解答.pdf'
    WHEN 2 THEN 'iPAS_模組' || n || '-' || t || '.pdf' WHEN 3 THEN t || '_exam_' || n || '.json' ELSE t || '_' || n || '.json' END file
  FROM (SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) n, replace(p_name, ' ', '') t FROM part))"""


@query(f"""WITH {FILES_SQL} SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CH' || lpad(regexp_extract(file, '第([0-9]+)', 1), 2, '0')
    WHEN 1 THEN 'CH' || lpad(regexp_extract(file, 'ch([0-9]+)', 1), 2, '0') WHEN 2 THEN 'MOD' || lpad(regexp_extract(file, '模組([0-9]+)', 1), 2, '0') END key FROM files""")
def unit_key(spark, sf):
    return file_names(spark, sf).select("p_partkey", fn.unit_key(F.col("file")).alias("key"))


UNIT_SQL = f"""WITH {FILES_SQL}, u AS (SELECT p_partkey, file, CASE p_partkey % 5
    WHEN 0 THEN lpad(regexp_extract(file, '第([0-9]+)', 1), 2, '0') || '_' || regexp_extract(file, '章 (.*)_e5', 1)
    WHEN 1 THEN lpad(regexp_extract(file, 'ch([0-9]+)', 1), 2, '0') || '_習題解答' WHEN 2 THEN 'M_' || regexp_extract(file, '-(.*)[.]pdf', 1) WHEN 3 THEN 'SKIP' ELSE 'UNMATCHED' END unit,
    CASE p_partkey % 5 WHEN 0 THEN '章節' WHEN 1 THEN '章節' WHEN 2 THEN '模組' WHEN 3 THEN '題庫' ELSE 'UNMATCHED' END category,
    CASE WHEN p_partkey % 5 < 2 THEN regexp_extract(file, '(?:第|ch)([0-9]+)', 1)::INT END no, p_partkey % 5 = 1 exercise FROM files),
  titles AS (SELECT no, arg_max(unit, file) title FROM u WHERE no IS NOT NULL AND NOT exercise GROUP BY 1),
  mapped AS (SELECT u.p_partkey, u.file, CASE WHEN exercise THEN coalesce(title, unit) ELSE unit END unit, category FROM u LEFT JOIN titles USING (no))"""


def mapped_units(files: DataFrame) -> DataFrame:
    """files (file, ...) with unit and category; an exercise takes the unit of the chapter of its number, of several the last file's."""
    rows = files.withColumn("_u", fn.unit_struct(F.col("file"))).select(*files.columns, "_u.*")
    titles = rows.where("chapter_no IS NOT NULL AND NOT is_exercise").groupBy("chapter_no").agg(F.max_by("unit", "file").alias("title"))
    rows = rows.join(titles, "chapter_no", "left").withColumn("unit", F.when(F.col("is_exercise"), F.coalesce("title", "unit")).otherwise(F.col("unit")))
    return rows.select(*files.columns, "unit", "category")


@query(UNIT_SQL + " SELECT p_partkey, unit, category FROM mapped")
def unit_mapping(spark, sf):
    return mapped_units(file_names(spark, sf)).select("p_partkey", "unit", "category")


@query(UNIT_SQL + " SELECT unit, category, count(DISTINCT l_suppkey) node_count, count(DISTINCT file) source_file_count FROM mapped JOIN lineitem ON p_partkey = l_partkey WHERE unit <> 'SKIP' GROUP BY 1, 2")
def unit_rollup(spark, sf):
    rows = mapped_units(file_names(spark, sf)).join(table(spark, sf, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).where("unit <> 'SKIP'")
    return rows.groupBy("unit", "category").agg(F.countDistinct("l_suppkey").alias("node_count"), F.countDistinct("file").alias("source_file_count"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(url, '\\([^)]*\\)', '', 'g'), '[\\s_/.,:;-]+', '', 'g')) k, regexp_replace(url, '[^\\p{L}\\p{N}]', '', 'g') safe FROM pages")
def name_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.loose_key(F.col("url")).alias("k"), fn.identifier(F.col("url")).alias("safe"))


# ---------------------------------------------------------------- searches and texts


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') ORDER BY length(p_name), p_partkey LIMIT 5")
def keyword_search(spark, sf):
    return table(spark, sf, "part").where(F.contains("p_name", F.lit("ring"))).orderBy(F.length("p_name"), "p_partkey").limit(5).select("p_partkey", "p_name")


@query("SELECT p_name, min(p_partkey) p_partkey FROM (SELECT * FROM part WHERE contains(p_name, 'r') ORDER BY length(p_name), p_name, p_partkey LIMIT 15) GROUP BY 1")
def autocomplete(spark, sf):
    """15 hits by length, then one for each name, so there may be fewer."""
    hits = table(spark, sf, "part").where(F.contains("p_name", F.lit("r"))).orderBy(F.length("p_name"), "p_name", "p_partkey").limit(15)
    return hits.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.com/fr') OR contains(page_id::VARCHAR, '77') ORDER BY page_id LIMIT 10")
def ui_search(spark, sf):
    hit = F.contains(F.lower("url"), F.lit("example.com/fr")) | F.contains(F.col("page_id").cast("string"), F.lit("77"))
    return table(spark, sf, "pages").where(hit).orderBy("page_id").limit(10).select("page_id", "url")


TOKENS_SQL = "SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') t FROM documents"


@query(f"""WITH d AS ({TOKENS_SQL}), w AS (SELECT doc_id, t, unnest(range(0, len(t), 450)) s FROM d WHERE len(t) > 0)
    SELECT doc_id, (s // 450 + 1)::INT chunk, len(t[s + 1:s + 500])::INT n_tokens, md5(array_to_string(t[s + 1:s + 500], ' ')) digest FROM w""")
def chunk_windows(spark, sf):
    rows = sources.chunk_windows(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk", "n_tokens", F.md5("text").alias("digest"))


ENV_SQL = r"\b(OPENAI_API_KEY|GOOGLE_API_KEY|GEMINI_API_KEY|GROQ_API_KEY(?:_[0-9])?|NVIDIA_API_KEY_[0-9]|NEO4J_PASSWORD)\s*=\s*(.+)"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n FROM documents),
    v AS (SELECT *, regexp_extract(line, '{ENV_SQL}', 1) var, regexp_extract(line, '{ENV_SQL}', 2) given, trim(trim(regexp_extract(line, '{ENV_SQL}', 2)), chr(34) || chr(39)) bare FROM l)
    SELECT doc_id, n::INT line_no, 'NVIDIA_API_KEY' kind FROM l WHERE regexp_matches(line, 'nvapi-[A-Za-z0-9_-]{{20,}}')
    UNION ALL SELECT doc_id, n::INT, 'GROQ_API_KEY' FROM l WHERE regexp_matches(line, 'gsk_[A-Za-z0-9_-]{{20,}}')
    UNION ALL SELECT doc_id, n::INT, 'GOOGLE_API_KEY' FROM l WHERE regexp_matches(line, 'AIza[A-Za-z0-9_-]{{20,}}')
    UNION ALL SELECT doc_id, n::INT, 'OPENAI_API_KEY' FROM l WHERE regexp_matches(line, 'sk-(proj-|live-)?[A-Za-z0-9_-]{{20,}}')
    UNION ALL SELECT doc_id, n::INT, 'TOKEN' FROM l WHERE regexp_matches(line, 'token = "[0-9a-f]{{40}}"')
    UNION ALL SELECT doc_id, n::INT, 'PATH' FROM l WHERE regexp_matches(line, '\b[A-Za-z]:[\\/]')
    UNION ALL SELECT doc_id, n::INT, 'ENV ' || var FROM v WHERE var <> '' AND NOT contains(given, 'getenv(') AND NOT (starts_with(bare, '<') AND ends_with(bare, '>'))
      AND lower(bare) NOT IN ('', 'your_api_key_here', 'your-key-here', 'replace_me', 'changeme', 'placeholder', 'example', 'none', 'null')""")
def secret_scan(spark, sf):
    """A row per line and kind of leak: keys, assignments of secrets, tokens, local paths."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.explode(fn.secret_kinds(F.col("line"))).alias("kind"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::INT k FROM events""")
def json_lenient(spark, sf):
    """Properties with words around them, parsed."""
    noisy = table(spark, sf, "events").select("event_id", F.concat(F.lit("Sure! "), "props", F.lit(" Hope that helps.")).alias("answer"))
    found = fn.lenient_json(F.col("answer"))
    return noisy.select("event_id", F.try_variant_get(F.parse_json(found), "$.k", "int").alias("k"))


# ---------------------------------------------------------------- answers and slices

ANSWERS_SQL = """answers AS (SELECT user_id,
    array_to_string(list_sort(list(DISTINCT chr(65 + hash_k)) FILTER (hash_k < 4 AND d < 16)), '') gold, array_to_string(list_sort(list(DISTINCT chr(65 + hash_k)) FILTER (hash_k < 4 AND d >= 16)), '') got
    FROM (SELECT user_id, (json_extract_string(props, '$.k')::INT % 5) hash_k, day(ts) d FROM events) GROUP BY 1)"""
F1_SQL = "CASE WHEN gold = '' AND got = '' THEN 1.0 WHEN gold = '' OR got = '' THEN 0.0 ELSE 2.0 * len(list_intersect(string_split(gold, ''), string_split(got, ''))) / (length(gold) + length(got)) END"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """A set of letters per user for each half of the month, as gold and given answer."""
    k = F.get_json_object("props", "$.k").cast("int") % 5
    rows = table(spark, sf, "events").select("user_id", F.substring(F.lit("ABCDE"), k + 1, F.lit(1)).alias("letter"), F.dayofmonth("ts").alias("d"))
    text = lambda c: fn.answer_letters(F.concat_ws(",", F.collect_list(F.when(c, F.col("letter")))))
    return rows.groupBy("user_id").agg(text(F.col("d") < 16).alias("gold"), text(F.col("d") >= 16).alias("got"))


@query(f"WITH {ANSWERS_SQL} SELECT user_id, coalesce(gold, '') gold, coalesce(got, '') got, round({F1_SQL.replace('gold', 'g').replace('got', 'a')}, 6)::DOUBLE f1, CASE WHEN g = a AND a <> '' THEN 1 ELSE 0 END exact FROM (SELECT *, coalesce(gold, '') g, coalesce(got, '') a FROM answers)")
def answer_scores(spark, sf):
    f1 = F.round(fn.set_f1(F.col("gold"), F.col("got")), 6)
    return answers(spark, sf).select("user_id", "gold", "got", f1.alias("f1"), ((F.col("gold") == F.col("got")) & (F.col("got") != "")).cast("int").alias("exact"))


@query(f"""WITH {ANSWERS_SQL}, a AS (SELECT coalesce(gold, '') g, coalesce(got, '') a FROM answers), x AS (SELECT CASE WHEN length(g) = 1 THEN 'single' ELSE 'multi' END slice, * FROM a)
    SELECT coalesce(slice, 'all') slice, count(*) n, sum(CASE WHEN g = a AND a <> '' THEN 1 ELSE 0 END)::BIGINT correct,
      sum(CASE WHEN length(a) < length(g) THEN 1 ELSE 0 END)::BIGINT unders, sum(CASE WHEN length(a) > length(g) THEN 1 ELSE 0 END)::BIGINT overs, sum(CASE WHEN length(a) = length(g) AND g <> a THEN 1 ELSE 0 END)::BIGINT wrong
    FROM x GROUP BY GROUPING SETS ((slice), ())""")
def accuracy_slices(spark, sf):
    rows = answers(spark, sf).withColumn("slice", F.when(F.length("gold") == 1, "single").otherwise("multi"))
    some = lambda c: F.sum(c.cast("long"))
    g, a = F.col("gold"), F.col("got")
    sums = [F.count("*").alias("n"), some((g == a) & (a != "")).alias("correct"), some(F.length(a) < F.length(g)).alias("unders"), some(F.length(a) > F.length(g)).alias("overs"), some((F.length(a) == F.length(g)) & (g != a)).alias("wrong")]
    return rows.groupingSets([["slice"], []], "slice").agg(*sums).withColumn("slice", F.coalesce("slice", F.lit("all")))


# ---------------------------------------------------------------- community statistics


@query("SELECT bucket, count(*) n, sum(size)::BIGINT members FROM (SELECT o_custkey, count(*) size, CASE WHEN count(*) <= 2 THEN '1-2' WHEN count(*) <= 9 THEN '3-9' WHEN count(*) <= 49 THEN '10-49' WHEN count(*) <= 99 THEN '50-99' ELSE '>=100' END bucket FROM orders GROUP BY 1) GROUP BY 1")
def size_buckets(spark, sf):
    sizes = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    return sizes.groupBy(fn.size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("size").alias("members"))


@query("""WITH s AS (SELECT o_custkey, count(*) size FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, o_custkey) n FROM s)
    SELECT round(sum(size) FILTER (n <= 50) / sum(size), 6) top50, round(max(size) / sum(size), 6) largest, round(avg(size), 6) mean, median(size) middle FROM r""")
def top50_coverage(spark, sf):
    sizes = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    top = sizes.orderBy(F.desc("size"), "o_custkey").limit(50).agg(F.sum("size").alias("t"))
    every = sizes.agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.avg("size").alias("a"), F.median("size").alias("middle"))
    return every.join(top, how="cross").select(F.round(F.col("t") / F.col("s"), 6).alias("top50"), F.round(F.col("m") / F.col("s"), 6).alias("largest"), F.round("a", 6).alias("mean"), "middle")


@query("""WITH n AS (SELECT p_brand, p_name, count(*) c FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_name) i FROM n)
    SELECT p_brand, sum(c)::BIGINT size, string_agg(p_name, ', ' ORDER BY i) FILTER (i <= 3) top3, string_agg(p_name, ', ' ORDER BY i) FILTER (i <= 10) top10 FROM r GROUP BY 1""")
def composition(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("c"))
    placed = counts.withColumn("i", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("c"), "p_name")))
    top = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= n, F.struct("i", "p_name")))), lambda x: x["p_name"]), ", ")
    return placed.groupBy("p_brand").agg(F.sum("c").alias("size"), top(3).alias("top3"), top(10).alias("top10"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) n FROM customer WHERE c_acctbal >= 0 GROUP BY 1, 2), s AS (SELECT c_nationkey, count(*) size FROM customer GROUP BY 1),
    m AS (SELECT c_nationkey, max({'n': n, 's': c_mktsegment}) b FROM c GROUP BY 1) SELECT c_nationkey, size, b.s dominant, round(coalesce(b.n, 0) / size, 6) ratio FROM s LEFT JOIN m USING (c_nationkey)""")
def dominant_unit(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("unit"))
    return stats.dominant(rows, "c_nationkey", "unit")


@query("""WITH o AS (SELECT c_nationkey cid, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) place FROM customer GROUP BY 1), c AS (SELECT c_mktsegment u, c_nationkey cid, count(*) n FROM customer GROUP BY 1, 2),
    t AS (SELECT u, sum(n) total FROM c GROUP BY 1), g AS (SELECT unnest(range(1, 11)) n_top), v AS (SELECT u, n_top, sum(n) covered FROM c JOIN o USING (cid) JOIN g ON place <= n_top GROUP BY 1, 2)
    SELECT n_top, round(avg(coalesce(covered, 0) / total), 6) coverage FROM t CROSS JOIN g LEFT JOIN v USING (u, n_top) GROUP BY 1""")
def topn_coverage(spark, sf):
    rows = table(spark, sf, "customer")
    sizes = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    order = sizes.select("c_nationkey", F.row_number().over(Window.orderBy(F.desc("n"), "c_nationkey")).alias("place"))
    return stats.coverage(rows, "c_mktsegment", "c_nationkey", order)


@query("SELECT c_nationkey, sum(n)::BIGINT n, round(-sum(n / t * log2(n / t)), 6) entropy FROM (SELECT c_nationkey, count(*) n, sum(count(*)) OVER (PARTITION BY c_nationkey) t FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY 1")
def type_entropy(spark, sf):
    return stats.entropy(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("""WITH g AS (SELECT c_nationkey, count(*) ng FROM customer GROUP BY 1), k AS (SELECT c_mktsegment, count(*) nk FROM customer GROUP BY 1), c AS (SELECT c_nationkey, c_mktsegment, count(*) x FROM customer GROUP BY 1, 2),
    t AS (SELECT *, coalesce(x, 0) k, (SELECT count(*) FROM customer) m FROM g CROSS JOIN k LEFT JOIN c USING (c_nationkey, c_mktsegment)),
    p AS (SELECT *, CASE WHEN k <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(k, least(ng, nk) + 1), lambda i: exp(lgamma(nk + 1) - lgamma(i + 1) - lgamma(nk - i + 1) + lgamma(m - nk + 1) - lgamma(ng - i + 1) - lgamma(m - nk - ng + i + 1) - lgamma(m + 1) + lgamma(ng + 1) + lgamma(m - ng + 1))))) END p FROM t),
    r AS (SELECT *, row_number() OVER (ORDER BY round(p, 9), c_nationkey, c_mktsegment) rank, count(*) OVER () n FROM p)
    SELECT c_nationkey, c_mktsegment, k, round(ng * nk / m, 6) expected, round(p, 6) p, round(least(1.0, min(p * n / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)), 5) q FROM r""")
def enrichment(spark, sf):
    rows = table(spark, sf, "customer")
    found = stats.enrichment(rows, "c_nationkey", "c_mktsegment", rows.count())
    return found.select("c_nationkey", "c_mktsegment", "k", F.round("expected", 6).alias("expected"), F.round("p", 6).alias("p"), F.round("q", 5).alias("q"))


@query("""WITH x AS (SELECT o_totalprice v, o_orderstatus = 'F' a FROM orders), r AS (SELECT a, v, avg(i) OVER (PARTITION BY v) r FROM (SELECT *, row_number() OVER (ORDER BY v) i FROM x)),
    s AS (SELECT count(*) FILTER (a) an, count(*) FILTER (NOT a) bn, avg(v) FILTER (a) am, avg(v) FILTER (NOT a) bm, var_samp(v) FILTER (a) av, var_samp(v) FILTER (NOT a) bv, median(v) FILTER (a) amed, median(v) FILTER (NOT a) bmed, sum(r) FILTER (a) rs FROM r),
    k AS (SELECT sum(n ** 3 - n) ties FROM (SELECT count(*)::DOUBLE n FROM x GROUP BY v)),
    q AS (SELECT *, (am - bm) / sqrt(av / an + bv / bn) t, (av / an + bv / bn) ** 2 / ((av / an) ** 2 / (an - 1) + (bv / bn) ** 2 / (bn - 1)) df, rs - an * (an + 1) / 2 u FROM s, k),
    y AS (SELECT *, greatest(abs(u - an * bn / 2) - 0.5, 0) / sqrt(an * bn / 12 * (an + bn + 1 - ties / ((an + bn) * (an + bn - 1)))) z FROM q)
    SELECT an a_n, bn b_n, round(am, 4) a_mean, round(bm, 4) b_mean, round(amed, 4) a_median, round(bmed, 4) b_median, round(t, 5) t, round(df, 3) df, round(u, 1) u, round(z, 5) u_z, round((am - bm) / sqrt((av + bv) / 2), 6) d,
      round(1 - 2 * abs(t) / 50000 * list_sum(list_transform(range(50000), lambda i: exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * ln(1 + (abs(t) * (i + 0.5) / 50000) ** 2 / df)))) / sqrt(df * pi()), 5) t_p,
      round(1 - 2 * z / 50000 * list_sum(list_transform(range(50000), lambda i: exp(-0.5 * (z * (i + 0.5) / 50000) ** 2))) / sqrt(2 * pi()), 5) u_p FROM y""")
def two_sample(spark, sf):
    r = stats.two_sample(table(spark, sf, "orders"), "o_totalprice", F.col("o_orderstatus") == "F")
    digits = {"a_mean": 4, "b_mean": 4, "a_median": 4, "b_median": 4, "t": 5, "df": 3, "u": 1, "u_z": 5, "d": 6, "t_p": 5, "u_p": 5}
    return r.select("a_n", "b_n", *(F.round(c, n).alias(c) for c, n in digits.items()))


# ---------------------------------------------------------------- matching


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("block"), F.col("embedding").alias("v"))


@query("SELECT a.vec_id id_a, b.vec_id id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def sim_pairs(spark, sf):
    return matching.similar_pairs(vectors(spark, sf), 0.35).select("id_a", "id_b", F.round("similarity", 5).alias("similarity"))


@query("""SELECT qid, id, place::INT place FROM (SELECT a.vec_id qid, b.vec_id id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) s,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) DESC, b.vec_id) place
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) > 0.3) WHERE place <= 10""")
def nearest_k(spark, sf):
    rows = vectors(spark, sf)
    return matching.nearest(rows.where("id % 50 = 0"), rows, 10, 0.3).select("qid", "id", "place")


@query()
def greedy_pairs(spark, sf):
    return matching.capped_pairs(matching.similar_pairs(vectors(spark, sf), 0.3))


@query()
def sequential_merge(spark, sf):
    pairs = matching.capped_pairs(matching.similar_pairs(vectors(spark, sf), 0.3))
    order = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("similarity"), "id_a", "id_b"))
    merged = matching.sequential_merge(pairs.withColumn("ord", order).select("block", "ord", "id_a", "id_b"))
    return merged.groupBy("block", "outcome").agg(F.count("*").alias("n"))


@query()
def fuzzy_names(spark, sf):
    return matching.fuzzy_pairs(table(spark, sf, "part").select(F.col("p_type").alias("block"), F.col("p_name").alias("name")))


@query("SELECT t threshold, count(*) total, sum(CASE WHEN o_orderstatus = 'F' AND (o_orderkey % 100) / 100 >= t THEN 1 ELSE 0 END)::BIGINT same FROM orders CROSS JOIN (VALUES (0.5::DOUBLE), (0.7), (0.9)) x(t) GROUP BY 1")
def threshold_counts(spark, sf):
    decisions = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "same").otherwise("different").alias("decision"), ((F.col("o_orderkey") % 100) / 100).alias("confidence"))
    return matching.by_threshold(decisions, [0.5, 0.7, 0.9])


# ---------------------------------------------------------------- stages, state, resumption


@query("""WITH s AS (SELECT l_returnflag stage, count(*)::BIGINT lines, count(DISTINCT l_partkey) parts, count(DISTINCT l_suppkey) supps FROM lineitem GROUP BY 1), u AS (UNPIVOT s ON lines, parts, supps INTO NAME metric VALUE v)
    SELECT b.metric, b.v AS before, a.v AS after, a.v - b.v diff, printf('%+.2f%%', 100.0 * (a.v - b.v) / b.v) percent FROM u b JOIN u a USING (metric) WHERE b.stage = 'A' AND a.stage = 'R'""")
def stage_compare(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps"))
    long = counts.unpivot("l_returnflag", ["lines", "parts", "supps"], "metric", "v")
    side = lambda flag, name: long.where(F.col("l_returnflag") == flag).select("metric", F.col("v").alias(name))
    rows = side("A", "before").join(side("R", "after"), "metric")
    return rows.withColumns({"diff": F.col("after") - F.col("before"), "percent": stats.percent_change(F.col("before"), F.col("after"))})


@query("""WITH s AS (SELECT l_linenumber t, count(*) n, count(DISTINCT l_partkey) parts FROM lineitem GROUP BY 1)
    SELECT t, n, parts, lag(n) OVER (ORDER BY t) - n step, parts = (SELECT max(parts) FROM s) best FROM s""")
def threshold_steps(spark, sf):
    """Differences to the threshold before, earlier less later, and whether a row has the most parts."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("t")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))
    return rows.withColumns({"step": F.lag("n").over(Window.orderBy("t")) - F.col("n"), "best": F.col("parts") == F.max("parts").over(Window.partitionBy())})


@query("""WITH s AS (SELECT l_linenumber t, count(*) n, count(DISTINCT l_partkey) parts FROM lineitem GROUP BY 1)
    SELECT a.t t_from, b.t t_to, b.n - a.n n_diff, b.parts - a.parts parts_diff FROM s a JOIN s b ON a.t < b.t""")
def threshold_pairs(spark, sf):
    """Differences of all pairs of thresholds, later less earlier. A row per threshold, of which there are a handful."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("t")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.col("a.t") < F.col("b.t")).select(
        F.col("a.t").alias("t_from"), F.col("b.t").alias("t_to"), (F.col("b.n") - F.col("a.n")).alias("n_diff"), (F.col("b.parts") - F.col("a.parts")).alias("parts_diff")
    )


@query("""SELECT user_id, count(*) FILTER (value >= 50) correct, count(*) FILTER (value < 50) missed, greatest(0, 3 - count(*) FILTER (value < 50)) lives FROM events GROUP BY 1""")
def quiz_score(spark, sf):
    """Right and wrong answers of a user, and the lives that are left of three."""
    right = F.col("value") >= 50
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(right).alias("correct"), F.count_if(F.col("value") < 50).alias("missed"))
    return rows.withColumn("lives", F.greatest(F.lit(0).cast("long"), 3 - F.col("missed")))


@query("""WITH ids AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END id FROM part)
    SELECT id, row_number() OVER (ORDER BY try_cast(id AS DOUBLE) IS NULL, try_cast(id AS DOUBLE), id) place FROM ids""")
def id_order(spark, sf):
    """Ids in order: numbers first, by value, then texts. The ids are those of a report, sizes and brands."""
    ids = table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("id")).distinct()
    number = F.col("id").try_cast("double")
    return ids.withColumn("place", F.row_number().over(Window.orderBy(number.isNull(), number, "id")).cast("long"))


@query("""SELECT count(*) "before", count(DISTINCT lower(trim(p_name))) "after", round((count(*) - count(DISTINCT lower(trim(p_name)))) / count(*), 4) reduction FROM part""")
def node_reduction(spark, sf):
    """The share of names that fall away when equal ones are merged."""
    rows = table(spark, sf, "part").agg(F.count("*").alias("before"), F.countDistinct(fn.name_key(F.col("p_name"))).alias("after"))
    return rows.withColumn("reduction", F.round((F.col("before") - F.col("after")) / F.col("before"), 4))


@query("""SELECT file, count(DISTINCT node) nodes FROM (SELECT l_returnflag || '/' || l_linenumber file, unnest(['s' || l_suppkey, 'p' || l_partkey]) node FROM lineitem) GROUP BY 1""")
def nodes_per_source(spark, sf):
    """Distinct nodes at either end of the edges that a source file gives."""
    ends = F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    rows = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_returnflag", F.col("l_linenumber").cast("string")).alias("file"), F.explode(ends).alias("node"))
    return rows.groupBy("file").agg(F.countDistinct("node").alias("nodes"))


@query("SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def toggle_state(spark, sf):
    return evidence.toggled(table(spark, sf, "events"), ["user_id", "event_type"], F.col("event_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf):
    return funnel.resume(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, 'labelled' AS origin FROM labels UNION ALL SELECT doc_id, 'all' FROM documents")
def union_originals(spark, sf):
    labelled = table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("origin"))
    return labelled.unionByName(table(spark, sf, "documents").select("doc_id", F.lit("all").alias("origin")))


@query("""SELECT count(*) records, sum(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END)::BIGINT with_original, sum(CASE WHEN l_linenumber > 1 AND l_returnflag IS DISTINCT FROM nullif(l_linestatus, 'O') THEN 1 ELSE 0 END)::BIGINT changed_flag,
    sum(CASE WHEN l_linenumber > 1 AND l_quantity IS DISTINCT FROM l_tax * 100 THEN 1 ELSE 0 END)::BIGINT changed_quantity FROM lineitem""")
def change_audit(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") > 1).alias("has_original"), F.col("l_returnflag").alias("flag"), F.nullif("l_linestatus", F.lit("O")).alias("original_flag"), F.col("l_quantity").alias("quantity"), (F.col("l_tax") * 100).alias("original_quantity")
    )
    return funnel.changes(rows, ["flag", "quantity"])


@query(G0 + " SELECT (SELECT count(*) FROM nodes) node_count, (SELECT count(*) FROM edges) rel_count, (SELECT count(*) FROM nodes) nodes, 0::BIGINT unnamed, (SELECT count(*) FROM edges) edges")
def graph_backup(spark, sf):
    """A backup of the graph, verified from its files."""
    import uuid

    from strandline.sources.staging import shared_dir

    path = f"{shared_dir(spark)}/strandline/backup-{uuid.uuid4().hex}"
    sources.backup(nodes(spark, sf), edges(spark, sf), path)
    return sources.verify(spark, path)


@query("""WITH p AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) f FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(o_orderpriority, ' > ' ORDER BY f) path, count(*) steps FROM p GROUP BY 1""")
def path_groups(spark, sf):
    """Groups in the order in which each first appears."""
    firsts = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("f"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("f", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return firsts.groupBy("o_custkey").agg(F.array_join(listed, " > ").alias("path"), F.count("*").alias("steps"))
