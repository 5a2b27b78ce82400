"""Statistics that judge a graph: entropy, enrichment, coverage, two-sample tests, slices, stage comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ranges import least_from, running
from strandline.sources.staging import Steps


def entropy(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """Shannon entropy in bits of ``kind`` in each group."""
    counts = rows.groupBy(group, kind).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("p", p).groupBy(group).agg(F.sum("n").alias("n"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def entropy_summary(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """One row: the entropy of all rows, mean and median of the groups' entropies, the number of groups and of those below the entropy of all."""
    each = entropy(rows, group, kind)
    whole = entropy(rows.withColumn("_all", F.lit(0)), "_all", kind).select(F.col("entropy").alias("global_entropy"))  # one row
    both = each.join(F.broadcast(whole), how="cross")
    below = F.count_if(F.col("entropy") < F.col("global_entropy"))
    return both.agg(F.first("global_entropy").alias("global_entropy"), F.avg("entropy").alias("mean_entropy"), F.median("entropy").alias("median_entropy"), F.count("*").alias("groups"), below.alias("below_global"))


def matrix(rows: DataFrame, unit: str, group: str) -> DataFrame:
    """unit, group, n, and the totals of the unit and of the group."""
    counts = rows.groupBy(unit, group).agg(F.count("*").alias("n"))
    units, groups = counts.groupBy(unit).agg(F.sum("n").alias("unit_total")), counts.groupBy(group).agg(F.sum("n").alias("group_total"))
    return counts.join(units, unit).join(groups, group).select(unit, group, "n", "unit_total", "group_total")


SMALL = 16  # factorials below are exact


def log_factorial(x: Column) -> Column:
    """ln(x!) of a whole number: exact below SMALL, by Stirling's series (error below 1e-11) from there on."""
    x = x.cast("double")
    table = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(SMALL)))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(x < 0, F.lit(None)).when(x < SMALL, F.get(table, x.cast("int"))).otherwise(series)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive number: Stirling's series at x + SMALL, less the factors between."""
    x = x.cast("double")
    y = x + SMALL
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(SMALL - 1)), F.lit(0.0), lambda acc, i: acc + F.log(x + i))


def normal_tails(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z: a series for small z, a continued fraction beyond, which keeps small tails exact."""
    x = F.abs(z) / math.sqrt(2)

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * x * x / (2 * n + 3)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(80)), F.struct(x.alias("term"), x.alias("sum")), step)["sum"]
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / 2 / acc)
    density = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 3, 1 - 2 * density * series).otherwise(density / fraction)


NORMAL_FROM = 10_000  # degrees of freedom from which t is taken for normal after a correction of its first order


def student_tails(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t: the incomplete beta function as a continued fraction."""
    t, df = F.abs(t).cast("double"), df.cast("double")

    def beta(x: Column, a: Column, b: Column) -> Column:
        def part(acc: Column, n: Column) -> Column:
            m = F.floor(n / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(n % 2 == 0, even).otherwise(odd) / acc

        fraction = F.aggregate(F.sequence(F.lit(600), F.lit(1), F.lit(-1)), F.lit(1.0), part)
        front = F.exp(a * F.log(x) + b * F.log(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        return front / fraction

    x, a, b = df / (df + t * t), df / 2, F.lit(0.5)
    exact = F.when(x < (a + 1) / (a + b + 2), beta(x, a, b)).otherwise(1 - beta(1 - x, b, a))
    near = normal_tails(t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df)))
    return F.when(t == 0, 1.0).when(df >= NORMAL_FROM, near).otherwise(exact)


def hypergeometric_tail(k: Column, draws: Column, good: Column, total: Column) -> Column:
    """P(X >= k) of ``draws`` from ``total`` with ``good`` hits."""
    choose = lambda n, r: log_factorial(n) - log_factorial(r) - log_factorial(n - r)
    most = F.least(draws, good)
    first = F.greatest(k, draws + good - total, F.lit(0))
    term = lambda x: F.exp(choose(good, x) + choose(total - good, draws - x) - choose(total, draws))
    tail = F.aggregate(F.sequence(first, most), F.lit(0.0), lambda acc, x: acc + term(x))
    return F.when(k <= 0, 1.0).when(first > most, 0.0).otherwise(F.least(tail, F.lit(1.0)))


def enrichment(rows: DataFrame, group: str, kind: str, total: int) -> DataFrame:
    """For every group and kind, absent ones included: count, expected count, p of at least as many, and q by Benjamini-Hochberg."""
    groups = rows.groupBy(group).agg(F.count("*").alias("n_group"))
    kinds = rows.groupBy(kind).agg(F.count("*").alias("n_kind"))
    grid = groups.join(kinds, how="cross")  # the result itself: a row per group and kind
    counts = rows.groupBy(group, kind).agg(F.count("*").alias("k"))
    table = grid.join(counts, [group, kind], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    p = hypergeometric_tail(F.col("k"), F.col("n_group"), F.col("n_kind"), F.lit(total).cast("long"))
    table = table.withColumn("p", p)
    return bh(table, [group, kind]).withColumn("expected", F.col("n_group") * F.col("n_kind") / F.lit(total))


def bh(table: DataFrame, order: list[str]) -> DataFrame:
    """table (p) with q: p * n / rank, and from the largest p on the running minimum, at most 1. Ranks and minima are worked out over ranges of p; a null p has no q."""
    steps = Steps(table.sparkSession, "bh")
    by = [F.col("p").asc_nulls_last(), *map(F.col, order)]
    ranked = steps(running(table, by, [], steps, "ranks"), "ranked")
    n = ranked.agg(F.count("p").alias("_all"))  # one row
    found = least_from(ranked.join(n, how="cross"), by, F.col("p") * F.col("_all") / F.col("_rank"), steps, "least")
    return found.withColumn("q", F.when(F.col("p").isNotNull(), F.least("_least", F.lit(1.0)))).drop("_rank", "_all", "_least")


def two_sample(rows: DataFrame, value: str, is_a: Column) -> DataFrame:
    """Sizes, means, deviations, medians, Welch's t and Mann-Whitney's U (average ranks of ties) with their p of both sides, and Cohen's d of two samples.

    U's z is corrected for ties and continuity.
    """
    counts = rows.select(F.col(value).alias("v"), is_a.alias("a")).groupBy("v").agg(F.sum(F.col("a").cast("long")).alias("na"), F.count("*").alias("n"))
    # Ranks over distinct values; a value's rank is the mean of the places that its rows take.
    ranks = running(counts, [F.col("v")], ["n"], Steps(rows.sparkSession, "ranks"), "values")
    ranks = ranks.withColumn("r", F.col("_before_n") + (F.col("n") + 1) / 2).agg(F.sum(F.col("na") * F.col("r")).alias("rank_sum"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    side = lambda c: [f(F.when(c, F.col(value))) for f in (F.count, F.avg, F.stddev_samp, F.median)]
    names = [f"{s}_{x}" for x in ("n", "mean", "sd", "median") for s in ("a", "b")]
    columns = [c for pair in zip(side(is_a), side(~is_a)) for c in pair]
    base = rows.agg(*(c.alias(n) for c, n in zip(columns, names))).join(ranks, how="cross")  # one row each
    va, vb = F.col("a_sd") ** 2, F.col("b_sd") ** 2
    t = (F.col("a_mean") - F.col("b_mean")) / F.sqrt(va / F.col("a_n") + vb / F.col("b_n"))
    u = F.col("rank_sum") - F.col("a_n") * (F.col("a_n") + 1) / 2
    d = (F.col("a_mean") - F.col("b_mean")) / F.sqrt((va + vb) / 2)
    n = F.col("a_n") + F.col("b_n")
    sigma = F.sqrt(F.col("a_n") * F.col("b_n") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - F.col("a_n") * F.col("b_n") / 2) - 0.5, F.lit(0.0)) / sigma
    df = (va / F.col("a_n") + vb / F.col("b_n")) ** 2 / ((va / F.col("a_n")) ** 2 / (F.col("a_n") - 1) + (vb / F.col("b_n")) ** 2 / (F.col("b_n") - 1))
    found = base.select(*names, t.alias("t"), df.alias("df"), u.alias("u"), z.alias("u_z"), d.alias("d"))
    return found.withColumns({"t_p": student_tails(F.col("t"), F.col("df")), "u_p": normal_tails(F.col("u_z"))})


def dominant(rows: DataFrame, group: str, unit: str) -> DataFrame:
    """Each group's most frequent unit (ties: the larger name) and its share of all rows of the group, those without unit included."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    best = rows.where(F.col(unit).isNotNull()).groupBy(group, unit).agg(F.count("*").alias("n")).groupBy(group).agg(F.max(F.struct("n", unit)).alias("best"))
    return sizes.join(best, group, "left").select(group, "size", F.col(f"best.{unit}").alias("dominant"), F.round(F.coalesce(F.col("best.n"), F.lit(0)) / F.col("size"), 6).alias("ratio"))


def coverage(rows: DataFrame, unit: str, group: str, order: DataFrame, top: int = 10) -> DataFrame:
    """The share of a unit's rows that lie in the first n groups of an order (group, place from 1), averaged over units, n up to top."""
    counts = rows.groupBy(unit, group).agg(F.count("*").alias("n"))
    totals = counts.groupBy(unit).agg(F.sum("n").alias("total"))
    placed = counts.join(order, group).where(F.col("place") <= top)
    steps = F.broadcast(rows.sparkSession.range(1, top + 1).select(F.col("id").alias("n_top")))
    shares = placed.join(steps, F.col("place") <= F.col("n_top")).groupBy(unit, "n_top").agg(F.sum("n").alias("covered"))
    grid = totals.join(steps, how="cross").join(shares, [unit, "n_top"], "left")
    return grid.groupBy("n_top").agg(F.round(F.avg(F.coalesce("covered", F.lit(0)) / F.col("total")), 6).alias("coverage"))


def percent_change(before: Column, after: Column) -> Column:
    """Signed, two digits; NA from 0 to something, 0 from 0 to 0."""
    return F.when((before == 0) & (after == 0), "0.00%").when(before == 0, "NA").otherwise(F.format_string("%+.2f%%", 100.0 * (after - before) / before))


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Of undirected edges (src, dst), parallel ones counted: sum over communities (id, cid) of inside / m - gamma * (degree / 2m) ** 2."""
    a, b = communities.select(F.col("id").alias("src"), F.col("cid").alias("a"), F.lit(True).alias("in_a")), communities.select(F.col("id").alias("dst"), F.col("cid").alias("b"), F.lit(True).alias("in_b"))
    return modularity_of(edges.join(a, "src", "left").join(b, "dst", "left"), gamma)


def modularity_of(ends: DataFrame, gamma: float = 1.0) -> DataFrame:
    """modularity() of edges with their communities a and b; in_a and in_b are true if an end has one. Edges are counted by both, once, and all else comes from the counts."""
    pairs = ends.groupBy("a", "b", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b")).agg(F.count("*").alias("n"))
    side = lambda c, inside: F.struct(F.col(c).alias("cid"), F.col(f"in_{c}").alias("known"), inside.alias("inside"))
    same = F.coalesce(F.when(F.col("a") == F.col("b"), F.col("n")), F.lit(0))
    each = pairs.select("n", F.inline(F.array(side("a", same), side("b", F.lit(0).cast("long")))))
    sums = each.groupBy("cid", "known").agg(F.sum("n").alias("degree"), F.sum("inside").alias("inside"))
    m = F.sum("degree").over(Window.partitionBy()) / 2  # a row per community
    part = F.col("inside") / F.col("m") - gamma * (F.col("degree") / (2 * F.col("m"))) ** 2
    return sums.withColumn("m", m).where("known").agg(F.sum(part).alias("modularity"))
