"""Overview, quality, employer, composition and structure sections.

Each function takes enriched connections and gives a DataFrame; ties that the
order of the file decides are settled by ``row_idx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions import estimators as E
from affinity.functions.text import LADDER, LEADERSHIP

HAS_COMPANY = "company <> ''"
KNOWN_LEVEL, KNOWN_FUNCTION = "seniority <> 'unknown'", "function <> 'unclassified'"


def overview(df: DataFrame) -> DataFrame:
    first, last = F.min("connected_on"), F.max("connected_on")
    return df.agg(
        F.count("*").alias("connections"),
        F.count_distinct(F.expr(f"CASE WHEN {HAS_COMPANY} THEN company END")).alias("distinct_companies"),
        F.count_if(F.expr(HAS_COMPANY)).alias("with_company"),
        F.count_if(F.col("position") != "").alias("with_position"),
        F.count("connected_on").alias("with_date"),
        first.alias("first_connection"),
        last.alias("last_connection"),
        F.when(F.count("connected_on") > 1, F.datediff(last, first)).otherwise(0).cast("long").alias("span_days"),
    )


def entity_resolution(df: DataFrame) -> DataFrame:
    """Distinct employer strings before and after, and what that merged."""
    raw = F.regexp_replace("company_raw", r"(?U)^\s+|\s+$", "")
    counts = df.agg(F.count_distinct(F.when(raw != "", raw)).alias("raw_distinct"), F.count_distinct(F.when(F.col("company") != "", F.col("company"))).alias("canonical_distinct"))
    merged = F.greatest(F.col("raw_distinct") - F.col("canonical_distinct"), F.lit(0))
    return counts.select("*", merged.alias("merged"), E.share(merged, F.greatest("raw_distinct", F.lit(1))).alias("merge_rate"))


def completeness(df: DataFrame) -> DataFrame:
    """What is missing, as counts and as rates of what is there."""
    empty = lambda c: F.count_if(F.btrim(F.coalesce(F.col(c), F.lit(""))) == "")
    counts = df.agg(F.count("*").alias("rows"), empty("company_raw").alias("missing_company"), empty("position_raw").alias("missing_position"), F.count_if(F.col("connected_on").isNull()).alias("unparsed_dates"))
    rate = lambda c: E.rounded(1 - F.col(c) / F.greatest("rows", F.lit(1)), 4)
    return counts.select("*", rate("missing_company").alias("company"), rate("missing_position").alias("position"), rate("unparsed_dates").alias("connected_on"))


def company_counts(df: DataFrame) -> DataFrame:
    """Employer, people, and where the employer first appears."""
    return df.filter(HAS_COMPANY).groupBy("company").agg(F.count("*").alias("count"), F.min("row_idx").alias("first_idx"))


def top_companies(counts: DataFrame, n: int = 25) -> DataFrame:
    return counts.orderBy(F.desc("count"), "first_idx").limit(n).select("company", "count")


def size_distribution(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.col("count").alias("size")).agg(F.count("*").alias("companies"))


def concentration(counts: DataFrame) -> DataFrame:
    """One row of estimators over the employers' sizes; no row without employers."""
    hist = counts.groupBy(F.col("count").cast("double").alias("v")).agg(F.count("*").alias("n"))
    single = hist.agg(F.coalesce(F.sum(F.when(F.col("v") == 1, F.col("n"))), F.lit(0)).alias("singletons"))
    one = E.concentration(hist).crossJoin(F.broadcast(single))  # one row each
    return one.filter("n > 0").select(
        F.col("n").alias("distinct"),
        "gini",
        F.col("hhi").alias("hhi_normalized"),
        F.col("entropy").alias("shannon_entropy"),
        F.col("evenness").alias("pielou_evenness"),
        F.col("effective").alias("effective_companies"),
        F.col("top_k_share").alias("top_10_share"),
        E.share(F.col("singletons"), F.col("n")).alias("singleton_rate"),
        F.col("alpha").alias("powerlaw_alpha"),
        E.tail_regime(F.col("alpha")).alias("tail_regime"),
        F.col("median").alias("median_cluster_size"),
        F.col("p95").alias("p95_cluster_size"),
    )


def seniority_distribution(df: DataFrame) -> DataFrame:
    """All nine tiers, also those that nobody has."""
    ladder = df.sparkSession.createDataFrame([(x, k) for k, x in enumerate(LADDER)], "tier string, rank int")
    counts = df.groupBy(F.col("seniority").alias("tier")).agg(F.count("*").alias("count"))
    return F.broadcast(ladder).join(counts, "tier", "left").select("tier", F.coalesce("count", F.lit(0)).alias("count"), "rank")


def seniority_summary(df: DataFrame) -> DataFrame:
    known = F.expr(KNOWN_LEVEL)
    a = df.agg(F.count("*").alias("n"), F.count_if(known).alias("classified"), F.count_if(F.col("seniority").isin(LEADERSHIP)).alias("leaders"), F.avg(F.when(known, F.col("seniority_rank"))).alias("mean"))
    return a.select(E.share(F.col("classified"), F.col("n")).alias("classified_rate"), F.coalesce(E.rounded("mean", 3), F.lit(0.0)).alias("mean_rank"), E.share(F.col("leaders"), F.greatest("classified", F.lit(1))).alias("leadership_share"))


def function_counts(df: DataFrame) -> DataFrame:
    return df.filter(KNOWN_FUNCTION).groupBy("function").agg(F.count("*").alias("count"), F.min("row_idx").alias("first_idx"))


def function_summary(counts: DataFrame) -> DataFrame:
    """entropy, evenness, effective_functions, modal and homophily_index."""
    one = E.concentration(counts.select(F.col("count").cast("double").alias("v")).groupBy("v").agg(F.count("*").alias("n")))
    modal = counts.orderBy(F.desc("count"), "first_idx").limit(1).select(F.col("function").alias("modal"), F.col("count").alias("most"))
    both = one.join(F.broadcast(modal), how="left")  # one row each
    return both.select("entropy", "evenness", F.col("effective").alias("effective_functions"), "modal", F.when(F.col("modal").isNotNull(), E.share(F.col("most"), F.col("total"))).alias("homophily_index"))


def seniority_by_year(df: DataFrame, least: int = 3) -> DataFrame:
    by = df.filter(f"connected_on IS NOT NULL AND {KNOWN_LEVEL}").groupBy(F.year("connected_on").cast("long").alias("year"))
    return by.agg(E.rounded(F.avg("seniority_rank"), 3).alias("mean_rank"), F.count("*").alias("n")).filter(F.col("n") >= least)


def seniority_drift(by_year: DataFrame) -> DataFrame:
    """The line through the years' rounded means; available with three years or more."""
    line = E.ols(by_year, "year", "mean_rank")
    steep = (F.abs("slope") > 0.02) & (F.col("r_squared") > 0.3)
    on = F.col("n") >= 3
    word = F.when(steep & (F.col("slope") > 0), "rising").when(steep, "falling").otherwise("flat")
    return line.select(on.alias("available"), F.col("n").alias("years"), *[F.when(on, F.col(c)).alias(a) for c, a in (("slope", "slope_rank_per_year"), ("intercept", "intercept"), ("r_squared", "r_squared"))], F.when(on, word).alias("interpretation"))


def structure(counts: DataFrame, people: DataFrame) -> DataFrame:
    """The bipartite network and, in closed form, its projection onto people."""
    k = F.col("count").cast("double")
    of_companies = counts.agg(F.count("*").alias("companies"), F.coalesce(F.sum("count"), F.lit(0)).alias("edges"), F.coalesce(F.sum(k * (k - 1) / 2), F.lit(0.0)).alias("projected"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"), F.count_if(F.col("count") == 1).alias("singletons"))
    one = of_companies.crossJoin(F.broadcast(people.agg(F.count("*").alias("people"))))  # one row each
    n, alone = F.col("people"), F.col("people") - F.col("edges")
    safe = lambda a, b, d: F.coalesce(E.rounded(F.try_divide(a.cast("double"), b.cast("double")), d), F.lit(0.0))
    return one.select(
        "people",
        "companies",
        "edges",
        safe(F.col("edges"), n * F.col("companies"), 6).alias("density"),
        alone.alias("unaffiliated_people"),
        F.col("projected").cast("long").alias("projection_edges"),
        safe(2 * F.col("projected"), n, 3).alias("mean_degree"),
        F.greatest(F.col("largest") - 1, F.lit(0)).alias("max_degree"),
        safe(2 * F.col("projected"), n * (n - 1), 6).alias("projection_density"),
        (F.col("companies") + alone).alias("components"),
        safe(F.col("largest"), n, 4).alias("largest_component_share"),
        safe(alone + F.col("singletons"), n, 4).alias("isolate_share"),
    )
