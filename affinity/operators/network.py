"""The inferred employer network and the payload of people and hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.functions.dates import month_key
from affinity.functions.estimators import rounded
from affinity.functions.text import initials
from affinity.operators.components import connected_components

MIN_WEIGHT, MIN_SIZE = 2, 2
CLUSTER_MODES = ("company", "year", "function", "seniority", "none")
MAX_NODES, MAX_SAMPLE = 6000, 60
#: Employers of a month that one task pairs with as many others.
MONTH_PART = 2_000


def cooccurrence_edges(df: DataFrame, counts: DataFrame, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """Employer pairs (source < target) that gained people in the same months.

    weight: months they share.  first_idx, first_source, first_target give the
    order in which pairs come up reading the file.  Employers of one person, and
    those of fewer months than a pair needs, are left out before pairs are made;
    months never pair rows, only employers, and one with many of them is dealt to
    several tasks by a hash of both.
    """
    eligible = counts.filter(F.col("count") >= MIN_SIZE).select("company")
    dated = df.filter("connected_on IS NOT NULL AND company <> ''").join(eligible, "company", "left_semi")
    member = dated.groupBy(month_key(F.col("connected_on")).alias("month"), "company").agg(F.min("row_idx").alias("idx"))
    # a month comes up with the first row of any employer in it
    first = member.groupBy("month").agg(F.min("idx").alias("month_idx"))
    often = member.groupBy("company").agg(F.count("*").alias("months")).filter(F.col("months") >= min_weight).select("company")
    member = member.join(often, "company", "left_semi")
    sizes = member.groupBy("month").agg(F.ceil(F.count("*") / MONTH_PART).cast("int").alias("parts"))
    member = member.join(sizes, "month").withColumn("part", F.pmod(F.xxhash64("company"), "parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = member.join(first, "month").select("month", "month_idx", F.col("company").alias("source"), F.col("part").alias("i"), every.alias("j"))
    right = member.select("month", F.col("company").alias("target"), every.alias("i"), F.col("part").alias("j"))
    pairs = left.join(right, ["month", "i", "j"]).filter("source < target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"), F.min("month_idx").alias("first_idx")).filter(F.col("weight") >= min_weight)


def top_edges(edges: DataFrame, k: int = 30) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "first_idx", "source", "target").limit(k).select("source", "target", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """Employer, degree and where it is first mentioned (edge order, source before target)."""
    order = [F.col(c) for c in ("first_idx", "source", "target")]
    ends = edges.select(F.col("source").alias("company"), F.struct(*order, F.lit(0).alias("end")).alias("at")).union(edges.select(F.col("target"), F.struct(*order, F.lit(1).alias("end"))))
    return ends.groupBy("company").agg(F.count("*").alias("degree"), F.min("at").alias("first"))


def bridges(edges: DataFrame, counts: DataFrame, k: int = 15) -> DataFrame:
    """Employers by degree, with their size."""
    top = degrees(edges).orderBy(F.desc("degree"), "first").limit(k)
    return counts.join(F.broadcast(top), "company").orderBy(F.desc("degree"), "first").select("company", "degree", F.col("count").alias("size"))  # k rows


def cooccurrence_summary(edges: DataFrame) -> DataFrame:
    """nodes, edges, density, components and the largest one's size."""
    parts = connected_components(edges).groupBy("component").agg(F.count("*").alias("size"))
    shape = parts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"), F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component"))
    one = shape.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
    n = F.col("nodes").cast("double")
    return one.select("nodes", "edges", F.coalesce(rounded(F.try_divide(F.col("edges").cast("double"), n * (n - 1) / 2), 6), F.lit(0.0)).alias("density"), "components", "largest_component")


def public_people(df: DataFrame, redact: bool = False) -> DataFrame:
    """What may be shown of people: never the address; redacted, initials and no link."""
    name = F.btrim(F.concat_ws(" ", "first_name", "last_name"))
    return df.select(
        "row_idx",
        (initials(F.col("first_name"), F.col("last_name")) if redact else name).alias("name"),
        "company",
        "position",
        "seniority",
        "seniority_rank",
        "function",
        F.date_format("connected_on", "yyyy-MM-dd").alias("connected_on"),
        (F.lit("") if redact else F.coalesce("url", F.lit(""))).alias("url"),
    )


def hub_key(mode: str):
    """What people are clustered by; unknown modes are by company."""
    if mode == "year":
        return F.coalesce(F.year("connected_on").cast("string"), F.lit("Undated"))
    return F.col({"function": "function", "seniority": "seniority"}.get(mode, "company"))


def graph_payload(df: DataFrame, cluster_by: str = "company", redact: bool = False, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes (people, then hubs in the order they come up) and edges (person, hub).

    Only the first ``max_nodes`` rows are drawn, so both tables are bounded.
    """
    mode = cluster_by if cluster_by in CLUSTER_MODES else "company"
    first = df.orderBy("row_idx").limit(max_nodes)
    people = first.withColumn("id", F.row_number().over(Window.orderBy("row_idx")).cast("long") - 1).withColumn("key", F.lit("") if mode == "none" else hub_key(mode))
    label = public_people(people, redact).select("row_idx", "name", "url", "connected_on")
    people = people.drop("url", "connected_on").join(label, "row_idx")
    total = people.agg(F.count("*").alias("total"))
    hubs = people.filter("key <> ''").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("id", "name"))).alias("all"))
    hubs = hubs.withColumn("at", F.row_number().over(Window.orderBy("first")).cast("long") - 1).crossJoin(F.broadcast(total))  # one row
    hubs = hubs.select((F.col("total") + F.col("at")).alias("id"), "key", "members", F.transform(F.slice("all", 1, MAX_SAMPLE), lambda s: s["name"]).alias("sample"))
    nodes = people.select("id", F.lit("person").alias("kind"), F.col("name").alias("label"), "company", "position", "seniority", "seniority_rank", "function", "connected_on", "url").unionByName(
        hubs.select("id", F.lit("hub").alias("kind"), F.col("key").alias("label"), "members", "sample"), allowMissingColumns=True
    )
    edges = people.filter("key <> ''").join(F.broadcast(hubs.select("key", F.col("id").alias("hub"))), "key").select(F.col("id").alias("person"), "hub")
    return nodes, edges
