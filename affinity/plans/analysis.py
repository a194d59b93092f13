"""The whole analysis document from enriched connections.

Sections are DataFrames; what is collected is what the document shows: one row
for each estimator table, months, years, and lists with a fixed limit.
"""

from __future__ import annotations

import datetime as dt
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity import SCHEMA_VERSION
from affinity.operators import network, sections, temporal
from affinity.plans import insights
from affinity.sources.export import MAX_BYTES, ParseReport, read_export
from affinity.storage import shared_dir


def _plain(value: Any) -> Any:
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()[:10]
    return value


def _rows(df: DataFrame) -> list[dict]:
    return [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


def _one(df: DataFrame) -> dict:
    return next(iter(_rows(df)), {})


def companies(counts: DataFrame) -> dict:
    stats = _one(sections.concentration(counts))
    if not stats:
        return {"available": False, "reason": "No connection has an employer."}
    shown = ("gini", "hhi_normalized", "shannon_entropy", "pielou_evenness", "effective_companies", "top_10_share", "singleton_rate", "powerlaw_alpha", "tail_regime")
    return {
        "available": True,
        "distinct": stats["distinct"],
        "largest": _rows(sections.top_companies(counts)),
        "size_distribution": {r["size"]: r["companies"] for r in _rows(sections.size_distribution(counts).orderBy("size"))},
        "concentration": {k: stats[k] for k in shown},
        "median_cluster_size": stats["median_cluster_size"],
        "p95_cluster_size": stats["p95_cluster_size"],
    }


def temporal_section(days: DataFrame, dated: int) -> dict:
    if dated < 2:
        return {"available": False, "reason": "Fewer than two connections have a date."}
    months = temporal.monthly(days)
    activity, half = _one(temporal.activity(months)), _one(temporal.half_life(days))
    peak = {"month": activity.pop("peak_month"), "count": activity.pop("peak_count")}
    return {
        "available": True,
        "monthly": _rows(months.orderBy("month")),
        "yearly": _rows(temporal.yearly(days).orderBy("year")),
        **activity,
        "peak_month": peak,
        "bursts": _rows(temporal.bursts(months).orderBy("month")),
        "accumulation_half_life": half["half_life"],
        "half_life_elapsed_fraction": half["elapsed_fraction"],
        "longest_dormancy": _one(temporal.longest_dormancy(days)),
        "velocity": _one(temporal.velocity(days)),
    }


def composition(df: DataFrame) -> dict:
    by_year = sections.seniority_by_year(df)
    drift = _one(sections.seniority_drift(by_year))
    years = drift.pop("years")
    line = {"available": True, "by_year": _rows(by_year.orderBy("year"))} | drift if years >= 3 else {"available": False, "by_year": _rows(by_year.orderBy("year"))}
    functions = df.groupBy("function").agg(F.count("*").alias("count"), F.min("row_idx").alias("i")).orderBy(F.desc("count"), "i").select("function", "count")
    return {
        "seniority": {"distribution": _rows(sections.seniority_distribution(df).orderBy("rank")), **_one(sections.seniority_summary(df)), "drift": line},
        "function": {"distribution": _rows(functions), **_one(sections.function_summary(sections.function_counts(df)))},
    }


def structure(df: DataFrame, counts: DataFrame) -> dict:
    s = _one(sections.structure(counts, df))
    return {
        "bipartite": {k: s[k] for k in ("people", "companies", "edges", "density", "unaffiliated_people")},
        "projection": {
            "note": "Everyone has one employer here, so these are disjoint cliques, one for each employer.",
            "edges": s["projection_edges"],
            "density": s["projection_density"],
            **{k: s[k] for k in ("mean_degree", "max_degree", "components", "largest_component_share", "isolate_share")},
        },
        "company_cooccurrence": cooccurrence(df, counts),
    }


def cooccurrence(df: DataFrame, counts: DataFrame, min_weight: int = network.MIN_WEIGHT) -> dict:
    candidates = counts.filter(F.col("count") >= network.MIN_SIZE).count()
    if candidates < 2:
        return {"available": False, "reason": "Fewer than two employers have several connections."}
    edges = network.cooccurrence_edges(df, counts, min_weight).persist()
    try:
        top = _rows(network.top_edges(edges))
        if not top:
            return {"available": False, "reason": f"No two employers share {min_weight} months.", "candidate_companies": candidates}
        return {
            "available": True,
            "inferred": True,
            "method": "months in which both employers gained connections",
            "min_weight": min_weight,
            **_one(network.cooccurrence_summary(edges)),
            "top_edges": top,
            "bridges": _rows(network.bridges(edges, counts)),
        }
    finally:
        edges.unpersist()


def eras(df: DataFrame, days: DataFrame, dated: int) -> dict:
    if dated < temporal.ERA_ROWS:
        return {"available": False, "reason": f"Fewer than {temporal.ERA_ROWS} connections have a date."}
    found = temporal.era_days(days).persist()
    try:
        profile = _rows(temporal.era_profile(df, found).orderBy("era"))
        tops = {"top_companies": ("company", "", 5), "top_functions": ("function", "unclassified", 4)}
        lists = {name: _rows(temporal.era_top(df, found, *how).orderBy("era", "place")) for name, how in tops.items()}
        lists["distinctive_terms"] = _rows(temporal.distinctive_terms(df, found).orderBy("era", "place"))
        rule = found.select("gap_threshold_days", "min_segment_size").first()
    finally:
        found.unpersist()
    for era in profile:
        k = era.pop("era")
        era |= {name: [{c: v for c, v in r.items() if c not in ("era", "place")} for r in rows if r["era"] == k] for name, rows in lists.items()}
    return {"available": True, "method": "gaps between connections", "gap_threshold_days": rule[0], "min_segment_size": rule[1], "count": len(profile), "eras": profile}


def graph(df: DataFrame, cluster_by: str, redact: bool, max_nodes: int = network.MAX_NODES) -> dict:
    mode = cluster_by if cluster_by in network.CLUSTER_MODES else "company"
    nodes, edges = network.graph_payload(df, mode, redact, max_nodes)
    nodes, edges = _rows(nodes.orderBy("id")), [[r["person"], r["hub"]] for r in edges.orderBy("person").collect()]
    hubs, people = {"id", "kind", "label", "members", "sample"}, {"members", "sample"}
    nodes = [{k: v for k, v in n.items() if (k in hubs if n["kind"] == "hub" else k not in people)} for n in nodes]
    return {"cluster_by": mode, "redacted": redact, "truncated": df.count() > max_nodes, "node_count": len(nodes), "edge_count": len(edges), "nodes": nodes, "edges": edges}


def analyze(df: DataFrame, report: ParseReport | None = None, *, cluster_by: str = "company", redact: bool = False, include_graph: bool = True, max_nodes: int = network.MAX_NODES) -> dict:
    """The analysis document of enriched connections."""
    began = time.perf_counter()
    kept = df.is_cached
    df = df.persist()
    try:
        counts, days = sections.company_counts(df).persist(), temporal.day_counts(df).persist()
        overview, resolution = _one(sections.overview(df)), _one(sections.entity_resolution(df))
        rate = resolution.pop("merge_rate")
        if report is None:
            c = _one(sections.completeness(df))
            report = ParseReport(rows_scanned=c["rows"], rows_parsed=c["rows"], missing_company=c["missing_company"], missing_position=c["missing_position"], unparsed_dates=c["unparsed_dates"])
        out = {
            "schema_version": SCHEMA_VERSION,
            "overview": overview,
            "data_quality": {"ingest": report.to_dict(), "entity_resolution": resolution, "resolution_merge_rate": rate},
            "companies": companies(counts),
            "temporal": temporal_section(days, overview["with_date"]),
            "composition": composition(df),
            "structure": structure(df, counts),
            "eras": eras(df, days, overview["with_date"]),
        }
        out["insights"] = insights.generate(out)
        if include_graph:
            out["graph"] = graph(df, cluster_by, redact, max_nodes)
        out["runtime_ms"] = round((time.perf_counter() - began) * 1000, 1)
        return out
    finally:
        for t in (counts, days, *([] if kept else [df])):
            t.unpersist()


def analyze_path(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, **how) -> dict:
    df, report = read_export(spark, path, max_bytes)
    return analyze(df, report, **how)


def analyze_bytes(spark: SparkSession, raw: bytes, **how) -> dict:
    """The same for the contents of a file; they pass through the folder that executors share."""
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}.csv"
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(place)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
    try:
        return analyze_path(spark, path, **how)
    finally:
        fs.delete(place, False)
