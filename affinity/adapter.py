"""Connections derived from the orders table, in Spark and in SQL.

The test tables hold no export of connections; all orders stand in for one.
Those of two periods have no date, so there are pauses and undated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions.enrich import enrich
from affinity.functions.text import ALIASES, FUNCTION_RULES, LADDER, LEGAL_SUFFIXES, SENIORITY_RULES

# Fixed values of the stand-in.
STEMS = ["Northgate", "Contina", "Fabrix", "Litmus", "Advent", "Tailrace", "Prosper", "Widemark", "Lumen", "Woodrow"]
SUFFIXES = ["", "", ", Inc.", " LLC", " Ltd."]
TITLES = ["Software Engineer", "VP of Engineering", "Data Scientist", "Registered Nurse", "Product Manager", "Senior Director", "Founder", ""]
DORMANT = [("1996-11-01", "1997-03-01"), ("1999-05-01", "1999-10-16")]


def raw_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    dated = F.lit(True)
    for a, b in DORMANT:
        dated = dated & ~((day >= F.lit(a).cast("date")) & (day < F.lit(b).cast("date")))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    stem = pick(STEMS, 1 + F.least(F.lit(9), F.floor(F.log((1 + cust % 97).cast("double")) * 2.2)))
    return orders.select(
        key.alias("row_idx"),
        F.concat(F.lit("First"), (cust % 13).cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), (key % 17).cast("string")).alias("last_name"),
        F.concat(F.lit("https://example.com/in/"), key.cast("string")).alias("url"),
        F.when(key % 25 == 0, "").otherwise(F.concat(stem, pick(SUFFIXES, 1 + key % 5))).alias("company_raw"),
        pick(TITLES, 1 + key % 8).alias("position_raw"),
        F.when(dated, F.when(key % 4 == 3, F.date_format(day, "MMM dd, yyyy")).otherwise(F.date_format(day, "dd MMM yyyy"))).otherwise(F.lit("")).alias("connected_on_raw"),
    )


_INGESTED: dict[tuple[str, str], DataFrame] = {}


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched rows, kept by Spark once a query has made them: an export is ingested once, and queries read that.

    Memory and disk of the executors hold them; what is lost is made again.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INGESTED:
        _INGESTED[key] = enrich(raw_connections(spark, sf_dir), unicode=False).persist()
    return _INGESTED[key]


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _strip(s: str, chars: str) -> str:
    return f"trim({s}, '{chars}')"


def company_sql(raw: str) -> str:
    s = _strip(f"regexp_replace({raw}, '\\s+', ' ', 'g')", " -")
    s = f"regexp_replace({s}, '\\s*\\([^)]*\\)\\s*$', '')"
    for _ in range(2):
        s = _strip(f"regexp_replace({s}, '[,\\s]+(?:{LEGAL_SUFFIXES})\\s*$', '', 'i')", " ,")
    aliases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())
    return f"CASE lower({s}) {aliases} ELSE {s} END"


def rules_sql(title: str, rules: list[tuple[str, str]], whole: bool, none: str) -> str:
    end = r"\b" if whole else ""
    return "CASE " + " ".join(f"WHEN regexp_matches({title}, '\\b({words}){end}', 'i') THEN '{label}'" for label, words in rules) + f" ELSE '{none}' END"


def connections_sql() -> str:
    """The common table expressions raw and conn; queries go on after them."""
    dormant = " AND ".join(f"NOT (d >= DATE '{a}' AND d < DATE '{b}')" for a, b in DORMANT)
    ladder = " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(LADDER))
    return f"""WITH picked AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders),
    raw AS (SELECT o_orderkey AS row_idx, 'First' || (o_custkey % 13) AS first_name, 'Last' || (o_orderkey % 17) AS last_name,
        'https://example.com/in/' || o_orderkey AS url,
        CASE WHEN o_orderkey % 25 = 0 THEN '' ELSE ({_list(STEMS)})[CAST(1 + least(9, floor(ln(1 + o_custkey % 97) * 2.2)) AS INT)] || ({_list(SUFFIXES)})[CAST(1 + o_orderkey % 5 AS INT)] END AS company_raw,
        ({_list(TITLES)})[CAST(1 + o_orderkey % 8 AS INT)] AS position_raw,
        CASE WHEN NOT ({dormant}) THEN '' WHEN o_orderkey % 4 = 3 THEN strftime(d, '%b %d, %Y') ELSE strftime(d, '%d %b %Y') END AS connected_on_raw
        FROM picked),
    named AS (SELECT *, {company_sql('company_raw')} AS company, trim(position_raw) AS position,
        CAST(coalesce(try_strptime(connected_on_raw, '%d %b %Y'), try_strptime(connected_on_raw, '%b %d, %Y')) AS DATE) AS connected_on FROM raw),
    ruled AS (SELECT *, {rules_sql('lower(position)', SENIORITY_RULES, True, 'unknown')} AS seniority, {rules_sql('position', FUNCTION_RULES, False, 'unclassified')} AS function FROM named),
    conn AS (SELECT *, CAST(CASE seniority {ladder} END AS INTEGER) AS seniority_rank FROM ruled)
    """
