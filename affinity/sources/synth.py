"""A synthetic export with the phenomena the analysis looks for.

Employers follow a power law with a long tail, connections fall into three
periods with dormancy between them and bursts within, titles rise over time, and
names of employers and dates are written in several ways.
"""

from __future__ import annotations

import csv
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEMS = ["Northwind", "Bluepeak", "Corvid Labs", "Delphi Works", "Everline", "Foxglove", "Granite Bay", "Halcyon", "Ironwood", "Juniper Arc", "Kestrel", "Lumina", "Meridian Co-op", "Nimbus Nine", "Orchard", "Palisade", "Quarry", "Redshift Bio", "Solstice", "Tidewater", "Umber", "Vantage Point", "Willow", "Zephyr"]
TAIL = 120
SUFFIXES = ["", "", "", ", Inc.", " LLC", " Ltd", " Corp."]
TITLES = [["Intern", "Software Engineer", "Data Analyst", "Nurse"], ["Senior Software Engineer", "Data Scientist", "Product Manager", "Account Manager"], ["Engineering Manager", "Director of Sales", "VP of Marketing", "Principal Architect"]]
#: First and last year (from the start) and share of the three periods; share of rows near a burst.
PERIODS, SHARES, BURSTS = [(0.0, 4.0), (5.0, 8.0), (8.7, 11.0)], [0.30, 0.38, 0.32], 0.22


def _chance(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _pick(values: list, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def generate(spark: SparkSession, n: int = 600, seed: int = 42, end: dt.date = dt.date(2026, 1, 1)) -> DataFrame:
    """The seven raw columns of an export with n rows; the same for the same seed."""
    u = lambda key: _chance(key, seed)
    weights = [140 / (k + 1) for k in range(len(STEMS))]
    total, so_far, company = sum(weights) + TAIL, 0.0, None
    for stem, w in zip(STEMS, weights):
        so_far += w / total
        company = F.when(u("company") < so_far, stem) if company is None else company.when(u("company") < so_far, stem)
    company = company.otherwise(F.concat(F.lit("Studio "), F.floor(u("tail") * TAIL).cast("string")))
    period = F.when(u("period") < SHARES[0], 0).when(u("period") < SHARES[0] + SHARES[1], 1).otherwise(2)
    begin, length = _at([p[0] for p in PERIODS], period), _at([p[1] - p[0] for p in PERIODS], period)
    burst = begin + length * F.when(u("which") < 0.5, 0.3).otherwise(0.7) + (u("jitter") - 0.5) * 20 / 365
    years = F.when(u("burst") < BURSTS, burst).otherwise(begin + length * u("when"))
    start = end - dt.timedelta(days=round(11 * 365.25))
    day = F.date_add(F.lit(start), F.floor(years * 365.25).cast("int"))
    level = F.least(F.lit(2), F.floor(u("level") * 2 + 0.18 * period * 2).cast("int"))
    title = F.element_at(F.array(*[_pick(t, u("title")) for t in TITLES]), level + 1)
    rows = spark.range(n).select(
        F.concat(F.lit("Given"), F.floor(u("first") * 97).cast("string")).alias("first_name"),
        F.concat(F.lit("Family"), F.floor(u("last") * 499).cast("string")).alias("last_name"),
        F.concat(F.lit("https://example.com/in/"), F.col("id").cast("string")).alias("url"),
        F.lit("").alias("email"),
        F.when(u("blank") < 0.04, "").otherwise(F.concat(company, _pick(SUFFIXES, u("suffix")))).alias("company_raw"),
        title.alias("position_raw"),
        F.when(u("format") < 0.75, F.date_format(day, "dd MMM yyyy")).otherwise(F.date_format(day, "MMM dd, yyyy")).alias("connected_on_raw"),
    )
    return rows.orderBy("connected_on_raw", "url")


def _at(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)


def write_sample(spark: SparkSession, path: str, n: int = 600, seed: int = 42) -> str:
    """The generated rows as an export file, with the notes that exports begin with."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write('Notes:\n"Addresses are left out where people do not share them."\n\n')
        out = csv.writer(f)
        out.writerow(["First Name", "Last Name", "URL", "Email Address", "Company", "Position", "Connected On"])
        out.writerows(tuple(r) for r in generate(spark, n, seed).toLocalIterator())
    return path
