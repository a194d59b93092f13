from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from affinity.functions import dates, text

#: One case or more for each step of the cascade, and for what it leaves alone.
COMPANIES = [
    ("Harbour, Ltd.", "Harbour"), ("Harbour plc", "Harbour"), ("Harbour Tools AG, LLC", "Harbour Tools"), ("Harbour (once Quay)", "Harbour"), (" \t Harbour    Corporation -", "Harbour"), ("aws", "Amazon"), ("Meta Platforms", "Meta"),
    ("none", ""), ("–", ""), ("   ", ""), (None, ""), ("QRST", "QRST"), ("R&D WORKS LP", "R&D Works"), ("NORTHERN TIMBER", "Northern Timber"), ("‘Cited’ GmbH", "Cited"), ("ｆｕｌｌ BV", "full"), ("Y & Co", "Y &"), ("PricewaterhouseCoopers LLP", "PwC"),
]
#: Each rung, with titles that several rules fit.
LEVELS = [("Co-Founder and CTO", "founder_owner"), ("Head of Data", "executive"), ("Board Member", "executive"), ("Sr. Director, Design", "director"), ("Night Supervisor", "manager"), ("Lead Developer", "staff_principal"), ("Senior Clerk", "senior"), ("Summer Trainee", "student"), ("Bookkeeping Assistant", "individual_contributor"), ("  ", "unknown"), ("Painter", "unknown")]
#: Each function, with titles that several rules fit.
FUNCTIONS = [("Analytics Developer", "data_ai"), ("Machine Learning Lead", "data_ai"), ("Cloud Platform Lead", "engineering"), ("Scrum Master", "product"), ("Illustrator", "design"), ("Ward Physician", "healthcare"), ("Partnership Lead", "sales"), ("Head of Growth", "marketing"), ("Treasurer", "finance"), ("Talent Partner", "people_ops"), ("Paralegal", "legal"), ("Logistics Clerk", "operations"), ("Faculty Member", "education_research"), ("Owner", "executive_general"), ("Painter", "unclassified")]
DATES = [("15 Mar 2022", (2022, 3, 15)), ("15 March 2022", (2022, 3, 15)), ("Mar 15, 2022", (2022, 3, 15)), ("March 15, 2022", (2022, 3, 15)), ("2022-03-15", (2022, 3, 15)), ("2022-3-5", (2022, 3, 5)), ("05/04/2022", (2022, 5, 4)), ("13/04/2022", (2022, 4, 13)), ("3/15/22", (2022, 3, 15)), ("3/15/75", (1975, 3, 15)), ("15  Mar  2022", (2022, 3, 15)), ("13/04/22", None), ("30 Feb 2022", None), ("13/45/9999", None), ("soon", None), ("", None), ("   ", None), (None, None)]


def mapped(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").select("o").collect()]


@pytest.mark.parametrize("unicode", [True])
def test_companies(spark, unicode):
    assert mapped(spark, [a for a, _ in COMPANIES], lambda c: text.canonical_company(c, unicode)) == [b for _, b in COMPANIES]


def test_companies_are_stable(spark):
    once = mapped(spark, [a for a, _ in COMPANIES], text.canonical_company)
    assert mapped(spark, once, text.canonical_company) == once


def test_seniority(spark):
    assert mapped(spark, [a for a, _ in LEVELS], text.seniority) == [b for _, b in LEVELS]
    assert mapped(spark, text.LADDER, text.seniority_rank) == list(range(9))


def test_function(spark):
    assert mapped(spark, [a for a, _ in FUNCTIONS], text.job_function) == [b for _, b in FUNCTIONS]


def test_dates(spark):
    assert mapped(spark, [a for a, _ in DATES], dates.parse_connected_on) == [dt.date(*b) if b else None for _, b in DATES]


def test_tokens_and_initials(spark):
    assert mapped(spark, ["Senior C++ Dev. and Data Lead"], text.title_tokens) == [["c++", "dev.", "data", "lead"]]
    df = spark.createDataFrame([("ann", ""), ("", "bo")], "f string, l string")
    assert [r[0] for r in df.select(text.initials(F.col("f"), F.col("l"))).collect()] == ["A.?.", "?.B."]
