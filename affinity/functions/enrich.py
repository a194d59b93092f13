"""The derived columns of a connection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions import dates, text


def enrich(raw: DataFrame, unicode: bool = True) -> DataFrame:
    """company, position, connected_on, seniority, seniority_rank and function beside the raw columns.

    One projection; doing it again gives the same.  ``unicode=False`` leaves out
    compatibility normalisation where texts are known to be plain.
    """
    df = raw.withColumns(
        {
            "company": text.canonical_company(F.col("company_raw"), unicode),
            "position": text.clean_title(F.col("position_raw"), unicode),
            "connected_on": dates.parse_connected_on(F.col("connected_on_raw")),
        }
    )
    label = text.seniority(F.col("position"))
    df = df.withColumns({"seniority": label, "function": text.job_function(F.col("position"))})
    return df.withColumn("seniority_rank", text.seniority_rank(F.col("seniority")))
