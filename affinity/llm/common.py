"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.storage import forget, written

__all__ = ["ASCII_UPPER", "SPACE", "ascii_lower", "forget", "table", "written"]

#: White space as the contracts define it: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())
