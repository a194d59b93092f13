"""A training-corpus pipeline over the documents table.

Documents that the quality classifier rejects go; of each group of near
duplicates one document stays; languages are mixed to target weights by seeing
documents of the rarer ones more often (no document goes); and what is left is
packed into training sequences.  Each stage reads the table the one before it
wrote.

Cases: rows without an id go through all stages, each by itself.  Null and empty
texts get the score of the classifier's bias, link with nothing, are mixed by the
prior and packed as their end alone.  Rows that repeat an id are kept, dropped and
copied together.  Without labels of both classes the score is the share of label
1, which rejects all only below the least score.  Extra columns, whatever their
names, are kept up to packing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affinity.llm import mixing, near_dedup, packing, quality
from affinity.llm.common import table, written
from affinity.llm.queries import LANGUAGES, QUALITY_LEAST, labelled_languages, quality_held_out
from affinity.storage import ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough; the classifier learns from those at hand."""
    labels = table(spark, sf_dir, "labels").filter(~quality_held_out())
    return docs.filter(quality.scorer(docs, quality.learn(docs, labels)) >= QUALITY_LEAST)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return near_dedup.keep_one(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages' tokens have the target weights; none goes."""
    return mixing.mixed(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), LANGUAGES, floor=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: No SQL expresses the classifier, the fit or the packing; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each to what the one before it kept."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
