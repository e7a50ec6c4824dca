"""From raw documents to packed sequences: stages that each work on what the one before kept.

The quality stage trains a classifier, so no SQL gives these rows; tests check each stage against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, mixing, near_join, packing, quality
from quern.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of similarity 0.8 or more connect the smallest doc_id stays."""
    return near_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time cut to the words it takes."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a document taken twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", dedup_stage),
    ("near dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
