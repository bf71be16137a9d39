"""Corpus preparation in five stages: rules, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``. Defined cases are those of the stages:
nulls and blank texts fail the base rules, very long texts go through whole, of repeated
rows one stays, an empty table gives no pieces, other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import exact_dedup, packing, pii, quality_rules, simhash
from rillflow.llm.common import discard, table, tables, written
from rillflow.llm.queries import pii_key, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.rewrite(docs, pii_key(spark))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", sequences),
]

#: Certified cutoffs, fingerprints, surrogates and token ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep; tables that no later stage reads are deleted."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        before = {*tables(), path}
        docs, new = written(stage(spark, docs, sf_dir))
        for old in {*tables()} - before - {new}:
            discard(spark, old)
        if path:
            discard(spark, path)
        path = new
    pieces = STAGES[-1][1](spark, docs, sf_dir)  # stands on checkpoints of its own
    discard(spark, path)
    return pieces
