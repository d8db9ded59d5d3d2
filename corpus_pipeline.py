"""From raw documents to packed sequences: toxicity, quality, boilerplate lines, near-duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next one's
documents. All but the last return the columns of ``documents``. Python gets the texts in small batches, as the stages
share their executors; the setting stays in the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmill.llm import packing, probminhash, site_lines, toxicity, weak_rules
from fieldmill.llm.common import DOCUMENT_COLUMNS, small_batches, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(*DOCUMENT_COLUMNS)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return weak_rules.drop_low_quality(docs).select(*DOCUMENT_COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return site_lines.drop_boilerplate_lines(docs).select(*DOCUMENT_COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return probminhash.drop_near_duplicates(docs).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_quality),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_near_duplicates),
    ("packing", packed),
]

# Trees, expectation-maximisation and registers are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
