"""A training corpus from raw documents: quality rules, quality classifier, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run`` writes what a stage returns to the shared folder and reads it again.
All but the last return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm import op1_minhash, op2_quality_rules, op6_packing, op8_quality_classifier, op10_exact_dedup
from tracefold.llm.common import table
from tracefold.session import write_through


#: Words of a shingle of the near-dedup.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_quality_rules.keep_rows(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_quality_classifier.keep_rows(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_exact_dedup.keep_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_minhash.keep_rows(docs, SHINGLE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("packing", packing),
]
#: The classifier, the near-dedup and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
