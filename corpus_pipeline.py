"""Corpus pipeline over ``documents``: quality rules, exact copies, near copies, personal data, packing.

Each stage works on all that the one before kept; its result is written as Parquet and read as the next one's
input. All but the last return the columns of ``documents``. Quality rules, exact copies and near copies drop rows,
personal data is masked in the text, and the last stage returns one row per packed piece. Nulls in any column,
empty texts, repeated rows, further columns and empty tables go through as the operators define them; a row that
repeats both id and text is one document to the stages that drop copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairshift.llm.best_fit_packing import best_fit_packing
from pairshift.llm.common import table, written
from pairshift.llm.exact_dedup import drop_exact_copies
from pairshift.llm.host_quality import drop_low_quality
from pairshift.llm.jaccard_join import drop_near_copies
from pairshift.llm.pii import mask_pii


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the document rules, or stand on a rejected host, go."""
    return drop_low_quality(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest ``doc_id`` stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts, the row with the smallest ``doc_id`` stays."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 4096 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("pii", personal_data),
    ("packing", packing),
]

#: Tokens and best-fit bins are beyond SQL; tests hold the result against a single-machine version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
