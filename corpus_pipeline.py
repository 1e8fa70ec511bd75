"""From raw documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, ngram_join, packing, quality_classifier, quality_rules
from tidemark.llm.common import staged, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts good; rejected ones go."""
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "labels"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base limits that are no outliers of their language and source."""
    return quality_rules.kept_documents(docs)


def passages_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with later occurrences of repeated three-line windows cut out of their texts."""
    return line_dedup.cleaned_documents(docs)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket_len, batch, slot and padding of every document."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("line dedup", passages_removed),
    ("n-gram Jaccard join", near_copies_removed),
    ("packing", packed),
]

#: Training, concentration steps and the trie join have no counterpart in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
