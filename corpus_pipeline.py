"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, tokens. Each stage works on what its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared folder and
reads them again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import bpe, common, fertility, jaccard, mixing, pii

#: No SQL: quality verdicts, boosted spans and tokens have none.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or the fertility bands of their language go."""
    return fertility.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by shingles of five words at a similarity of 0.8 or more, the one of the least id stays."""
    return jaccard.firsts_only(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars counts the new text."""
    return pii.redacted(docs, pii.fitted(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the sources' targets take it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256, lossless of each row."""
    return bpe.encoded(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.settled(docs, f"pipeline-{name}")
    return docs
