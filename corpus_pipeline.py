"""From documents to token ids: quality rules, near-duplicates, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents.

Cases: null and empty texts fail the quality rules and go; a null id, language or source stays as it is, and null languages and sources are one
value of the mixture; repeated rows are near-duplicates of each other, so one stays; of a group the smallest id stays; an empty table, or one of
which nothing is kept, goes through every stage and gives no rows; further columns are carried along to the mixture, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, mixing, neardup, pii, quality
from corpusloom.llm.common import table, written

#: Share of the tokens that the mixture keeps.
MIXTURE_BUDGET = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the current policy rejects go."""
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return neardup.without_near_duplicates(docs, 5, 80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is redacted; every document stays."""
    return pii.redacted_documents(docs, pii.train(docs))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    return mixing.sample_documents(docs, budget=MIXTURE_BUDGET)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of each document."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixture", mixture_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL can state neither the trees nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
