"""The corpus pipeline: documents to mixed, tokenised training text.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage keeps as Parquet to
the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import stages
from plotweave.llm.common import materialize, table
from plotweave.llm.queries import PATTERN, RANK_FILE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.fewer_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.encoded(docs, RANK_FILE, PATTERN)


STAGES = [
    ("language", language),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
