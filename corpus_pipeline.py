"""The corpus pipeline: documents to a mixed training set, one written table per stage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's documents.  All stages but the last return the columns of
`documents`; the last adds `copy_no`.  Each stage works on all rows that the one before has kept.
Rows of a null id pass through each stage by the rules in the operators' docstrings.

Stages whose last step runs Python over whole texts write it themselves, in small Arrow batches, and delete the
tables that it was made of; the session's settings stay as they are.
"""

from __future__ import annotations

from eodlake.llm import decontaminate, mixing, quality, simhash, suffix_dedup
from eodlake.llm.common import cut, passing, table
from pyspark.sql import DataFrame, SparkSession


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the models are fitted on `docs` and `labels`."""
    return passing(spark, lambda: quality.keep(docs, table(spark, sf_dir, "labels")), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that stand earlier too."""
    return passing(spark, lambda: suffix_dedup.without_repeats(docs), "kept")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy taken into the mix."""
    return mixing.emit(docs)


STAGES = [
    ("quality", quality_filter),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("mix", mixed_sources),
]

#: Hashed models, fingerprints and digests have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
