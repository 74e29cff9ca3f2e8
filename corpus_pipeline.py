"""Corpus pipeline: five stages of the corpus operators over ``documents``.

Every stage works on all that its predecessor kept, is written as Parquet and
read again; all but the last return the columns of ``documents``.  Their
handling of nulls, empty texts, repeated rows and empty tables is that of the
operators they call (see ``quorum.llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorum.llm import decontaminate, language_mix, line_rules, near_dedup, packing
from quorum.llm.common import table, written
from quorum.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language has half of the mixture."""
    return language_mix.keep_known(docs, language_mix.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    return line_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near-duplicates."""
    return near_dedup.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("near-dedup", near_duplicates),
          ("decontamination", benchmark_leaks), ("packing", packed)]

# Language mixtures and packing cannot be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
