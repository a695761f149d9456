"""From raw documents to a training mix, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumisift.llm import stages
from lumisift.llm.common import Scratch, table

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("benchmark_passages", stages.benchmark_passages),
    ("source_mix", stages.source_mix),
]

# The fitted classifier has no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each reads what the one before has written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
