"""Corpus pipeline: five operators of ``tickloom.llm`` applied one after another to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import stages
from tickloom.session import materialise

#: (name, function); each function takes (spark, docs, sf_dir).
STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("best_fit_packing", stages.best_fit_packing),
]

#: Trained classification and byte-pair tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's result is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
