"""Stages of the corpus pipeline; all but the last return the columns of the documents they get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import decontaminate, langid, line_dedup as lines, ngram_join, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; those without letters go."""
    model = langid.train(docs)
    return langid.identify(docs, model, keep=tuple(docs.columns)).where(langid.accepted()).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that are boilerplate of their source; every document stays.

    Copies and near copies do not vote: they are left to the next stage with the lines that they share.
    """
    return with_length(lines.drop_boilerplate(docs, "source", "text", copies_vote=False))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; documents that mainly consist of them go."""
    parts = decontaminate.automata(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = decontaminate.decontaminate(docs, parts, keep=tuple(c for c in docs.columns if c != "text"))
    return with_length(out).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left."""
    return packing.pack(packing.token_pieces(docs))


def with_length(docs: DataFrame) -> DataFrame:
    """Bring ``n_chars`` in line with a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
