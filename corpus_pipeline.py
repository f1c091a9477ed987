"""The corpus pipeline: every stage takes (spark, docs, sf_dir), is written as Parquet and reread."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ngram_join, packing, quality_mil, toxicity
from tidemark.session import checkpoint_dir, with_code


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@with_code
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


@with_code
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low predicted quality go."""
    return quality_mil.keep_good(docs, _labels(spark, sf_dir))


@with_code
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.keep_one(docs)


@with_code
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: The stages learn models and walk token sequences, which SQL can't express; tests hold them to brute force.
ORACLE_SQL = None


@with_code
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows go through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline_{name}_{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
