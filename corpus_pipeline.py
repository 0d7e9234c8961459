"""The corpus pipeline: five stages over ``documents``, each written as
Parquet and read again as the next one's input.

    toxicity -> exact dedup -> SimHash near-dedup -> decontamination -> mix

Every stage judges all its predecessor kept. All but the last return the
columns of ``docs``; the last adds ``mix_copy`` (1..n), one row per copy that
the mix takes. Rows are judged by their own id and text, so rows that share an
id, or have none, don't fall with each other; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hirefold.llm import common, decontaminate, exact, mixing, simhash, toxicity
from hirefold.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    common.prepare(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    common.prepare(spark)
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the smallest id stays."""
    common.prepare(spark)
    return simhash.drop_near_duplicates(docs, words=3, radius=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    common.prepare(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes."""
    common.prepare(spark)
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_leaks), ("mix to target weights", mix_sources)]

#: Not expressible in SQL: a trained classifier, XXH64 fingerprints and latent retrieval.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage outputs go to the shared folder."""
    base = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
