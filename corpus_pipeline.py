"""A training corpus from raw documents: five stages, each over all that the one before kept.

Toxic documents go, one document of each class of near-duplicates stays,
documents with benchmark passages go, sources are mixed to target weights by
sampling, and the rest is laid into shards. Every stage but the last returns
the columns of the documents it took.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from concord.llm import decontam, mixing, sharding, simhash, toxicity
from concord.llm.common import table
from concord.session import shared_dir

SHARDS = 24
MIXTURE = mixing.Targets(tempers={"source": 0.9, "lang": 0.95, "topic": 1.0})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, MIXTURE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # trained scores and fingerprints are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is kept in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
