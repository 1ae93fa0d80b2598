"""The corpus pipeline: five stages over ``documents``, each working on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontaminate, jaccard, langid, mixing, sharding
from seqloom.plans.lineage import discard, materialize, scope, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 on five-word shingles connect stays."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the source weights ask for, up to twice."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there; a column of ``docs`` with such a name comes as ``carried_`` and its name."""
    return sharding.shard(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("shards", shards)]

#: Fitted models, edit distances and seeded picks are beyond SQL. tests/llm holds near_duplicates, benchmark, mix and shards
#: against brute force, and language against a plain version of its model and the labels of held-out documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope():
            new = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        discard(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
