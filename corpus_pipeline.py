"""A pipeline over ``documents``: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyworks.llm import packing, pii, quality_rules, simhash, toxicity
from tallyworks.llm.common import fold, ship, small_batches, staged

TOXIC_FROM = 0.3


def to_python(spark: SparkSession) -> None:
    """What a stage that runs Python needs: this package on the executors, and batches that leave their memory to the stages' own tables."""
    ship(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit."""
    to_python(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold(4, 2))
    return docs.where(toxicity.score(model) < TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's adaptive thresholds."""
    return quality_rules.keep_good(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    to_python(spark)
    return simhash.one_per_group(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pii.masked(docs, pii.key_of(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows."""
    to_python(spark)
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_good), ("near duplicates", one_per_group), ("personal data", mask), ("packing", pack)]
#: The stages use fitted models, sketches, iteration and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
