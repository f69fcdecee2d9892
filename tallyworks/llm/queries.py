"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import clustering, filter_audit, nearest, packing, pieces, pii, quality_classifier, quality_rules, secret_scan, simhash, token_counts, toxicity, trie_bpe
from tallyworks.llm.common import fold, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~fold(4, 2))
    scored = docs.select("doc_id", fold(4, 2).alias("held_out"), toxicity.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_classifier.described(table(spark, sf_dir, "documents"))
    model = quality_classifier.fit(stats, table(spark, sf_dir, "labels"), ~fold(3, 1))
    scored = stats.select("doc_id", fold(3, 1).alias("held_out"), quality_classifier.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_counts.token_count(F.col("text"), "word_bpe_49k.json").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digest(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_toxicity, op3_packing, op4_quality_classifier, op5_secrets, op6_pii, op7_sentencepiece, op8_nearest, op9_simhash, op10_token_counts, op11_filter_audit, op12_trie_bpe, op13_clusters, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Sketches, models, tokenizers and iteration until nothing changes aren't SQL; the tests hold those queries against brute force."""
    return {"op11_filter_audit": filter_audit.SQL, "op13_clusters": clustering.SQL}
