"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.llm import bpe, licenses, mixing, pu_quality, quality, secrets, sharding, simhash, topk, toxicity
from tessara.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.cascade(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")], report=quality.REPORTED))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), sharding.shard_names(64)).select("doc_id", "slot", "shard")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")]))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.encode(docs, decoded="decoded"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_groups(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_quality_rules, op3_license_scan, op4_shard, op5_toxicity,
        op6_secret_scan, op7_byte_bpe, op8_quality_classifier, op9_exact_top_k, op10_simhash,
    )
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_quality_rules": quality.ORACLE,
    "op4_shard": sharding.oracle(),
    "op9_exact_top_k": topk.ORACLE,
}
