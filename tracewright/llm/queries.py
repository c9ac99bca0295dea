"""One query for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, embedding, license, lm, quality, sharding, simhash, toxicity, urlfilter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find(documents, benchmark)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.apply(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    stems = toxicity.learn_stems(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, toxicity.lexicon(stems=stems))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_decontaminate, op3_licenses, op4_quality, op5_url_filter, op6_lm_scores, op7_embeddings, op8_toxicity, op9_bpe, op10_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": urlfilter.oracle_sql(), "op6_lm_scores": lm.oracle_sql(), "op10_shards": sharding.oracle_sql()}
