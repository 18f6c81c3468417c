"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, quality, queries, secrets, simhash
from folioforge.llm.shared import mark, materialize, sweep


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null, empty and blank texts score as texts without any statistic."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose 5-word shingles are 0.8 or more alike, the row with the smallest id, once; rows without an id come last."""
    return simhash.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item, judged by text, so that rows without an id or of one id are judged by themselves."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text, null for null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 4096 ids."""
    return queries.packed_digests(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("decontamination", uncontaminated), ("secrets", without_secrets), ("packing", packed)]
ORACLE_SQL = None  # learned models and closures; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = mark()
        docs = materialize(stage(spark, docs, sf_dir), name)
        sweep(spark, since, docs)  # what the stage wrote on its way; earlier stages' results stay
    return docs
