"""The corpus pipeline: stages over documents, each written as Parquet before the next one reads it.

Quality rules drop what the learned list (or its base) rejects; the classifier drops what it scores as bad; of
each near-duplicate group one document stays; the rest is packed into sequences. Every stage works on all rows
its predecessor kept, and all but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm import nearcopies, packing, quality, rules
from slotweave.llm.common import small_batches
from slotweave.session import stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and no rejecting rule covers. A null text has no words and goes."""
    small_batches(spark)
    found = rules.learn_from(docs, _labels(spark, sf_dir))
    s = F.col("__statistics")
    tagged = docs.withColumn("__statistics", rules.statistics_column())
    return tagged.where(~rules.base_failed(s) & rules.verdict(found, s)).drop("__statistics")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores as good."""
    small_batches(spark)
    model = quality.train(docs, _labels(spark, sf_dir))
    return docs.where(quality.score_column(model) >= quality.KEEP)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id; nulls last, then by text hash and row number.

    Documents link when their sets of five-word shingles have a similarity of 0.8 or more. Ids neither link nor
    drop rows: unlike texts under one id, or without an id, are groups of their own.
    """
    numbered = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = nearcopies.near_copies(numbered.select(F.col("__row").alias("row"), "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col("__row").alias("row"))
    keys = numbered.select(F.col("__row").alias("row"), order.alias("order"))
    kept = groups.join(keys, "row").groupBy("root").agg(F.min("order").alias("order")).select(F.col("order.row").alias("__row"))
    return numbered.join(kept, "__row", "left_semi").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their sequence and place."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

# Learned verdicts, fingerprints and token counts have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
