"""The registered queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm import licences, packing, pieces, piecewise, preferences, prefixes, quality, rules, simhash, toxicity, urls, whitening, windows
from slotweave.llm.common import table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_piecewise(spark: SparkSession, folder: str) -> DataFrame:
    return piecewise.fingerprints(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def op7_preferences(spark: SparkSession, folder: str) -> DataFrame:
    return preferences.format_conversations(table(spark, folder, "conversations"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op11_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, folder, "conversations"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.pack_windows(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_piecewise, op3_quality, op4_pieces, op5_toxicity, op6_urls, op7_preferences, op8_packing, op9_rules,
    op10_licences, op11_prefixes, op12_whitening, op13_windows,
)}

ORACLES: dict[str, str] = {
    "op6_urls": urls.oracle(),
    "op7_preferences": preferences.oracle(),
    "op10_licences": licences.oracle(),
    "op11_prefixes": prefixes.oracle(),
}
