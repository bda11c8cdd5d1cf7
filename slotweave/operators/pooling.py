"""Sentence vectors from a long token table (utt_id, layer, pos, mask, vec)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions import vectors as V

# Pooling names.
POOLERS = ("first", "last_real", "mean", "mean_first_last", "mean_last_two")


def layer_means(tokens: DataFrame, utt: str = "utt_id") -> DataFrame:
    """Masked mean, first real and last real token vector per (utterance, layer).

    Padding has weight zero; an utterance of nothing but padding has zero weight, which stops the job.
    """
    vec = array_to_vector(V.as_double(F.col("vec")))
    real = F.when(F.col("mask") == 1, F.col("pos"))
    return tokens.groupBy(utt, "layer").agg(
        vector_to_array(Summarizer.mean(vec, F.col("mask").cast("double"))).alias("mean"),
        F.min_by("vec", real).alias("first"),
        F.max_by("vec", real).alias("last_real"),
    )


def _half(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def pool_all(tokens: DataFrame, hows: tuple[str, ...] = POOLERS, utt: str = "utt_id") -> DataFrame:
    """One vector column per pooling, from one pass over the tokens."""
    for how in hows:
        if how not in POOLERS:
            raise ValueError(f"unknown pooling {how!r}")
    stacked = layer_means(tokens, utt).groupBy(utt).agg(
        F.array_sort(F.collect_list(F.struct("layer", "mean", "first", "last_real"))).alias("l")
    )
    top, low = F.element_at("l", -1), F.element_at("l", 1)
    vectors = {
        "first": lambda: V.as_double(top["first"]),
        "last_real": lambda: V.as_double(top["last_real"]),
        "mean": lambda: top["mean"],
        "mean_first_last": lambda: _half(low["mean"], top["mean"]),
        "mean_last_two": lambda: _half(F.element_at("l", -2)["mean"], top["mean"]),
    }
    return stacked.select(utt, *[vectors[how]().alias(how) for how in hows])


def pool(tokens: DataFrame, how: str, utt: str = "utt_id") -> DataFrame:
    """(utt_id, vec) for one pooling."""
    return pool_all(tokens, (how,), utt).select(utt, F.col(how).alias("vec"))
