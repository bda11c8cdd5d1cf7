"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ok(predicted: str, intent: str) -> Column:
    return F.col(predicted).eqNullSafe(F.col(intent))


def intent_metrics(predictions: DataFrame, parts: list[str] | None = None, intent: str = "intent",
                   predicted: str = "ref_intent") -> DataFrame:
    """Correct, total, accuracy % per intent and overall (intent is null in the overall row)."""
    parts = parts or []
    per_intent = predictions.groupBy(*parts, intent).agg(
        F.count_if(_ok(predicted, intent)).alias("correct"), F.count("*").alias("total")
    )
    overall = per_intent.groupBy(*parts).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    both = per_intent.unionByName(overall.withColumn(intent, F.lit(None)), allowMissingColumns=True)
    return both.withColumn("accuracy", 100 * F.col("correct") / F.col("total"))


def wrong_predictions(predictions: DataFrame, intent: str = "intent", predicted: str = "ref_intent") -> DataFrame:
    return predictions.filter(~_ok(predicted, intent))


def accuracy(predictions: DataFrame, parts: list[str], intent: str = "intent", predicted: str = "ref_intent") -> DataFrame:
    ok = _ok(predicted, intent).cast("double")
    return predictions.groupBy(*parts).agg(F.avg(ok).alias("accuracy"), F.count("*").alias("total"))


def task_summary(task_accuracy: DataFrame, targets: DataFrame) -> DataFrame:
    """Per-task delta to its target, macro values and completeness.

    ``task_accuracy``: task, accuracy, total. ``targets``: task, target, expected_total.
    """
    joined = targets.join(task_accuracy, "task", "left")
    return joined.agg(
        F.avg("accuracy").alias("macro_accuracy"),
        F.avg(F.when(F.col("accuracy").isNotNull(), F.col("target"))).alias("macro_target"),
        F.bool_and(F.col("accuracy").isNotNull()).alias("all_tasks"),
        # Tasks without a result are told by all_tasks; the counts are those of the tasks present.
        F.coalesce(F.bool_and(F.col("total") == F.col("expected_total")), F.lit(False)).alias("counts_match"),
    )


def task_deltas(task_accuracy: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.join(task_accuracy, "task").withColumn("delta", F.col("accuracy") - F.col("target"))


def select_coefficient(scores: DataFrame, parts: list[str], coefficient: str = "ratio", score: str = "accuracy") -> DataFrame:
    """Best validation score, ties to the smaller coefficient."""
    return scores.groupBy(*parts).agg(
        F.max_by(F.col(coefficient), F.struct(F.col(score), -F.col(coefficient))).alias(coefficient)
    )
