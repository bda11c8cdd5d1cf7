"""The evaluation job: stored vectors and labels in, retrieval metrics out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.operators import metrics as M
from slotweave.operators import search as R
from slotweave.session import stage

# Mixing coefficients of the validation sweep.
RATIOS = [0.0, 0.1, 0.2, 0.5]


def references(rows: DataFrame, *extra: str) -> DataFrame:
    """Training rows as (idx, intent, vec)."""
    return rows.filter(F.col("split") == "train").select(F.col("vec_id").alias("idx"), "intent", "vec", *extra)


def queries(rows: DataFrame, *extra: str) -> DataFrame:
    """Validation and test rows as (qid, split, intent, vec)."""
    return rows.filter(F.col("split") != "train").select(F.col("vec_id").alias("qid"), "split", "intent", "vec", *extra)


def with_templates(rows: DataFrame) -> DataFrame:
    """Attach the vector of each row's template."""
    templates = rows.select(F.col("vec_id").alias("tpl_id"), F.col("vec").alias("tpl_vec"))
    return rows.join(templates, "tpl_id")


def nearest_predictions(rows: DataFrame) -> DataFrame:
    return R.nearest(queries(rows), references(rows))


def compression_sweep(rows: DataFrame, ratios: list[float] | None = None, p: int = 0) -> DataFrame:
    """Accuracy per (ratio, split): utterance and template vectors mixed on both sides.

    Each ratio is a search of its own, whose references go to the queries; mixed vectors are never exchanged.
    """
    both = stage(with_templates(rows), "both")
    found = []
    for ratio in ratios or RATIOS:
        mixed = R.mixture_sweep(both, [ratio], p)
        found.append(R.nearest(queries(mixed, "ratio"), references(mixed)).select("ratio", "split", "intent", "ref_intent"))
    return M.accuracy(reduce(DataFrame.unionByName, found), ["ratio", "split"])


def chosen_coefficient(sweep: DataFrame) -> DataFrame:
    """The ratio validation prefers, with test accuracy there and at zero."""
    valid = sweep.filter(F.col("split") == "valid").withColumn("one", F.lit(1))
    chosen = M.select_coefficient(valid, ["one"]).select(F.col("ratio").alias("chosen")).scalar()
    test = sweep.filter(F.col("split") == "test").withColumn("chosen", chosen)
    return test.groupBy("chosen").agg(
        F.max(F.when(F.col("ratio") == F.col("chosen"), F.col("accuracy"))).alias("test_accuracy"),
        F.max(F.when(F.col("ratio") == 0.0, F.col("accuracy"))).alias("test_accuracy_at_zero"),
    )
