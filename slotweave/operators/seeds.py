"""Repeated experiments: seeds x conditions x tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_scores(results: DataFrame) -> DataFrame:
    """(condition, seed, task, accuracy) of the available runs."""
    ok = results.filter("available")
    return ok.select("condition", "seed", F.explode("result.test_diagnostics").alias("task", "r")).select(
        "condition", "seed", "task", F.col("r.accuracy").alias("accuracy")
    )


def run_problems(results: DataFrame, tasks: list[str]) -> DataFrame:
    """(condition, seed, problem) for every rule an available run breaks."""
    names = F.map_keys("result.test_diagnostics")
    scores = F.transform(F.map_values("result.test_diagnostics"), lambda r: r["accuracy"])
    wanted = F.array_sort(F.array(*[F.lit(t) for t in tasks]))
    rules = F.array(
        F.when(~F.coalesce(F.col("result.benchmark_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid digest"),
        F.when(~(F.col("result.source_unchanged").eqNullSafe(True) & F.col("result.export_audit.source_unchanged").eqNullSafe(True)), "source not verified"),
        F.when(~F.col("result.export_audit.reload_max_abs_diff").eqNullSafe(0.0), "reload difference"),
        F.when(~F.array_sort(names).eqNullSafe(wanted), "unexpected tasks"),
        F.when(
            ~F.coalesce(F.forall(scores, lambda s: s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s <= 100)), F.lit(False)),
            "invalid accuracy",
        ),
    )
    return results.filter("available").select(
        "condition", "seed", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("problem")
    )


def digest_agreement(results: DataFrame) -> DataFrame:
    """All available runs name one benchmark digest."""
    return results.filter("available").agg(
        F.count_distinct("result.benchmark_sha256").alias("digests"),
        (F.count_distinct("result.benchmark_sha256") <= 1).alias("agree"),
    )


def missing_runs(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("available")).select("condition", "seed", "file")


def with_macro(scores: DataFrame, macro: str = "macro") -> DataFrame:
    """Add the mean over tasks as one more task."""
    mean = scores.groupBy("condition", "seed").agg(F.avg("accuracy").alias("accuracy"))
    return scores.unionByName(mean.withColumn("task", F.lit(macro)))


def paired_only(scores: DataFrame, conditions: tuple[str, str]) -> DataFrame:
    """Keep seeds both conditions have."""
    paired = (
        scores.filter(F.col("condition").isin(*conditions)).groupBy("seed")
        .agg(F.count_distinct("condition").alias("n")).filter(F.col("n") == 2)
    )
    return scores.join(paired, "seed", "left_semi")


def _summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_std")
    )


def seed_summary(scores: DataFrame, conditions: tuple[str, str]) -> DataFrame:
    """n, mean and sample deviation over paired seeds; the deviation is null for one seed."""
    return _summary(with_macro(paired_only(scores, conditions)), ["condition", "task"], "accuracy")


def paired_deltas(scores: DataFrame, conditions: tuple[str, str]) -> DataFrame:
    """Second condition minus first, per seed and task."""
    base, other = conditions
    pivot = with_macro(paired_only(scores, conditions)).groupBy("seed", "task").agg(
        F.max(F.when(F.col("condition") == base, F.col("accuracy"))).alias("base"),
        F.max(F.when(F.col("condition") == other, F.col("accuracy"))).alias("other"),
    )
    return pivot.select("seed", "task", (F.col("other") - F.col("base")).alias("delta"))


def delta_summary(deltas: DataFrame) -> DataFrame:
    return _summary(deltas, ["task"], "delta")
