"""Released corpora: numbering, comparison and round-trip verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import text as X
from slotweave.operators import digest as D
from slotweave.operators.generate import number_source_rows
from slotweave.sources import writers as W


def released_rows(generated: DataFrame) -> DataFrame:
    """Generated pairs in the released schema."""
    numbered = number_source_rows(generated)
    return numbered.select(
        "utterance", "pattern", X.slot_count(F.col("pattern")).alias("slot_count"), "source", "source_row"
    )


def content_differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Positions where two ordered tables differ or only one has a row."""
    left = a.select(*keys, F.struct(*columns).alias("_left"))
    right = b.select(*keys, F.struct(*columns).alias("_right"))
    return left.join(right, keys, "full_outer").filter(~F.col("_left").eqNullSafe(F.col("_right")))


def running_row_problems(rows: DataFrame) -> DataFrame:
    """Sources whose source_row is not exactly 0..n-1."""
    stats = rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("source_row").alias("distinct_rows"),
        F.min("source_row").alias("low"), F.max("source_row").alias("high"),
    )
    return stats.filter((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("distinct_rows") != F.col("n")))


def misnumbered(leaves: DataFrame) -> DataFrame:
    """Sources whose source_row is not exactly 0..n-1, from their leaves."""
    stats = leaves.groupBy("source").agg(
        F.sum("_n").alias("n"), F.sum("_distinct").alias("distinct_rows"), F.min("_low").alias("low"), F.max("_high").alias("high"))
    return stats.filter((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("distinct_rows") != F.col("n")))


def changed_rows(rows: DataFrame, back: DataFrame, columns: list[str], expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(source, source_row) of rows that differ, read only where the leaves of two trees do."""
    ranges = D.differing_ranges(expected, actual, ["source"])
    some = [D.in_ranges(df, ranges, "source_row", ["source"]) for df in (rows, back)]
    return content_differences(*some, ["source", "source_row"], columns).select("source", "source_row")


def verify_round_trip(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Re-read a release and compare: schema, row numbers, and every row by the digest per source."""
    back = W.read_released(spark, path)
    schema_ok = [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in rows.select(*W.RELEASED_COLUMNS).schema]
    columns = ["utterance", "pattern", "slot_count"]
    expected, actual = (D.leaf_digests(df, columns, "source_row", ["source"]) for df in (rows, back))
    # Equal leaves over dense numbers are equal rows; what differs is not read here (``changed_rows``).
    apart = D.differing_ranges(expected, actual, ["source"]).groupBy("source").agg(F.count("*").alias("bad"))
    have = D.root_digest(actual, ["source"]).select("source", F.col("digest").alias("actual"), F.col("rows").alias("actual_rows"))
    joined = expected.select("source").distinct().join(have, "source", "full_outer").join(apart, "source", "left").join(
        misnumbered(actual).select("source", F.lit(True).alias("misnumbered")), "source", "left")
    ok = F.lit(schema_ok) & F.col("actual").isNotNull() & F.col("bad").isNull() & F.col("misnumbered").isNull()
    return joined.select("source", F.col("actual_rows").alias("rows"), F.col("actual").alias("digest"), ok.alias("verified"))


def package(rows: DataFrame, checks: DataFrame, path: str) -> bool:
    """Write the release only when every check passed; returns whether it was written."""
    from slotweave.operators.gate import eligible

    if not eligible(checks).first()["eligible"]:
        return False
    W.write_per_source_parquet(rows, path)
    return True
