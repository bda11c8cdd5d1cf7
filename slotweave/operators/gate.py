"""Release checks. Every check is a row; none stops the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions import text as X

CHECK_SCHEMA = "name string, passed boolean, actual string, expected string, lower_inclusive bigint, upper_exclusive bigint"


def rounded_interval(display: Column) -> tuple[Column, Column]:
    """[low, high) of the integers a displayed count may stand for; decimal, half-up."""
    thousands = F.endswith(display, F.lit("K"))
    digits = F.regexp_replace(display, "K$", "")
    number = digits.cast("decimal(38,12)")
    decimals = F.when(F.contains(digits, F.lit(".")), F.char_length(F.split_part(digits, F.lit("."), F.lit(2)))).otherwise(0)
    # Half a displayed unit in thousands: 500 for no decimals, 50 for one, 5 for two, 0.5 for three, ...
    half = F.concat(F.lit("500e-"), decimals.cast("string")).cast("double").cast("decimal(20,12)")
    centre = (number * 1000).cast("decimal(38,12)")
    exact = number.cast("bigint")
    low = F.when(thousands, F.ceil(centre - half)).otherwise(exact)
    high = F.when(thousands, F.ceil(centre + half)).otherwise(exact + 1)
    return low.cast("bigint"), high.cast("bigint")


def check_rows(df: DataFrame, name: Column, passed: Column, actual: Column | None = None, expected: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        name.alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"),
        (null if actual is None else actual).cast("string").alias("actual"),
        (null if expected is None else expected).cast("string").alias("expected"),
        null.cast("bigint").alias("lower_inclusive"), null.cast("bigint").alias("upper_exclusive"),
    )


def count_checks(actuals: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Actual counts against displayed targets; an absent actual fails."""
    low, high = rounded_interval(F.col("display"))
    joined = targets.join(actuals, keys, "left").withColumns({"lower_inclusive": low, "upper_exclusive": high})
    inside = (F.col("lower_inclusive") <= F.col("actual")) & (F.col("actual") < F.col("upper_exclusive"))
    return joined.select(
        F.concat_ws(".", *keys).alias("name"), F.coalesce(inside, F.lit(False)).alias("passed"),
        F.col("actual").cast("string").alias("actual"), F.col("display").alias("expected"),
        "lower_inclusive", "upper_exclusive",
    )


def expected_count_checks(actuals: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Exact count assertions; both sides' unmatched keys fail."""
    joined = targets.withColumnRenamed("cnt", "expected").join(actuals.withColumnRenamed("cnt", "actual"), keys, "full_outer")
    return check_rows(joined, F.concat_ws(".", *keys), F.col("actual") == F.col("expected"), F.col("actual"), F.col("expected"))


def membership_check(df: DataFrame, column: str, expected: list[str], name: str) -> DataFrame:
    """The distinct values are exactly the expected ones."""
    seen = df.select(column).distinct().agg(
        F.count_if(F.col(column).isin(*expected)).alias("known"),
        F.count_if(~F.coalesce(F.col(column).isin(*expected), F.lit(False))).alias("unknown"),
    )
    ok = (F.col("known") == len(set(expected))) & (F.col("unknown") == 0)
    return check_rows(seen, F.lit(name), ok, F.concat_ws("/", F.col("known").cast("string"), F.col("unknown").cast("string")),
                      F.lit(f"{len(set(expected))}/0"))


def order_check(order: Column, expected: list[str]) -> Column:
    """A declared source order is a permutation of the expected sources."""
    wanted = F.array(*[F.lit(s) for s in expected])
    return F.coalesce((F.size(order) == len(expected)) & (F.array_sort(order) == F.array_sort(wanted)), F.lit(False))


def settings_checks(manifest: DataFrame, ks: dict[str, int]) -> DataFrame:
    """Per source: prepared, expected depth, no cap. ``manifest``: source, status, top_k, cap, truncated."""
    table = F.create_map(*[F.lit(v) for kv in ks.items() for v in kv])
    expected = F.try_element_at(table, F.col("source"))
    checks = [
        check_rows(manifest, F.concat("source", F.lit(".prepared")), F.col("status") == "prepared", F.col("status")),
        check_rows(manifest, F.concat("source", F.lit(".top_k")), F.col("top_k") == expected, F.col("top_k"), expected),
        check_rows(manifest, F.concat("source", F.lit(".uncapped")), F.col("cap").isNull() & (F.col("truncated") == 0),
                   F.coalesce(F.col("cap").cast("string"), F.lit("none")), F.lit("none")),
    ]
    return union_checks(checks)


def pair_problem(utterance: Column, pattern: Column) -> Column:
    """Why a released pair is malformed; null when it is fine."""
    return F.when(X.is_blank(utterance), "empty utterance").when(X.is_blank(pattern), "empty pattern")


def violations_check(df: DataFrame, problem: Column, name: str) -> DataFrame:
    """One check over a whole table: no row has the problem."""
    bad = df.agg(F.count(problem).alias("bad"))
    return check_rows(bad, F.lit(name), F.col("bad") == 0, F.col("bad"), F.lit("0"))


def declared_inputs(loaded: DataFrame, declared: DataFrame) -> DataFrame:
    """One check per loaded file (path, sha256): it is declared, with the same checksum."""
    known = declared.select("path", F.col("sha256").alias("declared"))
    joined = loaded.join(known, "path", "left")
    return check_rows(joined, F.col("path"), F.col("sha256") == F.col("declared"), F.col("sha256"), F.coalesce("declared", F.lit("undeclared")))


def union_checks(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def failures(checks: DataFrame) -> DataFrame:
    return checks.filter(~F.col("passed"))


def eligible(checks: DataFrame) -> DataFrame:
    """At least one check, and all passed."""
    return checks.agg(
        F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"),
        (F.coalesce(F.bool_and("passed"), F.lit(False)) & (F.count("*") > 0)).alias("eligible"),
    )
