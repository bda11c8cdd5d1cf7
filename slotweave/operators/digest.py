"""Content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.session import broadcast_if_small, stage
from slotweave.sources.documents import checksums

FANOUT = 4096
LEVELS = 3  # at least; a tree grows higher where a part has more than FANOUT ** LEVELS rows


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of one row; length-prefixed fields keep the encoding unambiguous."""
    fields = [
        F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns
    ]
    return F.sha2(F.concat_ws(",", *[F.coalesce(f, F.lit("-")) for f in fields]), 256)


def leaf_digests(df: DataFrame, columns: list[str], position: str, parts: list[str] | None = None, fanout: int = FANOUT) -> DataFrame:
    """The lowest level of the tree, written: a digest per ``fanout`` neighbouring positions (``_p``) of a part.

    Beside it how many rows and different positions lie there, the first and the last.
    """
    parts = parts or []
    rows = df.select(*parts, F.col(position).alias("_p"), row_digest(columns).alias("_h"))
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_h")))
    leaves = rows.groupBy(*parts, F.call_function("div", F.col("_p"), F.lit(fanout)).alias("_q")).agg(
        ordered.alias("_rows"), F.min("_p").alias("_low"), F.max("_p").alias("_high"))
    return stage(leaves.select(
        *parts, F.col("_q").alias("_p"), F.sha2(F.array_join(F.transform("_rows", lambda s: s["_h"]), ""), 256).alias("_h"),
        F.size("_rows").cast("bigint").alias("_n"), F.size(F.array_distinct(F.transform("_rows", lambda s: s["_p"]))).cast("bigint").alias("_distinct"),
        "_low", "_high"), "leaves")


def root_digest(leaves: DataFrame, parts: list[str] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(rows, digest) per part from its leaves, level by level."""
    parts = parts or []
    last = leaves.agg(F.max("_p").alias("last")).first()["last"] or 0
    while fanout ** (levels - 1) <= last:
        levels += 1
    level = leaves.select(*parts, "_p", "_h", "_n")
    for _ in range(levels - 1):
        ordered = F.array_sort(F.collect_list(F.struct("_p", "_h")))
        level = level.groupBy(*parts, F.call_function("div", F.col("_p"), F.lit(fanout)).alias("_q")).agg(
            F.sha2(F.array_join(F.transform(ordered, lambda s: s["_h"]), ""), 256).alias("_h"), F.sum("_n").alias("_n")
        ).withColumnRenamed("_q", "_p")
    return level.select(*parts, F.col("_n").alias("rows"), F.col("_h").alias("digest"))


def ordered_digest(df: DataFrame, columns: list[str], position: str, parts: list[str] | None = None,
                   fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Digest of rows in ``position`` order (dense, 0-based): sensitive to content, order and count.

    A tree: ``fanout`` neighbours are hashed together, level by level, so no group holds more than
    ``fanout`` digests. ``levels`` is the least height; the largest position decides whether more are needed.
    """
    return root_digest(leaf_digests(df, columns, position, parts, fanout), parts, fanout, levels)


def differing_ranges(a: DataFrame, b: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """(parts, _p): the leaves in which two trees differ, written. Only ranges are compared, no rows."""
    keys = [*(parts or []), "_p"]
    joined = a.select(*keys, F.col("_h").alias("_left")).join(b.select(*keys, F.col("_h").alias("_right")), keys, "full_outer")
    return stage(joined.where(~F.col("_left").eqNullSafe(F.col("_right"))).select(*keys), "ranges")


def in_ranges(df: DataFrame, ranges: DataFrame, position: str, parts: list[str] | None = None, fanout: int = FANOUT) -> DataFrame:
    """The rows of ``df`` that lie in some of the ``ranges``."""
    parts = parts or []
    place = F.call_function("div", F.col(position), F.lit(fanout))
    return df.withColumn("_p", place).join(broadcast_if_small(ranges), [*parts, "_p"], "left_semi").select(*df.columns)


def file_checksums(spark: SparkSession, path) -> DataFrame:
    """(path, length, sha256) per input file of any size."""
    return checksums(spark, path)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that appeared, vanished or changed between two checksum tables."""
    a = before.select("path", F.col("sha256").alias("sha_before"))
    b = after.select("path", F.col("sha256").alias("sha_after"))
    return a.join(b, "path", "full_outer").filter(~F.col("sha_before").eqNullSafe(F.col("sha_after")))
