"""Explicit row order.

A DataFrame has none, so every reader attaches it. Dense numbers are built from bucket sizes: rows are
numbered inside buckets of bounded size, and only the table of bucket sizes is summed up in order.
No window ever sees all rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.session import broadcast_if_small, stage

BUCKET_ROWS = 65_536


def scan_order(df: DataFrame, per_file: bool = False, out: str = "ord") -> DataFrame:
    """Number the rows of a file scan, 0-based, by (file, split offset, position in split).

    ``df`` must be a bare file scan. A split is read by one task in order, so a row's place in its
    split is the distance to the smallest id of that split, however splits are packed into tasks.
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = tagged.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    w = (Window.partitionBy("_file").orderBy("_block") if per_file else Window.orderBy("_file", "_block"))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("_file", "_block", "_first", before.alias("_before"))
    cols = [c for c in df.columns]
    return tagged.join(offsets, ["_file", "_block"]).select(
        *cols,
        F.col("_file").alias("file"),
        (F.col("_before") + F.col("_mid") - F.col("_first")).cast("bigint").alias(out),
    )


def number_rows(df: DataFrame, order: list[str], buckets: list[Column], parts: list[str] | None = None,
                out: str = "idx") -> DataFrame:
    """Dense 0-based numbers in ``order`` within ``parts``.

    ``buckets`` are expressions that never decrease along ``order`` and hold a bounded number of rows
    each, e.g. ``ord div 65536``. A hot part is split over many buckets.
    """
    parts = parts or []
    names = [f"_b{i}" for i in range(len(buckets))]
    tagged = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    keys = parts + names
    sizes = tagged.groupBy(*keys).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*parts).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    left = tagged.withColumn("_pos", inside)
    on = [left[k].eqNullSafe(offsets[k]) for k in keys]
    return left.join(offsets, on).select(
        *[left[c] for c in df.columns], (F.col("_before") + F.col("_pos")).cast("bigint").alias(out)
    )


def number_sorted(df: DataFrame, order: list[str], parts: list[str] | None = None, out: str = "idx") -> DataFrame:
    """Dense 0-based numbers in ``order`` within ``parts``, whatever the values look like.

    Rows are sorted into ranges over parts and order and written with their place, which is their only exchange;
    the table of range sizes, a row per range and part, is summed up and joined.
    """
    parts = parts or []
    keys = [*parts, *[c for c in order if c not in parts]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small tables still use all cores
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    placed = stage(placed, "sorted").withColumn("_range", F.shiftright("_mid", 33))
    sizes = placed.groupBy(*parts, "_range").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_o{i}" for i, k in enumerate([*parts, "_range"])}
    offsets = sizes.select(
        *[F.col(k).alias(n) for k, n in names.items()], "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    number = (F.col("_mid") - F.col("_first") + F.col("_before")).cast("bigint")
    return placed.join(broadcast_if_small(offsets), on).select(*df.columns, number.alias(out))


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer tasks than the session has cores; larger scans stay as they are.

    A small file with one row group is read by one task. A large table already has many, and is
    never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_ord(column: str = "ord", rows: int = BUCKET_ROWS) -> list[Column]:
    """The usual bucket of a dense or nearly dense order column."""
    return [F.call_function("div", F.col(column), F.lit(rows))]
