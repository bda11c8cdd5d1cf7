"""What the operators of this folder share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.session import small_batches  # noqa: F401  (shared with the operators of this folder)

# The learning fold: rows whose crc32 of the id (as text) leaves 0 are held out.
FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_udf(schema: str, make: Callable[[], Callable[[str], tuple]]) -> Callable[..., Column]:
    """A column function over whole texts that gives a struct; null texts count as empty.

    ``make`` builds the per-text function once per task, so models and memos live as long as the task.
    Only the text column travels to Python; the other columns of a row stay with Spark.
    """
    names = [part.split()[0] for part in schema.split(",")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for texts in batches:
            rows = [work(text if isinstance(text, str) else "") for text in texts]
            yield pd.DataFrame(rows, columns=names) if rows else pd.DataFrame(columns=names)

    return run


def held_out(column: str = "doc_id") -> Column:
    """Whether a row is kept out of all learning."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def held_out_py(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def labelled_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, y) of at most ``rows`` labelled documents one may learn from, spread over the ids by their hash.

    The choice is the same on every run. Ids labelled twice count once, with the larger label.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    return known.orderBy(F.xxhash64(F.lit("learning"), "doc_id"), "doc_id").limit(rows)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled documents; their ids, so few, go to the documents."""
    return docs.select("doc_id", "text").join(F.broadcast(labelled_ids(labels, label, rows)), "doc_id")
