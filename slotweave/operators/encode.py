"""Token ids and text encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import text as X
from slotweave.session import BROADCAST_BYTES, stage

MAP_WORDS = 200_000  # words of a vocabulary that goes to every task
BLOCK_ROWS = 4096  # rows that share a dictionary where the vocabulary is large

# Ids of the special tokens.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_WORD = 4


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{X.ws_class()}+"), lambda w: w != "")


def token_vocabulary(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """The ``size`` most frequent whitespace tokens with their ids; ``size`` bounds the table."""
    counts = df.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "token"))
    return top.select("token", (rank - 1 + FIRST_WORD).alias("token_id"))


def _looked_up(ids: dict[str, int], tokens: pa.Array) -> pa.Array:
    """Lists of tokens as lists of ids."""
    flat = [ids.get(w, UNK) for w in tokens.flatten().to_pylist()]
    sizes = np.diff(tokens.offsets.to_numpy())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def _by_map(ids: dict[str, int], kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _looked_up(ids, batch.column("_tokens"))], names=[*kept, "_ids"])

    return run


def _by_block(kept: list[str]):
    """Rows of (_block, _kind) in order: a block's dictionary, then its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, ids = None, {}
        for batch in batches:
            block, kind = (batch.column(c).to_numpy() for c in ("_block", "_kind"))
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if block[a] != home:
                    home, ids = block[a], {}
                some = batch.slice(a, b - a)
                if kind[a] == 0:
                    ids.update(zip(some.column("_token").to_pylist(), some.column("_id").to_pylist()))
                else:
                    yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], _looked_up(ids, some.column("_tokens"))], names=[*kept, "_ids"])

    return run


def token_ids(df: DataFrame, vocabulary: DataFrame, tokens: str, out: str, small: int = MAP_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with ``out``, the ids of their array of ``tokens``; unknown ones get the unknown id. ``tokens`` goes.

    A vocabulary measured small goes to every task as one map. A larger one is joined with the distinct tokens of each block of
    rows, and the block's rows look their tokens up in what it found. Rows are never taken apart, so they need no key.
    """
    vocabulary = stage(vocabulary.select("token", "token_id"), "vocabulary")
    kept = [c for c in df.columns if c != tokens]
    rows = df.select(*kept, F.coalesce(F.filter(tokens, lambda w: w.isNotNull()), F.array().cast("array<string>")).alias("_tokens"))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("_ids", T.ArrayType(T.IntegerType()))])
    size = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= small and size["bytes"] <= BROADCAST_BYTES:
        ids = {r["token"]: r["token_id"] for r in vocabulary.collect()}  # as measured
        looked = rows.mapInArrow(_by_map(ids, kept), schema)
    else:
        rows = stage(rows.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), block_rows.bit_length() - 1)), "rows")
        asked = rows.select("_block", F.explode("_tokens").alias("token")).distinct()
        found = asked.join(vocabulary, "token").select("_block", F.lit(0).alias("_kind"), F.col("token").alias("_token"), F.col("token_id").cast("int").alias("_id"))
        both = found.unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
        both = both.repartition("_block").sortWithinPartitions("_block", "_kind")
        looked = both.mapInArrow(_by_block(kept), schema)
    return looked.withColumnRenamed("_ids", out)


def pad_truncate(df: DataFrame, vocabulary: DataFrame, max_len: int, key: str, text: str = "text", **limits) -> DataFrame:
    """input_ids, attention_mask and token_type_ids of exactly ``max_len`` entries.

    Only the tokens that survive the cut are looked up. ``key`` is handed through; it may be null or repeated.
    """
    if max_len < 2:
        raise ValueError("max_len must leave room for two special tokens")
    kept = F.slice(words(F.col(text)), 1, max_len - 2) if max_len > 2 else F.array().cast("array<string>")
    looked = token_ids(df.select(key, kept.alias("_words")), vocabulary, "_words", "ids", **limits)
    ids = F.concat(F.array(F.lit(CLS)), F.col("ids"), F.array(F.lit(SEP)))
    n = F.size("ids") + 2
    return looked.select(
        key,
        F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(max_len) - n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n)).alias("attention_mask"),
        F.array_repeat(F.lit(0), max_len).alias("token_type_ids"),
    )


def pad_to_batch(df: DataFrame, batch: str = "batch", ids: str = "input_ids") -> DataFrame:
    """Pad unpadded id arrays to the longest row of their batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_len"))
    joined = df.join(longest, batch)
    gap = F.col("_len") - F.size(ids)
    return joined.select(
        *[c for c in df.columns if c != ids],
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
        F.concat(F.col(ids), F.array_repeat(F.lit(PAD), gap)).alias(ids),
    )


def encode_hashed(df: DataFrame, text: str = "text", dims: int = 256, out: str = "vec", unit: bool = True) -> DataFrame:
    """Built-in deterministic encoder: counts of hashed tokens, optionally of unit length.

    A token's bucket is the number its MD5 starts with, so any SQL engine can repeat it.
    """
    bucket = lambda w: (F.conv(F.substr(F.md5(w), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % dims).cast("string")
    buckets = F.transform(words(X.casefold(F.coalesce(F.col(text), F.lit("")))), bucket)
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dims)], inputCol="_words", outputCol="_tf")
    counted = counter.transform(df.withColumn("_words", buckets))
    source = "_tf"
    if unit:
        counted = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
        source = "_unit"
    return counted.withColumn(out, vector_to_array(source)).drop("_words", "_tf", "_unit")


def encode(df: DataFrame, encoder: Callable[[], Callable[[list[str]], list]], text: str = "text", out: str = "vec",
           batch_size: int = 64) -> DataFrame:
    """A user's encoder in Arrow batches. ``encoder`` is called once per task and returns the function."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = encoder()
        for batch in batches:
            vectors = []
            for start in range(0, len(batch), batch_size):
                vectors.extend(list(v) for v in call(batch.iloc[start:start + batch_size].tolist()))
            yield pd.Series(vectors)

    return df.withColumn(out, run(F.col(text)))
