"""Blocked matrix work.

Rows of both sides are hashed into blocks of bounded size and each (left block, right block) tile is
one small group for a numpy kernel. A kernel returns k rows per left row, or one row of sums; the
products themselves never become rows. Tile sizes do not depend on how keys are distributed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEFT_BLOCK = 2048
RIGHT_BLOCK = 8192
# Rows of the left block scored at a time, which bounds the score matrix of a task.
SLICE = 256


def block_count(rows: int, size: int, at_least: int = 1) -> int:
    return max(1, at_least, math.ceil(rows / size))


def block_of(key: Column, blocks: Column | int) -> Column:
    n = F.lit(blocks) if isinstance(blocks, int) else blocks
    return F.pmod(F.xxhash64(key), n).cast("int")


def every_block(blocks: Column | int) -> Column:
    n = F.lit(blocks) if isinstance(blocks, int) else blocks
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def renewed(*names: str) -> list[Column]:
    """The columns under new identities, so both sides of a tile may come from one DataFrame."""
    return [F.col(n).alias(n) for n in names]


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A list column as a dense double matrix; ragged or non-finite input stops the job."""
    column = table.column(name).combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return np.zeros((0, 0))
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) != 1 or lengths[0] == 0:
        raise ValueError("vectors must be non-empty and of one length")
    if not np.isfinite(flat).all():
        raise ValueError("non-finite vectors")
    return flat.reshape(n, int(lengths[0]))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
