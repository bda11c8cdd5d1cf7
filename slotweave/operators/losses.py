"""Contrastive losses over stored vectors, as evaluation metrics.

A batch of n rows is cut into blocks; every tile returns, per anchor, the maximum and the scaled sum of
exponentials of its scores. Merging these is exact, so a batch may be larger than a task can hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.operators import tiles

BLOCK = 1024

# The four similarity matrices, as (name, anchor column, candidate column).
LOSSES = [
    ("utterance", "u1", "u2"),
    ("template", "t1", "t2"),
    ("pair_pattern", "u1", "t1"),
    ("pair_utterance", "t1", "u1"),
]

_OUT = "batch bigint, pos bigint, loss string, peak double, mass double, target double"


def _scores(anchor: np.ndarray, candidate: np.ndarray, temperature: float):
    return tiles.unit(anchor) @ tiles.unit(candidate).T / temperature


def _kernel(temperature: float):
    def kernel(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"batch": [], "pos": [], "loss": [], "peak": [], "mass": [], "target": []}
        if left.num_rows and right.num_rows:
            batch = key[0].as_py()
            a_pos, c_pos = left.column("pos").to_numpy(), right.column("pos").to_numpy()
            same = a_pos[:, None] == c_pos[None, :]
            for name, a, c in LOSSES:
                s = _scores(tiles.matrix(left, a), tiles.matrix(right, c), temperature)
                peak = s.max(axis=1)
                out["batch"] += [batch] * len(a_pos)
                out["pos"] += a_pos.tolist()
                out["loss"] += [name] * len(a_pos)
                out["peak"] += peak.tolist()
                out["mass"] += np.exp(s - peak[:, None]).sum(axis=1).tolist()
                hit = same.any(axis=1)
                out["target"] += [float(s[i, same[i].argmax()]) if hit[i] else None for i in range(len(a_pos))]
        return pa.table(
            {
                "batch": pa.array(out["batch"], pa.int64()), "pos": pa.array(out["pos"], pa.int64()),
                "loss": pa.array(out["loss"], pa.string()), "peak": pa.array(out["peak"], pa.float64()),
                "mass": pa.array(out["mass"], pa.float64()), "target": pa.array(out["target"], pa.float64()),
            }
        )

    return kernel


def contrastive_losses(rows: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(batch, loss, value) for rows (batch, pos, u1, u2, t1, t2); ``pos`` is dense from 0 in a batch."""
    sizes = rows.groupBy("batch").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    sized = rows.join(sizes, "batch")
    own = F.floor(F.col("pos") / BLOCK).cast("int")
    left = sized.select(
        *tiles.renewed("batch"), own.alias("_i"), tiles.every_block(F.col("_blocks")).alias("_j"), *tiles.renewed("pos", "u1", "t1")
    )
    right = sized.select(
        *tiles.renewed("batch"), tiles.every_block(F.col("_blocks")).alias("_i"), own.alias("_j"),
        *tiles.renewed("pos", "u1", "u2", "t1", "t2"),
    )
    keys = ["batch", "_i", "_j"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_kernel(temperature), _OUT)
    peaks = F.max("peak")
    merged = parts.groupBy("batch", "loss", "pos").agg(
        peaks.alias("peak"), F.collect_list(F.struct("peak", "mass")).alias("tiles"), F.max("target").alias("target")
    )
    log_sum = F.col("peak") + F.log(
        F.aggregate("tiles", F.lit(0.0), lambda a, x: a + x["mass"] * F.exp(x["peak"] - F.col("peak")))
    )
    return merged.groupBy("batch", "loss").agg(F.avg(log_sum - F.col("target")).alias("value"))


def total_loss(losses: DataFrame, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0,
               negatives: str = "balanced") -> DataFrame:
    """Weighted sum per batch; pair negatives are patterns, utterances or the mean of both."""

    def of(name: str) -> Column:
        return F.max(F.when(F.col("loss") == name, F.col("value")))

    pair = {
        "pattern": of("pair_pattern"),
        "utterance": of("pair_utterance"),
        "balanced": 0.5 * of("pair_utterance") + 0.5 * of("pair_pattern"),
    }[negatives]
    return losses.groupBy("batch").agg(
        of("utterance").alias("utterance_loss"), of("template").alias("template_loss"), pair.alias("pair_loss"),
        (alpha * of("utterance") + beta * of("template") + gamma * pair).alias("loss"),
    )
