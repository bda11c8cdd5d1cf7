"""Whitening of integer vectors by refined eigenvectors of their covariance.

Entries become integers, so sums and the products of centred vectors are exact whatever the order of summation: tasks add up
matrices of whole numbers, and the covariance is rounded once. Its eigenvectors are taken in float32 and corrected
in float64, then in extended precision, by the matrix products of Ogita and Aishima's iteration, which squares the error of
well separated eigenvectors. Those whose eigenvalues lie too close for it form clusters: inside the span of a cluster
the shifted matrix is small and exactly scaled, and a sub-solve finds the directions before the next correction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.session import stage

SCALE = 256
COMPONENTS = 4
STEPS = 60
EXACT = 1 << 53
BATCH_VECTORS = 4096
WIDE = "decimal(38,0)"


def whole_vectors(embeddings: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows whose vector is whole and finite, with ``x``: floor(scale * entry) as longs."""
    entry = F.col(column)
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    kept = embeddings.where(entry.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return kept.withColumn("x", F.transform(entry, lambda c: F.floor(c.cast("double") * scale).cast("long") + 0))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors as int64 rows; shorter ones are filled up with zeros."""
    x = batch.column("x")
    lengths = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _outer(y: np.ndarray) -> np.ndarray:
    """The sum of the rows' outer products, exact: by floats while they hold it, by whole numbers of any size beyond."""
    most = int(np.abs(y.astype(object)).max(initial=0)) if y.dtype == object else int(np.abs(y).max(initial=0))
    if most and most * most * len(y) >= EXACT:
        wide = y.astype(object)
        return wide.T @ wide
    near = y.astype(np.float64)
    return np.rint(near.T @ near).astype(np.int64).astype(object)


def _decimals(rows: np.ndarray) -> pa.Array:
    flat = pa.array([Decimal(int(v)) for v in np.ravel(rows)], pa.decimal128(38, 0))
    return pa.ListArray.from_arrays(pa.array(range(0, rows.size + 1, rows.shape[1]), pa.int32()), flat)


def _summed(centre: list[int]):
    """Per task and row of the matrix: sums of the centred vectors' products, the last row being the sums themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, middle = len(centre), np.array(centre, dtype=object)
        small = all(abs(c) < EXACT for c in centre)
        products, sums = np.zeros((width, width), dtype=object), np.zeros((1, width), dtype=object)
        some = False
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_VECTORS):
                x = _matrix(batch.slice(at, BATCH_VECTORS), width)
                fits = small and int(np.abs(x.astype(np.float64)).max(initial=0)) < EXACT
                y = x - middle.astype(np.int64) if fits else x.astype(object) - middle
                products += _outer(y)
                sums += y.sum(axis=0).astype(object)
                some = True
        if some:
            rows = np.concatenate([products, sums])
            yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), _decimals(rows)], names=["i", "part"])

    return run


def _total(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The tasks' matrices added up; a matrix of the dimensions comes to the driver."""
    entries = parts.select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").cast(WIDE).alias("v"))
    out = np.zeros((rows, width), dtype=object)
    for r in entries.collect():
        out[r["i"], r["j"]] = int(r["v"])
    return out


@dataclass(frozen=True)
class Fit:
    """The fit list's size, sums and covariance, and its leading eigenpairs."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a column each
    trace: float


def refined(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of a symmetric float64 matrix, to double precision."""
    if not len(a):
        return np.empty(0), np.empty((0, 0))
    scale = float(np.abs(a).max())
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    for kind in (np.float64, np.longdouble):
        x, wide, least, idle = x.astype(kind), a.astype(kind), np.inf, 0
        for _ in range(steps):
            x, off = _corrected(wide, x)
            idle = 0 if off < least / 2 else idle + 1
            least = min(least, off)
            if idle == 2:
                break
        x = _orthonormal(x)
    values = np.einsum("ij,ij->j", x, wide @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = (x / np.sqrt((x * x).sum(axis=0)))[:, order]
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return (values[order] * scale).astype(np.float64), (x * sign).astype(np.float64)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """The nearest orthonormal columns of nearly orthonormal ones; the error squares each time."""
    one = np.eye(x.shape[1], dtype=x.dtype)
    for _ in range(4):
        r = one - x.T @ x
        x = x + x @ r / 2
        if float(np.abs(r).max()) < 1e-9:
            break
    return x


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One correction of all columns of ``x``, and how far they were from eigenvectors before."""
    r, s = np.eye(len(a), dtype=x.dtype) - x.T @ x, x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    size = lambda m: float(np.linalg.norm(m.astype(np.float64)))
    off = size(s - np.diag(np.diag(s))) + size(a) * size(r)
    # Values closer than this say nothing about the directions: chains of them are clusters.
    order = np.argsort(-values, kind="stable")
    cluster = np.empty(len(a), dtype=np.int64)
    cluster[order] = np.cumsum(np.append(0, np.abs(np.diff(values[order])) > 2 * off))
    apart = cluster[:, None] != cluster[None, :]
    gap = values[None, :] - values[:, None]
    x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    for some in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        if len(some) > 1:
            x[:, some] = _sub_solved(a, x[:, some])
    return x, off


def _sub_solved(a: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The eigenvectors of the matrix inside the span of a cluster."""
    block = _orthonormal(block)
    middle = np.einsum("ij,ij->", block, a @ block) / block.shape[1]
    t = block.T @ (a @ block - middle * block)  # small after the shift, so its digits are all of use
    size = float(np.abs(t).max())
    if size == 0:
        return block
    turn = np.linalg.eigh(((t + t.T) / (2 * size)).astype(np.float64))[1][:, ::-1].astype(block.dtype)
    return block @ _orthonormal(turn)


def covariance(n: int, products: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The covariance of n vectors from exact sums of their centred products and of themselves, rounded once."""
    d = len(sums)
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = float(Fraction(n * int(products[i, j]) - int(sums[i]) * int(sums[j]), n * n))
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The leading components of a table of distinct ``x``; None without rows or entries. Only d x d numbers come to the driver."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, width = size["n"], max(0, size["d"] or 0)
    if not n or not width:
        return None
    # First the mean, rounded to whole numbers, then products of what is left.
    entries = vectors.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast(WIDE)).cast(WIDE).alias("v"))
    totals = {r["j"]: int(r["v"]) for r in entries.collect()}
    sums = [totals.get(j, 0) for j in range(width)]
    centre = [s // n for s in sums]
    parts = vectors.select("x").mapInArrow(_summed(centre), f"i int, part array<{WIDE}>")
    both = _total(parts, width + 1, width)
    v = covariance(n, both[:width], both[width])
    values, vectors_ = refined(v)
    return Fit(n, sums, values[:components], vectors_[:, :components], float(np.trace(v)))


def _projector(known: Fit):
    """Of a batch of vectors: exact deviations as whole numbers, and the whitened components."""
    n, sums = known.n, np.array(known.sums, dtype=object)
    mean = np.array([float(Fraction(s, n)) for s in known.sums])
    centre = np.array([s // n for s in known.sums], dtype=object)
    off = mean - centre.astype(np.float64) if all(abs(c) < EXACT for c in centre) else np.array([float(Fraction(s % n, n)) for s in known.sums])
    good = known.values > known.trace * 1e-14
    turn = np.where(good, known.vectors / np.sqrt(np.where(good, known.values, 1.0)), 0.0)

    def work(x: np.ndarray) -> tuple[list[int], np.ndarray]:
        most = max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, 1)
        far = n * most + max((abs(s) for s in known.sums), default=0)
        if far * far * max(1, len(known.sums)) < 1 << 62:
            deviation = ((x * n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        else:
            deviation = ((x.astype(object) * n - sums) ** 2).sum(axis=1).tolist()
        y = (x.astype(object) - centre).astype(np.float64) if most >= EXACT else (x - centre.astype(np.int64)).astype(np.float64)
        return deviation, (y - off) @ turn

    return work


def _whitened(known: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, width = _projector(known), len(known.sums)
        for batch in batches:
            deviation, values = work(_matrix(batch, width))
            k = values.shape[1]
            flat = pa.array(values.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * k + 1, k) if k else np.zeros(len(values) + 1), pa.int32()), flat)
            arrays = [*[batch.column(c) for c in batch.schema.names if c != "x"], pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=[*[c for c in batch.schema.names if c != "x"], "deviation", "whitened"])

    return run


def _moments(known: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, width, k = _projector(known), len(known.sums), known.vectors.shape[1]
        total, some = np.zeros((k, k)), False
        for batch in batches:
            w = work(_matrix(batch, width))[1]  # their mean is zero: the vectors were centred by the fit list's own mean
            total += w.T @ w
            some = some or batch.num_rows > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "part"])

    return run


def identity_error(vectors: DataFrame, known: Fit) -> float:
    """The largest entry of (covariance of the whitened fit list minus the identity), measured over all its rows."""
    k = known.vectors.shape[1]
    parts = vectors.select("x").mapInArrow(_moments(known), "i int, part array<double>")
    sums = parts.select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = -np.eye(k)
    for r in sums:
        out[r["i"], r["j"]] += r["v"] / known.n
    return float(np.abs(out).max(initial=0.0))


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per kept row and leading component.

    Rows whose vector is null or holds a null or a non-finite entry are left out. Each distinct vector of whole numbers counts once
    in the fit; equal vectors get equal rows, also under one vec_id or none. A vector shorter than the longest goes on with
    zeros. Components without variance have whitened values of 0 (so the identity error is 1) and, where nothing varies
    at all, explained 0. ``deviation`` is exact, a decimal. Other columns are ignored; an empty table, or one of empty vectors,
    gives no rows.
    """
    rows = stage(whole_vectors(embeddings.select("vec_id", column), column, scale).select("vec_id", "x"), "vectors")
    vectors = stage(rows.select("x").distinct(), "fit")
    known = fit(vectors, components)
    if known is None:
        known = Fit(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    error = identity_error(vectors, known) if len(known.sums) else 0.0
    explained = F.array(*[F.lit(float(v / known.trace) if known.trace else 0.0) for v in known.values]) if len(known.values) else F.array().cast("array<double>")
    kind = rows.schema["vec_id"].dataType.simpleString()
    done = rows.mapInArrow(_whitened(known), f"vec_id {kind}, deviation {WIDE}, whitened array<double>") if known.n else rows.select(
        "vec_id", F.lit(None).cast(WIDE).alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(known.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained") if len(known.values) else F.lit(0.0).alias("explained"),
        F.lit(error).alias("identity_error"))
