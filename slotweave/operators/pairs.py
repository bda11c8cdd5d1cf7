"""Alignment and uniformity over all unordered pairs of vectors.

The mean squared distance of pairs needs no pairs: over a set of n vectors the distances sum to
``n * sum|x|^2 - |sum x|^2``. Alignment is that identity per intent. Only the Gaussian potential is a
true function of each pair; it goes through the tile kernel, which returns one row of sums per tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions import vectors as V
from slotweave.operators import tiles
from slotweave.session import broadcast_if_small, stage
from slotweave.sources.ordinals import number_sorted

PAIR_BLOCK = 4096
SET_BLOCK = 2048


def sets_per_key(metadata: DataFrame, key: str = "utterance", columns: tuple[str, ...] = ("domain", "intent")) -> DataFrame:
    return metadata.groupBy(key).agg(*[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in columns])


def same_intent(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def _sum_vector(vec: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(V.as_double(vec))))


def _moments(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), _sum_vector(F.col(vec)).alias("s"), F.sum(V.sum_squares(F.col(vec))).alias("q")
    )


def _with_pair_sums(moments: DataFrame) -> DataFrame:
    return moments.withColumns(
        {
            "pairs": (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"),
            "distance_sum": F.col("n") * F.col("q") - V.sum_squares(F.col("s")),
        }
    )


def pair_distances(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Pairs and summed squared distances inside each group of ``keys``."""
    return _with_pair_sums(_moments(df, keys, vec)).select(*keys, "pairs", "distance_sum")


def _overlap_of_tile(diagonal: bool, intent: int, a: dict[str, np.ndarray | list], b: dict[str, np.ndarray | list]) -> tuple[int, float]:
    """Pairs of rows of sets of two blocks, and their summed squared distances, for sets that share no smaller intent.

    ``a`` and ``b`` hold numbers of rows n, sums s, sums of squares q and the sorted intents of sets that all have ``intent``.
    """
    lower: dict[int, int] = {}
    for sets in (a["sets"], b["sets"]):
        for s in sets:
            for i in s:
                if i < intent:
                    lower.setdefault(i, len(lower))

    def masks(sets) -> np.ndarray:
        out = np.zeros((len(sets), max(1, len(lower))), dtype=np.float32)
        for row, s in enumerate(sets):
            for i in s:
                if i < intent:
                    out[row, lower[i]] = 1
        return out

    mb, pairs, total = masks(b["sets"]), 0, 0.0
    for at in range(0, len(a["n"]), tiles.SLICE):
        stop = at + tiles.SLICE
        counts = (masks(a["sets"][at:stop]) @ mb.T) == 0
        if diagonal:  # each pair of sets once
            counts &= np.arange(len(b["n"]))[None, :] > (np.arange(len(counts)) + at)[:, None]
        w = counts.astype(np.float64)
        n, q, s = a["n"][at:stop], a["q"][at:stop], a["s"][at:stop]
        pairs += int(n @ (counts.astype(np.int64) @ b["n"]))
        total += float(q @ (w @ b["n"]) + n @ (w @ b["q"]) - 2.0 * np.einsum("ij,ij->", s, w @ b["s"]))
    return pairs, total


def overlap_sums(per_set: DataFrame, block: int = SET_BLOCK) -> DataFrame:
    """(pairs, distance_sum) a tile, over all pairs of different sets of ``per_set(set, n, s, q)`` that share an intent.

    ``set`` is a sorted array of numbers. Sets meet under each intent they have, in blocks of bounded size; the smallest intent
    two sets share speaks for them, which a block knows from bit masks of the smaller ones. A tile gives one row of sums,
    whatever the number of pairs.
    """
    held = per_set.withColumn("_intent", F.explode("set"))
    sizes = stage(held.groupBy("_intent").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")), "intents")
    held = held.join(broadcast_if_small(sizes), "_intent").withColumn("_own", tiles.block_of(F.col("set"), F.col("_blocks")))
    fields = ["set", "n", "s", "q"]
    left = held.select(*tiles.renewed("_intent"), F.col("_own").alias("_b1"), F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1)).alias("_b2"), *tiles.renewed(*fields))
    right = held.select(*tiles.renewed("_intent"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_b1"), F.col("_own").alias("_b2"), *tiles.renewed(*fields))

    def side(rows: pa.Table) -> dict:
        return {"sets": rows.column("set").to_pylist(), "n": rows.column("n").to_numpy(), "q": rows.column("q").to_numpy(), "s": tiles.matrix(rows, "s")}

    def kernel(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        intent, one, two = (k.as_py() for k in key)
        pairs, total = 0, 0.0
        if a.num_rows and b.num_rows:
            first = side(a)
            pairs, total = _overlap_of_tile(one == two, intent, first, first if one == two else side(b))
        return pa.table({"pairs": pa.array([pairs], pa.int64()), "distance_sum": pa.array([total], pa.float64())})

    keys = ["_intent", "_b1", "_b2"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, "pairs bigint, distance_sum double")


def alignment(df: DataFrame, intents: str = "intents", vec: str = "vec", block: int = SET_BLOCK) -> DataFrame:
    """Mean squared distance of the pairs whose intent sets overlap.

    Rows are first summed per intent set. Within a set all pairs count; two different sets count together when
    they share an intent. For sets of n and m rows the distances between them sum to ``m q + n r - 2 s t`` (squares q, r
    and sums s, t), which ``overlap_sums`` adds up by tiles. Rows without an intent pair with none.
    """
    sets = df.select(F.array_sort(F.array_distinct(F.filter(intents, lambda i: i.isNotNull()))).alias("_set"), F.col(vec).alias("vec"))
    per_set = stage(_moments(sets.filter(F.size("_set") > 0), ["_set"], "vec"), "moments")
    own = _with_pair_sums(per_set).select("pairs", "distance_sum")
    # Intents by number: masks compare numbers, whatever the names look like.
    numbers = stage(number_sorted(per_set.select(F.explode("_set").alias("_name")).distinct(), ["_name"], out="_number"), "numbers")
    named = per_set.withColumn("_id", F.monotonically_increasing_id())
    named = stage(named, "named")
    numbered = named.select("_id", F.explode("_set").alias("_name")).join(broadcast_if_small(numbers), "_name").groupBy("_id").agg(F.array_sort(F.collect_list("_number")).alias("set"))
    across = overlap_sums(named.join(numbered, "_id").select("set", "n", "s", "q"), block)
    return own.unionByName(across).agg(
        F.sum("pairs").alias("same_intent_pairs"), (F.sum("distance_sum") / F.sum("pairs")).alias("alignment"))


def mean_log_potential(df: DataFrame, vec: str = "vec", t: float = 2.0) -> DataFrame:
    """Mean over pairs of the log potential, -t|x-y|^2: the same identity over all rows."""
    return pair_distances(df, [], vec).select(
        F.col("pairs"), (-t * F.col("distance_sum") / F.col("pairs")).alias("mean_log_potential")
    )


def _potential_of_tile(a: np.ndarray, b: np.ndarray, diagonal: bool, t: float) -> tuple[int, float]:
    pairs, total = 0, 0.0
    bb = (b * b).sum(axis=1)
    for start in range(0, len(a), tiles.SLICE):
        x = a[start:start + tiles.SLICE]
        d2 = np.maximum((x * x).sum(axis=1)[:, None] + bb[None, :] - 2.0 * (x @ b.T), 0.0)
        value = np.exp(-t * d2)
        if diagonal:
            later = np.arange(len(b))[None, :] > (np.arange(len(x)) + start)[:, None]
            total += float(value[later].sum())
            pairs += int(later.sum())
        else:
            total += float(value.sum())
            pairs += value.size
    return pairs, total


def potential_sums(df: DataFrame, id_col: str = "vec_id", vec: str = "vec", t: float = 2.0,
                   rows: int | None = None) -> DataFrame:
    """Pairs and the sum of exp(-t|x-y|^2) per tile; every unordered pair is in exactly one tile."""
    n = df.count() if rows is None else rows
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = tiles.block_count(n, PAIR_BLOCK, at_least=min(tiles.block_count(n, tiles.SLICE), max(1, int((2 * cores) ** 0.5))))
    block = tiles.block_of(F.col(id_col), blocks)
    left = df.select(block.alias("_b1"), F.col(vec).alias("v")).withColumn(
        "_b2", F.explode(F.sequence(F.col("_b1"), F.lit(blocks - 1)))
    )
    right = df.select(block.alias("_b2"), F.col(vec).alias("v")).withColumn(
        "_b1", F.explode(F.sequence(F.lit(0), F.col("_b2")))
    )

    def kernel(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        diagonal = key[0].as_py() == key[1].as_py()
        pairs, total = 0, 0.0
        if a.num_rows and b.num_rows:
            x = tiles.matrix(a, "v")
            pairs, total = _potential_of_tile(x, x if diagonal else tiles.matrix(b, "v"), diagonal, t)
        return pa.table({"pairs": pa.array([pairs], pa.int64()), "potential": pa.array([total], pa.float64())})

    keys = ["_b1", "_b2"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, "pairs bigint, potential double")


def uniformity(df: DataFrame, id_col: str = "vec_id", vec: str = "vec", t: float = 2.0, rows: int | None = None) -> DataFrame:
    """log of the mean Gaussian potential over all unordered pairs."""
    return potential_sums(df, id_col, vec, t, rows).agg(
        F.sum("pairs").alias("pairs"), F.log(F.sum("potential") / F.sum("pairs")).alias("uniformity")
    )


FEATURES = 4096
SURENESS = 1e-6


def _feature_sums(waves: np.ndarray, vec: str):
    """Per task: the number of vectors and, by wave, the sums of its cosines and sines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2, waves.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, tiles.SLICE):
                x = tiles.matrix(pa.Table.from_batches([batch.slice(at, tiles.SLICE)]), vec)
                phase = x @ waves
                sums += np.stack([np.cos(phase).sum(axis=0), np.sin(phase).sum(axis=0)])
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([s.tolist()], pa.list_(pa.float64())) for s in sums]], names=["n", "c", "s"])

    return run


def uniformity_sketch(df: DataFrame, vec: str = "vec", t: float = 2.0, features: int = FEATURES, sureness: float = SURENESS, seed: int = 17) -> DataFrame:
    """(pairs, uniformity, potential, bound): the mean Gaussian potential of all pairs from one pass over the vectors.

    exp(-t |x - y|^2) is the mean of cos(w (x - y)) over normal waves w of variance 2 t, so its mean over all pairs of rows is
    the mean squared length of the average of (cos w x, sin w x). That is a number in [0, 1] for each of the ``features``
    independent waves; by Hoeffding's inequality their mean is off by more than ``bound`` with a probability of at most ``sureness``.
    The exact way is ``uniformity``.
    """
    width = df.agg(F.max(F.size(vec)).alias("d")).first()["d"]
    if width is None or width < 1:
        raise ValueError("need non-empty vectors")
    waves = np.random.default_rng(seed).normal(scale=np.sqrt(2 * t), size=(width, features))
    parts = df.select(F.col(vec).alias("v")).mapInArrow(_feature_sums(waves, "v"), "n bigint, c array<double>, s array<double>")
    total = parts.agg(F.sum("n").alias("n"), _sum_vector(F.col("c")).alias("c"), _sum_vector(F.col("s")).alias("s"))
    n = F.col("n").cast("double")
    # Rows with themselves have a potential of 1 and are no pairs.
    mean = (V.sum_squares(F.col("c")) + V.sum_squares(F.col("s"))) / features
    potential = (mean - n) / (n * (n - 1))
    bound = float(np.sqrt(np.log(2 / sureness) / (2 * features))) * n / (n - 1)
    return total.select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), potential.alias("potential"), bound.alias("bound")).select(
        "pairs", F.log("potential").alias("uniformity"), "potential", "bound")
