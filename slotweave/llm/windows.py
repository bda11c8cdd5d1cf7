"""Packing by non-negative least squares: how often to repeat which shallow combination of lengths.

A document's tokens are cut into whole windows and a tail. Combinations of at most ``depth`` tail lengths that fill a
window exactly are enumerated; non-negative least squares finds repeat counts whose lengths come closest to the
histogram of tails, and they are rounded so that no length is used more often than it occurs. The plan is a few
thousand numbers: a tail with rank r among those of its length looks up its window and offset by itself, so planned tails are
not shuffled at all. Ranks are places inside a task of a written table plus the sizes of the tasks before it. What rounding
leaves over is dealt over partitions of bounded size and packed greedily: best-fit decreasing, then the
emptiest windows are dissolved and cut to fill the gaps of the others. What remains in the end is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotweave.llm.common import small_batches, text_udf
from slotweave.llm.packing import best_fit, token_ids
from slotweave.session import broadcast_if_small, stage

CAPACITY = 1024
END_ID = 0
DEPTH = 3
PART_ITEMS = 100_000  # left-over tails packed by one task
ADDED_AT_ONCE = 48  # combinations that enter the passive set together
MAX_STEPS = 400
RIDGE = 1e-9
CLOSE = 0.25  # squared distance, in tails, that rounding makes meaningless


def combinations(total: int, parts: int, most: int | None = None) -> np.ndarray:
    """All descending rows of exactly ``parts`` positive lengths, none above ``most``, that add up to ``total``."""
    most = total if most is None else min(most, total)
    if parts == 1:
        return np.array([[total]] if 1 <= total <= most else np.empty((0, 1)), dtype=np.int64).reshape(-1, 1)
    if parts == 2:
        first = np.arange(-(-total // 2), min(most, total - 1) + 1)
        return np.stack([first, total - first], axis=1)
    rows = []
    for first in range(-(-total // parts), min(most, total - parts + 1) + 1):
        rest = combinations(total - first, parts - 1, first)
        rows.append(np.concatenate([np.full((len(rest), 1), first), rest], axis=1))
    return np.concatenate(rows) if rows else np.empty((0, parts), dtype=np.int64)


def shallow(capacity: int, depth: int, known: np.ndarray) -> np.ndarray:
    """Combinations of 2 to ``depth`` of the ``known`` lengths (a mask) that fill the window; 0 fills up a row."""
    out = []
    for parts in range(2, depth + 1):
        rows = combinations(capacity, parts)
        rows = rows[known[rows].all(axis=1)]
        out.append(np.pad(rows, ((0, 0), (0, depth - parts))))
    return np.concatenate(out) if out else np.empty((0, depth), dtype=np.int64)


def repeat_counts(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x >= 0 with the least squared distance between the lengths used by x copies of ``rows`` and ``counts``.

    Active sets: the combinations that would help most and have no length in common enter together, those whose least squares
    solution is not positive leave. Where that stops helping, steps end where the first combination meets zero, as Lawson
    and Hanson's do, which never moves away from the optimum.
    """
    x, target = np.zeros(len(rows)), counts.astype(np.float64)
    target[0] = 0
    size = len(counts)

    def dense(some: np.ndarray) -> np.ndarray:
        a = np.zeros((size, len(some)))
        for k in range(rows.shape[1]):
            np.add.at(a, (rows[some, k], np.arange(len(some))), 1.0)
        a[0] = 0
        return a

    x = np.zeros(len(rows))
    def solved(some: np.ndarray) -> np.ndarray:
        a = dense(some)
        return np.linalg.solve(a.T @ a + RIDGE * np.eye(len(some)), a.T @ target)

    passive, careful, stalled = np.empty(0, dtype=np.int64), False, 0
    best, lowest = x, float(target @ target)
    for _ in range(MAX_STEPS):
        left = target - dense(passive) @ x[passive]
        left[0] = 0
        error = float(left @ left)
        stalled = stalled + 1 if error > lowest * (1 - 1e-6) else 0
        if error < lowest:
            best, lowest = x, error
        if error < CLOSE or careful and stalled > 3:
            break
        if stalled > 3:  # from the best solution on, never further than all stay non-negative
            careful, stalled, x = True, 0, best
            passive = np.flatnonzero(x > 0)
            left = target - dense(passive) @ x[passive]
            left[0] = 0
        gain = left[rows].sum(axis=1)
        gain[passive] = -np.inf
        taken, used = [], np.zeros(size, dtype=bool)
        for j in np.argsort(-gain, kind="stable")[:4096].tolist():
            if gain[j] <= 1e-6 or len(taken) == ADDED_AT_ONCE:
                break
            lengths = rows[j][rows[j] > 0]
            if not used[lengths].any():
                used[lengths] = True
                taken.append(j)
        if not taken:
            if careful:
                break
            stalled = MAX_STEPS
            continue
        passive, x = np.concatenate([passive, np.array(taken, dtype=np.int64)]), x.copy()
        while len(passive):
            z, now = solved(passive), x[passive]
            x[passive] = 0
            if (z > 0).all():
                x[passive] = z
                break
            if not careful:
                passive = passive[z > 0]
                continue
            room = np.where(z <= 0, now / np.maximum(now - z, 1e-300), np.inf)
            stays = room > room.min() + 1e-12
            now = np.maximum(now + min(1.0, float(room.min())) * (z - now), 0)
            passive = passive[stays]
            x[passive] = now[stays]
    return best


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeat counts near ``x`` that use no length more often than ``counts`` has it."""
    # Copies of combinations are granted in the order of what rounding down would lose, largest first.
    left = counts.astype(np.int64).copy()
    out = np.zeros(len(rows), dtype=np.int64)
    some = np.flatnonzero(x > 1e-9)

    def grant(j: int, copies: int) -> None:
        lengths, need = np.unique(rows[j][rows[j] > 0], return_counts=True)
        copies = min(copies, int((left[lengths] // need).min()))
        if copies > 0:
            out[j] += copies
            left[lengths] -= copies * need

    for j in some[np.argsort(-x[some], kind="stable")].tolist():
        grant(j, int(x[j] + 1e-9))
    for j in some[np.argsort(-(x[some] % 1), kind="stable")].tolist():
        grant(j, 1)
    return out


@dataclass(frozen=True)
class Plan:
    """Which window and offset the tail with a given rank among its length has; at most ``depth`` slots a combination."""

    planned: np.ndarray  # tails placed, by length
    base: np.ndarray  # planned tails of smaller lengths
    ends: np.ndarray  # by slot: planned tails up to and with it
    first: np.ndarray  # by slot: window of its first tail
    offset: np.ndarray
    windows: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether planned, window, offset)."""
        inside = rank < self.planned[length]
        if not len(self.ends):
            return inside, np.zeros_like(rank), np.zeros_like(rank)
        key = self.base[length] + rank
        slot = np.minimum(np.searchsorted(self.ends, key, side="right"), len(self.ends) - 1)
        before = np.where(slot > 0, self.ends[slot - 1], 0)
        return inside, self.first[slot] + key - before, self.offset[slot]


def plan(counts: np.ndarray, capacity: int = CAPACITY, depth: int = DEPTH) -> Plan:
    """The plan for ``counts[length]`` tails shorter than the capacity."""
    rows = shallow(capacity, depth, counts > 0)
    copies = rounded(rows, repeat_counts(rows, counts), counts) if len(rows) else np.empty(0, dtype=np.int64)
    rows, copies = rows[copies > 0], copies[copies > 0]
    starts = np.cumsum(copies) - copies
    offsets = np.cumsum(rows, axis=1) - rows
    which, place = np.nonzero(rows)
    length = rows[which, place]
    order = np.lexsort((place, which, length))
    which, place, length = which[order], place[order], length[order]
    planned = np.bincount(length, weights=copies[which], minlength=capacity + 1).astype(np.int64)
    return Plan(planned, np.cumsum(planned) - planned, np.cumsum(copies[which]), starts[which], offsets[which, place], int(copies.sum()))


def fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length, window, offset) of pieces: best-fit decreasing, then gaps are filled by cutting the emptiest windows.

    Every window but the last few is full; those few hold powers of two.
    """
    if not len(lengths):
        return (np.empty(0, dtype=np.int64),) * 5
    bins, offsets, room = best_fit(lengths, capacity)
    free = np.array(room, dtype=np.int64)
    order = np.argsort(free, kind="stable")
    gaps, used = np.cumsum(free[order]), np.cumsum((capacity - free[order])[::-1])[::-1]
    # The fullest windows stay as long as what the rest holds is enough for their gaps.
    enough = gaps <= np.append(used[1:], 0)
    stays = int(np.flatnonzero(enough)[-1]) + 1 if enough.any() else 0
    kept = np.zeros(len(free), dtype=bool)
    kept[order[:stays]] = True
    still = kept[bins]
    item, start, size = np.flatnonzero(still), np.zeros(int(still.sum()), dtype=np.int64), lengths[still]
    window, offset = bins[still], offsets[still]

    stream = np.flatnonzero(~still)
    stream = stream[np.lexsort((offsets[stream], bins[stream]))]
    total = int(lengths[stream].sum())
    open_bins = order[:stays][free[order[:stays]] > 0]
    rest = total - int(free[open_bins].sum())
    tail = [1 << k for k in range(capacity.bit_length(), -1, -1) if rest % capacity >> k & 1]
    new = np.array([capacity] * (rest // capacity) + tail, dtype=np.int64)
    target_size = np.concatenate([free[open_bins], new])
    target_window = np.concatenate([open_bins, len(free) + np.arange(len(new))])
    target_offset = np.concatenate([capacity - free[open_bins], np.zeros(len(new), dtype=np.int64)])
    piece_ends, target_ends = np.cumsum(lengths[stream]), np.cumsum(target_size)
    ends = np.unique(np.concatenate([piece_ends, target_ends]))
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    p, t = np.searchsorted(piece_ends, begins, side="right"), np.searchsorted(target_ends, begins, side="right")
    p_begin = piece_ends - lengths[stream]
    t_begin = target_ends - target_size
    return (np.concatenate([item, stream[p]]), np.concatenate([start, begins - p_begin[p]]), np.concatenate([size, ends - begins]),
            np.concatenate([window, target_window[t]]), np.concatenate([offset, target_offset[t] + begins - t_begin[t]]))


def _cutter(path: str, capacity: int, end_id: int):
    def work(text: str) -> tuple[int, list[int], bytes]:
        ids = np.append(token_ids(path)(text), np.uint32(end_id)).astype("<u4")
        crcs = [zlib.crc32(ids[at:at + capacity].tobytes()) for at in range(0, len(ids), capacity)]
        tail = ids[len(ids) // capacity * capacity:]
        return len(ids), crcs, (tail.astype("<u2") if not len(tail) or int(tail.max()) < 1 << 16 else tail).tobytes()

    return lambda: work


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    arrays = [*batch.columns, *[pa.array(c, pa.int64()) for c in columns.values()]]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *columns])


def _add_longs(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.LongType()) for n in names]])


def _ranker(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            place = np.empty(len(length), dtype=np.int64)
            place[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield _with(batch, part=np.full(len(length), part), place=place)

    return run


def _placer(known: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, window, offset = known.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield _with(batch, sequence_id=np.where(inside, window, -1), offset=offset)

    return run


def _filler(schema: pa.Schema, capacity: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows.column("length").to_numpy()
        item, start, size, window, offset = fill(lengths, capacity)
        first = base + (TaskContext.get().partitionId() << 32)
        whole = rows.take(pa.array(item)).drop_columns(["length"])
        for name, values in (("cut_at", start), ("length", size), ("sequence_id", window + first), ("offset", offset)):
            whole = whole.append_column(name, pa.array(values, pa.int64()))
        # A tail that was cut has other checks than the one it came with.
        same = pa.array(size == lengths[item])
        whole = whole.set_column(whole.schema.names.index("ids_crc32"), "ids_crc32", pc.if_else(same, whole.column("ids_crc32"), None))
        yield from whole.select(schema.names).cast(schema).to_batches(max_chunksize=10_000)

    return run


@F.pandas_udf(T.LongType())
def _crc_of(tail: pd.Series, length: pd.Series, at: pd.Series, size: pd.Series) -> pd.Series:
    out = []
    for ids, n, a, k in zip(tail, length, at, size):
        ids = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
        out.append(zlib.crc32(ids[a:a + k].tobytes()))
    return pd.Series(out, dtype="int64")


def pack_windows(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, depth: int = DEPTH,
                 part_items: int = PART_ITEMS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs(doc_id, text)``, a row per piece.

    Null and empty texts hold the end id only and are packed like any other; repeated rows are packed each; other
    columns are ignored; an empty table gives no rows. Windows are full, but for at most ten of each partition of left-over tails,
    which hold powers of two. The capacity is itself a power of two.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    small_batches(docs.sparkSession)
    cut = text_udf("n long, crcs array<long>, tail binary", _cutter(path, capacity, end_id))
    tokens = docs.select("doc_id", cut("text").alias("t")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "t.n", "t.crcs", "t.tail")
    tokens = stage(tokens, "tokens")
    columns = ["doc_id", "start", "length", "ids_crc32", "n", "sequence_id", "offset"]

    whole = tokens.where(F.col("n") >= capacity).select(
        "doc_id", "n", F.posexplode(F.slice("crcs", 1, F.floor(F.col("n") / capacity).cast("int"))).alias("piece", "ids_crc32"))
    whole = whole.select(
        "doc_id", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "n",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # Ranks among tails of the same length: a table of sizes is summed up, no tail moves.
    tails = tokens.where(F.col("n") % capacity > 0).select(
        "row", "doc_id", "n", (F.col("n") % capacity).alias("length"), F.element_at("crcs", -1).alias("ids_crc32"))
    ranked = stage(tails.mapInArrow(_ranker(capacity), _add_longs(tails.schema, "part", "place")), "ranked")
    sizes = stage(ranked.groupBy("length", "part").agg(F.count("*").alias("size")), "sizes")
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(sizes.select("length", "part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before")), "before")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("size").alias("size")).collect():  # one number a length
        counts[r["length"]] = r["size"]
    known = plan(counts, capacity, depth)
    numbered = ranked.join(broadcast_if_small(before), ["length", "part"]).select(
        "row", "doc_id", "n", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    placed = numbered.mapInArrow(_placer(known), _add_longs(numbered.schema, "sequence_id", "offset"))
    placed = stage(placed.drop("rank"), "placed")
    at_tail = F.floor(F.col("n") / capacity) * capacity
    planned = placed.where("sequence_id >= 0").withColumn("start", at_tail)

    left = int((counts - known.planned).sum())
    rest = placed.where("sequence_id < 0").select("row", "doc_id", "n", "ids_crc32", "length")
    schema = T.StructType([f for f in rest.schema.fields if f.name != "length"])
    schema = _add_longs(schema, "cut_at", "length", "sequence_id", "offset")
    dealt = rest.repartition(max(1, -(-left // part_items)), F.xxhash64("row"))
    filled = stage(dealt.mapInArrow(_filler(to_arrow_schema(schema), capacity, known.windows), schema), "filled")
    filled = filled.withColumn("start", at_tail + F.col("cut_at"))
    pieces = filled.where("ids_crc32 IS NULL").drop("ids_crc32", "doc_id", "n")
    texts = tokens.select("row", "doc_id", "n", "tail").join(broadcast_if_small(pieces), "row")
    pieces = texts.withColumn("ids_crc32", _crc_of("tail", F.col("n") % capacity, "cut_at", "length"))

    parts = [whole, planned, filled.where("ids_crc32 IS NOT NULL"), pieces]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out.withColumnRenamed("n", "doc_tokens")
