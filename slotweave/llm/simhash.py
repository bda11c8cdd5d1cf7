"""SimHash near-duplicates through a Gray-ordered hierarchical index.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Texts link when their
fingerprints differ in few bits. The search keeps fingerprints sorted by Gray rank: neighbours in that order
share many bits, so runs of them are summed up by the bits they have in common (mask and pattern). A node
carries only the common bits its parent lacks; walking down, differences add up, and a whole node is left as
soon as they exceed the limit.

The top of the index is spread over the cluster. With at most k differing bits, one of k + 1 blocks of bits
agrees, so there are k + 1 copies of the index, each with one block as the masked pattern of its top nodes:
all fingerprints of a top node meet in one place, and every linked pair meets in some copy. A top node with too
many fingerprints is split by the same argument on its remaining bits, level by level; after the last level
the bits left free bound its size. Equal fingerprints are one entry throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import small_batches, text_udf
from slotweave.llm.components import components
from slotweave.session import stage

SEED = 42
HASHES_AT_ONCE = 1 << 16  # hashes of a long text held together
LEAF, FAN = 16, 8  # fingerprints in a leaf, nodes under a node
PAIRS_AT_ONCE = 1 << 16  # pairs of a fingerprint and a node, or another one, compared at once
GROUP_ROWS = 20_000  # fingerprints under one top node before it is split
LEVELS = 4  # splits; with 3 bits then 44 bits are fixed and 20 are free


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of shingle hashes; 0 without any."""
    ones = sum((_ones(hashes[at:at + HASHES_AT_ONCE]) for at in range(0, len(hashes), HASHES_AT_ONCE)), np.zeros(64, dtype=np.int64))
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text; 0 without words. Words are cut at ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        ones += _ones(np.fromiter(hashes, dtype=np.uint64, count=min(HASHES_AT_ONCE, n - at)))
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _signed_fingerprint(shingle: int) -> Callable[[], Callable[[str], tuple]]:
    def work(text: str) -> tuple:
        value = fingerprint(text, shingle)
        return (value - (1 << 64) if value >> 63 else value,)

    return lambda: work


def fingerprint_column(text: str | Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""
    return text_udf("fp long", _signed_fingerprint(shingle))(text)["fp"]


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code sequence."""
    rank = values.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """The part of the index under one top node: distinct fingerprints, sorted by Gray rank."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (own mask, pattern), leaves first
        common_and, common_or, size = values, values, LEAF
        shared = []
        while True:
            starts = np.arange(0, len(common_and), size)
            common_and = np.bitwise_and.reduceat(common_and, starts)
            common_or = np.bitwise_or.reduceat(common_or, starts)
            shared.append((common_and | ~common_or, common_and))
            if len(starts) == 1:
                break
            size = FAN
        # A node keeps the common bits that its parent does not have already.
        for depth, (mask, pattern) in enumerate(shared):
            own = mask & ~shared[depth + 1][0][np.arange(len(mask)) // FAN] if depth + 1 < len(shared) else mask
            self.levels.append((own, pattern))
        self.leaf_mask = shared[0][0]

    def links(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions i < j at most ``bits`` apart, in blocks.

        Depth first: of every level at most ``PAIRS_AT_ONCE`` pairs of a position and a node are held, even where nothing is pruned.
        """
        n = len(self.values)
        todo = [(len(self.levels) - 1, np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64))]
        while todo:
            depth, who, nodes, apart = todo.pop()
            width, below = (FAN, len(self.levels[depth - 1][0])) if depth else (LEAF, n)
            step = PAIRS_AT_ONCE // width
            if len(who) > step:
                todo.append((depth, who[step:], nodes[step:], apart[step:]))
                who, nodes, apart = who[:step], nodes[:step], apart[:step]
            own, pattern = self.levels[depth]
            apart = apart + np.bitwise_count((self.values[who] ^ pattern[nodes]) & own[nodes])
            keep = apart <= bits
            who, nodes, apart = who[keep], nodes[keep], apart[keep]
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            who, apart = np.repeat(who, width), np.repeat(apart, width)
            # Runs are in order, so a node before the query's own run holds no later position.
            keep = (nodes < below) & (nodes >= who // (LEAF * FAN ** (depth - 1)) if depth else (nodes > who) & (nodes < below))
            who, nodes, apart = who[keep], nodes[keep], apart[keep]
            if depth:
                if len(who):
                    todo.append((depth - 1, who, nodes, apart))
                continue
            rest = ~self.leaf_mask[nodes // LEAF]
            near = apart + np.bitwise_count((self.values[who] ^ self.values[nodes]) & rest) <= bits
            if near.any():
                yield who[near], nodes[near]


def spanning_links(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions that connect what the links among ``values`` connect."""
    root = np.arange(len(values))

    def settle() -> None:
        while True:
            up = root[root]
            if np.array_equal(up, root):
                return
            root[:] = up

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for left, right in GrayIndex(values).links(bits):
        ends = np.stack([root[left], root[right]])
        for i, j in np.unique(ends[:, ends[0] != ends[1]], axis=1).T.tolist():
            i, j = top(i), top(j)
            if i != j:
                root[max(i, j)] = min(i, j)
        settle()
    members = np.flatnonzero(root != np.arange(len(values)))
    return members, root[members]


def _masks(bits: int) -> list[list[int]]:
    """The masked bits of every copy of the index, level by level; the copies of one node stand together."""
    parts = bits + 1

    def split(free: list[int]) -> list[list[int]]:
        cut = [round(len(free) * i / parts) for i in range(parts + 1)]
        return [free[a:b] for a, b in zip(cut, cut[1:])]

    level, out = [list(range(64))], []
    fixed = [0]
    for _ in range(LEVELS):
        nxt, masks = [], []
        for free, mask in zip(level, fixed):
            for part in split(free):
                masks.append(mask | sum(1 << b for b in part))
                nxt.append([b for b in free if b not in part])
        level, fixed = nxt, masks
        out.append(masks)
    return out


def _placed(rows: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """Each row under its top node in every copy below its present one."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    down = rows.select("fp", F.explode(F.transform(
        F.array(*[F.lit(i) for i in range(parts)]), lambda i: F.col("copy") * parts + i)).alias("copy"))
    pattern = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in signed]), F.col("copy") + 1))
    return down.select("fp", "copy", F.xxhash64("copy", pattern).alias("top"))


def _search(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_top, held_fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def solve(tops: np.ndarray, fps: np.ndarray):
            cuts = np.flatnonzero(np.diff(tops)) + 1
            starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(tops)]))
            many = np.flatnonzero(stops - starts > 1)
            ends: tuple[list, list] = ([], [])
            for a, b in zip(starts[many].tolist(), stops[many].tolist()):
                values = np.unique(fps[a:b].view(np.uint64))
                values = values[np.argsort(gray_rank(values), kind="stable")]
                member, root = spanning_links(values, bits)
                ends[0].append(values[member].view(np.int64))
                ends[1].append(values[root].view(np.int64))
            if ends[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)) for e in ends], names=["a", "b"])

        for batch in batches:
            tops = np.concatenate((held_top, batch.column("top").to_numpy(zero_copy_only=False)))
            fps = np.concatenate((held_fp, batch.column("fp").to_numpy(zero_copy_only=False)))
            if not len(tops):
                continue
            last = np.searchsorted(tops, tops[-1])  # the last group may go on
            held_top, held_fp = tops[last:], fps[last:]
            if last:
                yield from solve(tops[:last], fps[:last])
        if len(held_top):
            yield from solve(held_top, held_fp)

    return run


def near_links(fps: DataFrame, bits: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links that connect all of the distinct ``fp`` values at most ``bits`` apart."""
    masks = _masks(bits)
    rows = _placed(fps.select("fp", F.lit(0).alias("copy")), masks[0], bits + 1)
    ready = None
    for level in range(LEVELS):
        big = stage(rows.groupBy("top").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("top"), "tops") \
            if level + 1 < LEVELS else None
        done = big is None or big.isEmpty()
        fits = rows if done else rows.join(big, "top", "left_anti")
        ready = fits if ready is None else ready.unionByName(fits)
        if done:
            break
        rows = _placed(rows.join(big, "top", "left_semi"), masks[level + 1], bits + 1)
    dealt = ready.select("top", "fp").repartition("top").sortWithinPartitions("top")
    return dealt.mapInArrow(_search(bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of ``docs(doc_id, text)``; other columns are ignored.

    A null text has no words, so its fingerprint is zero, like that of an empty one. Texts without words link
    to one another, and to texts whose fingerprint happens to lie near zero. Rows that repeat an id keep a row
    each. The component is named by its smallest id; null ids count only where a component has no other.
    """
    small_batches(docs.sparkSession)
    prints = stage(docs.select("doc_id", fingerprint_column("text", shingle).alias("fp")), "prints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_links(classes, bits, group_rows))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
