"""Near copies: texts link when the Jaccard similarity of their word shingles is large enough.

Texts with the same set of shingles are one entry. Every other entry has a SimHash fingerprint of its set, and the Gray-ordered
index of ``simhash`` finds the fingerprints that differ in few bits. What it connects is a value that its entries share, and entries
that share a value are compared, by their shingle sets and not by their fingerprints.

Fingerprints of sets at the threshold of 0.8 differ in ten of 64 bits on average, more than an index of blocks can cover. For the
pairs beyond its limit a MinHash sketch is cut into bands, and a whole band is a value like the other. A pair at the threshold
agrees in none of the 28 bands with probability (1 - 0.8^5)^28, about 1 in 66,000; only such a pair can be missed, if its
fingerprints are far apart, too. Nothing below the threshold links.

Of the entries that share a value the largest connected part needs no comparison in itself. The rest is cut into blocks
of bounded size, and each is compared in itself, with a few entries of the largest part and with a few of the rest, which connects a
group of copies however large. What is still apart then, and only that, is compared with everything: every pair is compared
or already connected. The index goes first, the bands follow in rounds, and a later round leaves out what the earlier ones connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm import simhash
from slotweave.llm.common import small_batches, text_udf
from slotweave.llm.components import components
from slotweave.session import broadcast_if_small, stage

SHINGLE, SIMILARITY = 5, 0.8
BITS = 7  # fingerprints up to so far apart meet through the index
INDEX_ROWS = 2000  # fingerprints under one of its top nodes before it is split
BANDS, ROWS = 28, 5
SEED = 42
HASHES_AT_ONCE = 1 << 11  # hashes of a text that meet all functions of the sketch at once
TILE = 512  # entries in a block
TILE_SHINGLES = 1 << 20  # and shingles, on average
FEW = 32  # entries that stand for a part
BAND_ROUNDS = (4, 28)  # bands compared up to and with each round
COUNTS_AT_ONCE = 1 << 18  # shared shingles of an entry counted at once


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle. Words as in ``simhash``."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=len(words) - shingle + 1))


def _sketch(shingle: int, bands: int, rows: int) -> Callable[[], Callable[[str], tuple]]:
    def make() -> Callable[[str], tuple]:
        rng = np.random.default_rng(SEED)
        flip = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)
        times = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def work(text: str) -> tuple:
            have = shingle_set(text, shingle)
            least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in range(0, len(have), HASHES_AT_ONCE):
                least = np.minimum(least, ((have[at:at + HASHES_AT_ONCE] ^ flip) * times).min(axis=1))
            cut = least.reshape(bands, rows)
            keys = [xxhash.xxh64_intdigest(cut[b].tobytes(), b) for b in range(bands)] if len(have) else []
            fp = simhash.fingerprint_of(have)
            return xxhash.xxh3_128_digest(have.tobytes()), fp - (1 << 64) if fp >> 63 else fp, np.array(keys, dtype=np.uint64).view(np.int64), len(have)

        return work

    return make


def tile_links(sets: list[np.ndarray], sides: np.ndarray, roots: np.ndarray | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what all pairs of the tile at the threshold connect.

    Pairs of the same root, or both of side 0, need no comparison: they are connected, or compared in another tile.
    """
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(sets)) if roots is None else np.unique(roots, return_inverse=True)[1].copy()
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posted = owner[np.argsort(token, kind="stable")]  # entries of each token, one token after the other
    starts = np.cumsum(often) - often
    ends, links = np.cumsum(sizes), []
    for i in range(len(sets)):
        others = root != root[i]
        others[:i] = False
        if sides[i] == 0:
            others &= sides != 0
        if not others.any():
            continue
        own = token[ends[i] - sizes[i]:ends[i]]
        own = own[often[own] > 1]
        shared = np.zeros(len(sets), dtype=np.int64)
        step = max(1, COUNTS_AT_ONCE // len(sets))
        for at in range(0, len(own), step):
            some = own[at:at + step]
            n = often[some]
            places = np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared += np.bincount(posted[places], minlength=len(sets))
        near = others & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9)
        for j in np.flatnonzero(near).tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def _compare(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve():
            links = tile_links(sets, np.array(sides), np.array(roots), similarity) if len(set(roots)) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        tile, nodes, roots, sides, sets = None, [], [], [], []
        for batch in batches:
            for here, side, node, root, text in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "node", "root", "text"))):
                if here != tile:
                    yield from solve()
                    tile, nodes, roots, sides, sets = here, [], [], [], []
                nodes.append(node)
                roots.append(root)
                sides.append(side)
                sets.append(shingle_set(text or "", shingle))
        yield from solve()

    return run


def weighed(members: DataFrame, tile: int = TILE) -> DataFrame:
    """Members (key, node, root, size) with what is known of their band value: its largest part and the sizes of it and of the rest.

    Values with one part are left out. ``done`` tells that ``first_tiles`` will compare all pairs.
    """
    parts = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    largest = F.max_by(F.struct("root", "n", "volume"), F.struct("n", "root"))
    values = parts.groupBy("key").agg(largest.alias("main"), F.sum("n").alias("n"), F.sum("volume").alias("volume")).where("n > main.n")
    blocks = lambda n, volume: F.greatest(F.ceil(n / tile), F.ceil(volume / TILE_SHINGLES)).cast("int")
    rest = F.col("n") - F.col("main.n")
    values = values.select("key", F.col("main.root").alias("main"), F.col("main.n").alias("n_main"), rest.alias("n_rest"), blocks(F.col("n"), F.col("volume")).alias("blocks"),
                           blocks(rest, F.col("volume") - F.col("main.volume")).alias("rest_blocks"))
    values = values.withColumn("done", (F.col("n_main") <= FEW) & (F.col("rest_blocks") == 1))
    return members.join(broadcast_if_small(stage(values, "values")), "key")


def _spread(seed: int, parts) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "node"), parts).cast("int")


def first_tiles(members: DataFrame) -> DataFrame:
    """(tile, side, node, root, size): each block of the rest, beside a few of the largest part and a few of the rest."""
    tile = F.xxhash64("key", "block").alias("tile")
    every = F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1))
    rest = members.where("root <> main")
    own = rest.withColumn("block", _spread(1, F.col("rest_blocks")))
    main = members.where("root = main").where(_spread(2, F.ceil(F.col("n_main") / FEW)) == 0).withColumn("block", every)
    some = rest.where("rest_blocks > 1").where(_spread(2, F.ceil(F.col("n_rest") / FEW)) == 0).withColumn("block", every)
    few = main.unionByName(some).select(tile, F.lit(0).alias("side"), "node", "root", "size")
    return own.select(tile, F.lit(1).alias("side"), "node", "root", "size").unionByName(few)


def last_tiles(members: DataFrame) -> DataFrame:
    """(tile, side, node, root, size): each block of the rest, beside each block of all."""
    tile = F.xxhash64("key", "group", "block").alias("tile")
    rest = members.where("root <> main").withColumn("group", _spread(1, F.col("rest_blocks")))
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = members.withColumn("block", _spread(3, F.col("blocks"))).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)))
    return rest.select(tile, F.lit(1).alias("side"), "node", "root", "size").unionByName(every.select(tile, F.lit(0).alias("side"), "node", "root", "size"))


def index_values(sketches: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, near): for fingerprints that the Gray index connects with a smaller one, the smallest they reach.

    Entries without words have no fingerprint.
    """
    prints = stage(sketches.where("size > 0").select("fp").distinct(), "prints")
    return stage(components(simhash.near_links(prints, bits, INDEX_ROWS)).select(F.col("node").alias("fp"), F.col("root").alias("near")), "near")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                tile: int = TILE, rounds: tuple[int, ...] = BAND_ROUNDS, bits: int = BITS) -> DataFrame:
    """(row, root) of ``docs(row, text)``: rows of one group of near copies have the same root, the smallest row of some text.

    ``row`` is a unique long and the same on every read. Null texts and texts without words are one group. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sketch = text_udf("sig binary, fp long, bands array<long>, size int", _sketch(shingle, bands, rows))
    sketches = stage(docs.select("row", sketch("text").alias("s")).select("row", "s.sig", "s.fp", "s.bands", "s.size"), "sketches")
    classes = stage(sketches.groupBy("sig").agg(F.min("row").alias("node")), "classes")
    heads = sketches.join(classes.select(F.col("node").alias("row")), "row", "left_semi").join(broadcast_if_small(index_values(sketches, bits)), "fp", "left")
    # What the index connects is the first value of its entries, the bands are the others.
    first = F.when(F.col("size") > 0, F.array(F.xxhash64(F.lit(SEED), F.coalesce("near", "fp")))).otherwise(F.array().cast("array<long>"))
    heads = stage(heads.select(F.col("row").alias("node"), F.concat(first, "bands").alias("values"), "size"), "heads")
    # Only texts that share a value with another are ever compared; they are written apart.
    spread = heads.select("node", F.explode("values").alias("key"))
    met = stage(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "met")
    asked = stage(spread.join(broadcast_if_small(met), "key", "left_semi").select("node").distinct(), "asked")
    texts = stage(docs.select(F.col("row").alias("node"), "text").join(broadcast_if_small(asked), "node", "left_semi"), "texts")
    roots = spark.createDataFrame([], "node long, root long")

    def compared(tiles: DataFrame) -> DataFrame:
        """The roots with what the tiles connect."""
        volume = tiles.agg(F.sum("size")).first()[0]
        if not volume:
            return roots
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // (4 * TILE_SHINGLES)))
        dealt = texts.join(broadcast_if_small(tiles), "node").select("tile", "side", "node", "root", "text").repartition(parts, "tile").sortWithinPartitions("tile")
        links = stage(dealt.mapInArrow(_compare(shingle, similarity), "a long, b long"), "links")
        if links.isEmpty():
            return roots
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return stage(components(links.unionByName(known)), "roots")

    done = 0
    for upto in [1, *[1 + r for r in rounds if r < bands], 1 + bands]:
        dealt = heads.select("node", "size", F.explode(F.slice("values", done + 1, upto - done)).alias("key"))
        dealt = dealt.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Values whose entries are connected need no comparison; those that gather the same entries are compared once.
        shared = dealt.groupBy("key").agg(
            F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
            F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("all")).where("low < high")
        kept = stage(shared.groupBy("n", "first", "all").agg(F.min("key").alias("key")).select("key"), "kept")
        members = stage(weighed(dealt.join(broadcast_if_small(kept), "key").select("key", "node", "root", "size"), tile), "members")
        roots = compared(stage(first_tiles(members), "tiles"))
        left = members.where("NOT done").select("key", "node", "size")
        if not left.isEmpty():
            left = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            roots = compared(stage(last_tiles(stage(weighed(left, tile), "left")), "tiles"))
        done = upto
    named = classes.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"))
    return sketches.select("row", "sig").join(named, "sig").select("row", "root")
