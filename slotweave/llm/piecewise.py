"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it hits the block size, so chunks shift along with the text
around an edit. Each chunk gives one sign of the signature; the block size is the smallest of 3, 6, 12, ... that
gives fewer than 64 chunks (more in repetitive texts), and a second signature is kept at twice that size. Fingerprints are compared, where their
block sizes are equal or one is twice the other, by the edit distance (insertions and deletions) of signatures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotweave.llm.common import small_batches, text_udf
from slotweave.session import broadcast_if_small, stage
from slotweave.sources.ordinals import number_sorted

WINDOW = 7
SMALLEST, CHUNKS = 3, 64
COMMON = 4  # signs in a row that two signatures share, or a third of the shorter one; else they are unlike
BLOCK_IDS = 512  # ids that are ordered by one task at a time
BYTES_AT_ONCE = 1 << 20
TASK_BYTES = 64 << 20  # of texts that one task orders

# The signs of a signature.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_WEIGHTS = [pow(0x01000193, k + 1, 1 << 32) | 1 for k in range(WINDOW)]


def _rolling(raw: np.ndarray) -> np.ndarray:
    """A hash of the seven bytes up to each place (fewer at the start), computed in slices of bounded size."""
    out = np.empty(len(raw), dtype=np.uint32)
    for at in range(0, len(raw), BYTES_AT_ONCE):
        start = max(0, at - WINDOW + 1)
        part = raw[start:at + BYTES_AT_ONCE].astype(np.uint32) + np.uint32(1)
        total = np.zeros(len(part), dtype=np.uint32)
        for k, weight in enumerate(_WEIGHTS):
            total[k:] += part[:max(0, len(part) - k)] * np.uint32(weight)
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
        total ^= total >> np.uint32(13)
        out[at:at + BYTES_AT_ONCE] = total[at - start:]
    return out


def _signature(data: memoryview, ends: np.ndarray) -> str:
    stops = ends.tolist()
    if not stops or stops[-1] != len(data):
        stops.append(len(data))
    signs, at = [], 0
    for stop in stops:
        signs.append(SIGNS[zlib.crc32(data[at:stop]) * 0x9E3779B1 >> 20 & 63])
        at = stop
    return "".join(signs)


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice the block size``; equal texts have equal fingerprints."""
    data = text.encode()
    if not data:
        return f"{SMALLEST}::"
    rolled = _rolling(np.frombuffer(data, dtype=np.uint8))
    size = SMALLEST
    hits = np.flatnonzero(rolled % np.uint32(size) == size - 1)
    while len(hits) >= CHUNKS:
        # An end at a larger block size is one at the smaller size, too.
        fewer = hits[rolled[hits] % np.uint32(2 * size) == 2 * size - 1]
        if len(fewer) < CHUNKS // 4 and len(hits) < 16 * CHUNKS:
            break  # a repetitive text: too little would be left to tell it from others
        size, hits = 2 * size, fewer
    twice = hits[rolled[hits] % np.uint32(2 * size) == 2 * size - 1]
    view = memoryview(data)
    return f"{size}:{_signature(view, hits + 1)}:{_signature(view, twice + 1)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all places of ``a`` at once in the bits of an integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    ones = (1 << len(a)) - 1
    row = ones
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & ones
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    run = min(COMMON, -(-min(len(a), len(b)) // 3))
    grams = {a[i:i + run] for i in range(len(a) - run + 1)}
    if not any(b[i:i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    distance = len(a) + len(b) - 2 * _common(a, b)
    return 1.0 - distance / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where the block sizes are too far apart."""
    if one == other:
        return 1.0
    size, a, a2 = one.split(":")
    size_b, b, b2 = other.split(":")
    if not a or not b:
        return 0.0
    s, t = int(size), int(size_b)
    if s == t:
        return max(_alike(a, b), _alike(a2, b2))
    if s == 2 * t:
        return _alike(a, b2)
    if t == 2 * s:
        return _alike(a2, b)
    return 0.0


def fingerprint_column(text: str | Column = "text") -> Column:
    return text_udf("fingerprint string", lambda: lambda value: (fingerprint(value),))(text)["fingerprint"]


def in_blocks(docs: DataFrame, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, int]:
    """(block, borrowed, doc_id, text), and the bytes of all texts: documents in blocks, numbered in the order of
    ids, and in each the first document of the next block.

    A block spans ``block_ids`` ids. Where repeated or null ids crowd one, every id of it gets blocks of its own, split
    by ranges of the text's hash into pieces of about ``block_ids`` rows. Which documents begin a block is found from ids
    and hashes; these, few unless ids are sparse, are sent to the block before as well (the very first one to
    the last block). Null ids come first, ties are ordered by the hash of their text.
    """
    span = F.coalesce(F.floor(F.col("doc_id") / F.lit(block_ids)).cast("long"), F.lit(-(1 << 62)))
    ids = docs.select("doc_id", span.alias("span"))
    crowded = stage(ids.groupBy("span").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block_ids).select("span"), "crowded")
    pieces = ids.join(broadcast_if_small(crowded), "span").groupBy("doc_id").agg(
        F.ceil(F.count("*") / F.lit(block_ids)).cast("long").alias("pieces"))
    pieces = broadcast_if_small(stage(pieces.withColumnRenamed("doc_id", "crowded_id"), "pieces"))
    rows = docs.select("doc_id", "text", span.alias("span"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rows = rows.join(pieces, rows["doc_id"].eqNullSafe(pieces["crowded_id"]), "left")
    # The upper 31 bits of the hash, counted from the smallest, times the pieces.
    piece = F.shiftright(F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 33) * F.col("pieces"), 31)
    own = F.when(F.col("pieces").isNotNull(), F.col("doc_id"))
    rows = rows.select("doc_id", "text", "hash", "span", F.coalesce(own, F.lit(0)).cast("long").alias("own"), F.coalesce(piece, F.lit(0)).alias("piece"))
    cells = ["span", "own", "piece"]
    heads = stage(rows.groupBy(*cells).agg(
        F.min(F.struct("doc_id", "hash")).alias("first"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")), "heads")
    blocks = stage(number_sorted(heads, cells, out="block"), "blocks")
    total = blocks.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    rows = rows.join(broadcast_if_small(blocks.drop("bytes")), cells)
    begins = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    before = F.pmod(F.col("block") - 1, F.lit(total["n"] or 1))
    place = lambda block, borrowed: F.struct(block.alias("block"), F.lit(borrowed).alias("borrowed"))
    places = F.when(begins, F.array(place(F.col("block"), False), place(before, True))).otherwise(F.array(place(F.col("block"), False)))
    return rows.select("doc_id", "text", "hash", F.inline(places)), total["bytes"] or 0


def _compare(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block = doc = text = mark = None
        open_row = False
        last: tuple = (None, None, None)  # equal rows follow one another: what they give is computed once

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for b, borrowed, d, t in zip(*(batch.column(c).to_pylist() for c in ("block", "borrowed", "doc_id", "text"))):
                t = t or ""
                if borrowed and not (open_row and b == block):
                    continue  # a further row with the id of the borrowed one
                now = mark if t == text else fingerprint(t)
                if open_row:
                    if last[:2] != (text, t):
                        n = len(text)
                        edited = text[:n - n // 2] + t[:n // 2]
                        print_edited = fingerprint(edited)
                        last = (text, t, (n, hashlib.sha256(edited.encode()).hexdigest(), mark, print_edited,
                                          likeness(mark, print_edited), likeness(mark, now)))
                    out.append((doc, *last[2]))
                block, doc, text, mark, open_row = b, d, t, now, not borrowed
            if out:
                yield flush()

    return run


def fingerprints(docs: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row.

    The edited text keeps the first half of a text and goes on with the start of the next document's, in the
    order of ids, after the last the first. A null text is empty; null ids come first. Rows that repeat an id are ordered
    by the XXH64 of their text. Texts travel once, to the task that orders their block, those that begin a block twice;
    the number of tasks follows from the bytes of the texts. Equal rows (id and text) stay in one task.
    """
    small_batches(docs.sparkSession)
    if docs.isEmpty():
        docs = docs.limit(0)
    rows, size = in_blocks(docs.select("doc_id", "text"), block_ids)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    dealt = rows.repartition(tasks, "block").sortWithinPartitions("block", "borrowed", "doc_id", "hash", "text")
    return dealt.select("block", "borrowed", "doc_id", "text").mapInArrow(_compare(to_arrow_schema(schema)), schema)
