"""Best-fit packing of token pieces into sequences, certified by lower bounds and repaired by exchange.

Pieces are dealt over partitions of bounded size and packed there best-fit decreasing. Dual feasible functions
map lengths so that what fits a sequence still fits; the mapped total, in sequences, is a lower bound. A
partition that meets its bound is certified and gives up its emptiest sequence only (bounds of partitions are
rounded up one by one); one that does not gives up all sequences with room left. Those documents are
dealt again, together, and packed anew; the new packing is taken if it needs fewer sequences. Only the shrinking
pool moves from round to round.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer, pre_tokenizers

from slotweave.llm.common import small_batches, text_udf
from slotweave.session import stage

CAPACITY = 1024
END_ID = 2
PART_ITEMS = 20_000  # pieces packed by one task
ROUNDS = 5
DEPTH = 40  # rounding steps tried as dual feasible functions

# Fixed value: how byte-level vocabularies cut text before merging.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenIds:
    """Ids of whole texts as the tokenizer file gives them.

    A byte-level vocabulary whose ids follow the order of its merges is run by the faster merge engine; any other
    file, and any text that engine refuses, by the tokenizer library itself. Both give the same ids.
    """

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.fast = self._engine(path)

    def _engine(self, path: str) -> tiktoken.Encoding | None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], self.exact.pre_tokenizer
        added = spec.get("added_tokens") or []
        if (model.get("type") != "BPE" or spec.get("normalizer") or not isinstance(cut, pre_tokenizers.ByteLevel)
                or cut.add_prefix_space or not cut.use_regex or model.get("dropout") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)):
            return None
        letters, special = _byte_letters(), {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [ranks.get(bytes(letters[c] for c in a + b), -1) for a, b in merges]
        if made != sorted(set(made)) or len(made) + 256 != len(ranks) or made and made[0] <= max(ranks[bytes([b])] for b in range(256)):
            return None
        return tiktoken.Encoding("vocabulary", pat_str=CUTS, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # white space or letters too long for its pattern matcher
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def _sizes(path: str, capacity: int, end_id: int):
    def work(text: str) -> tuple[int, list[int]]:
        ids = np.append(token_ids(path)(text), np.uint32(end_id)).astype("<u4")
        first = (len(ids) - 1) % capacity + 1
        stops = range(first, len(ids) + 1, capacity)
        return len(ids), [zlib.crc32(ids[max(0, stop - capacity):stop].tobytes() if stop > first else ids[:first].tobytes()) for stop in stops]

    return lambda: work


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's tokens in pieces of the capacity, the first one shorter.

    A null or empty text has the end id alone.
    """
    cut = docs.select("doc_id", text_udf("n long, crcs array<long>", _sizes(path, capacity, end_id))("text").alias("t"))
    first = (F.col("n") - 1) % capacity + 1
    return cut.select("doc_id", "t.n", F.posexplode("t.crcs").alias("piece", "ids_crc32")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"),
        F.when(F.col("piece") == 0, 0).otherwise(first + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(F.col("piece") == 0, first).otherwise(capacity).cast("long").alias("length"), "ids_crc32")


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that ``counts[length]`` pieces need at least, by the best of the dual feasible functions."""
    size = np.arange(capacity + 1)
    counts = np.asarray(counts, dtype=np.int64)
    total = counts * size
    ahead = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(total)))
    cut = np.arange(0, capacity // 2 + 1)
    # Pieces shorter than the cut vanish; those that leave less than the cut count as full sequences.
    large = ahead[0][-1] - ahead[0][capacity - cut + 1]
    middle = ahead[1][capacity - cut + 1] - ahead[1][cut]
    best = int(np.max(large + -(-middle // capacity)))
    for k in range(1, DEPTH + 1):  # lengths rounded down to k-ths of a sequence, but for exact (k + 1)-ths
        steps = size * (k + 1)
        mapped = np.where(steps % capacity == 0, size * k, steps // capacity * capacity)
        best = max(best, int(-(-int((counts * mapped).sum()) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: sequence and offset of each piece, room left in each sequence."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit g: some sequence has room g
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = filled >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                filled ^= 1 << left
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        room[b] = left = left - size
        by_room[left].append(b)
        filled |= 1 << left
    return bins, offsets, room


def _packer(schema: pa.Schema, capacity: int, round_no: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows.column("length").to_numpy()
        bins, offsets, room = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        free = np.array(room)
        given_up = free > 0 if len(room) > bound else (np.arange(len(free)) == int(free.argmax())) & (free > 0)
        base = ((round_no << 24) + TaskContext.get().partitionId()) << 32
        out = [rows.column(name) for name in rows.column_names]
        out += [pa.array(bins + base), pa.array(offsets), pa.array(given_up[bins]),
                pa.array(np.concatenate(([bound], np.zeros(len(bins) - 1, dtype=np.int64))))]
        yield from pa.Table.from_arrays(out, schema=schema).to_batches(max_chunksize=10_000)

    return run


def _packed(items: DataFrame, n: int, capacity: int, round_no: int, part_items: int) -> DataFrame:
    fields = [f for f in items.schema.fields]
    fields += [T.StructField(name, T.LongType()) for name in ("sequence_id", "offset")]
    fields += [T.StructField("given_up", T.BooleanType()), T.StructField("bound", T.LongType())]
    schema = T.StructType(fields)
    dealt = items.repartition(max(1, -(-n // part_items)), F.xxhash64(F.lit(round_no), "item"))
    return stage(dealt.mapInArrow(_packer(to_arrow_schema(schema), capacity, round_no), schema), "packed")


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with a row number ``item`` and their ``length`` (1 to the capacity), plus sequence_id and offset.

    Offsets of a sequence start at 0 without gaps. Pieces that fill a sequence are not moved at all.
    """
    columns = [c for c in pieces.columns if c != "item"]
    whole = pieces.where(F.col("length") == capacity).select(
        *columns, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = pieces.where(F.col("length") < capacity)
    n = pool.count()
    out, before, kept = whole, None, None
    for round_no in range(1, rounds + 1):
        if not n:
            break
        now = _packed(pool, n, capacity, round_no, part_items)
        # Only these four numbers come to the driver.
        bins, _, open_bins, open_items = now.agg(
            F.sum((F.col("offset") == 0).cast("long")), F.sum("bound"),
            F.sum((F.col("given_up") & (F.col("offset") == 0)).cast("long")), F.sum(F.col("given_up").cast("long"))).first()
        if before is not None and bins >= before:
            break  # the packing before was as good
        kept = now
        single = n <= part_items
        if single or not open_items or round_no == rounds:
            break
        out = out.unionByName(kept.where("NOT given_up").select(*columns, "sequence_id", "offset"))
        pool = kept.where("given_up").select(*columns, "item")
        n, before, kept = open_items, open_bins, kept.where("given_up")
    if kept is not None:
        out = out.unionByName(kept.select(*columns, "sequence_id", "offset"))
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of ``docs(doc_id, text)``.

    Null and empty texts hold the end id only and are packed like any other; repeated rows are packed each; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    pieces = token_pieces(docs, path, capacity, end_id).withColumn("item", F.monotonically_increasing_id())
    return pack(stage(pieces, "pieces"), capacity)
