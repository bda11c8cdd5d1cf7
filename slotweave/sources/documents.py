"""Single JSON documents of any size, read by many tasks.

A file is cut behind every closing bracket, which Spark's text scan does in any byte range of it, and written as chunks
of bounded size. What a chunk does to the scanner's state (inside a string or not, depth of nesting) depends on the state
before it only through that one bit, so a chunk's effect is four numbers, and effects are composed in order on a table with
a row per chunk. With its state known, each chunk finds the ends of its elements by itself; what lies across chunk borders is put
together from its pieces. Only these pieces are grouped, nothing is sorted or read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.session import broadcast_if_small, stage

CHUNK_BYTES = 1 << 20
FOUND_ROWS = 64  # elements across chunk borders put together at a time

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_TOKEN = re.compile(rb'"((?:[^"\\]|\\.)*)"(\s*:)?|[\[\]{}]', re.DOTALL)


def walk(piece: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a string is open behind ``piece``, and by how much nesting grew, given whether one was open before.

    Escapes occur in strings only, so which quotes count does not depend on the state.
    """
    parts = (_ESCAPE.sub(b"", piece) if b"\\" in piece else piece).split(b'"')
    plain = b"".join(parts[1::2] if inside else parts[::2])
    return inside ^ (len(parts) % 2 == 0), plain.count(b"{") + plain.count(b"[") - plain.count(b"}") - plain.count(b"]")


def effect(pieces: list[bytes]) -> tuple[bool, int, int]:
    """What pieces, each followed by a closing bracket, do: does the state flip, growth from outside and from inside a string."""
    grown, inside = [0, 0], False
    for piece in pieces:
        for start in (False, True):
            after, more = walk(piece, inside ^ start)
            grown[start] += more - (not after)
        inside = after ^ True
    return inside, *grown


def split_elements(data: bytes, closer: bytes, inside: bool, depth: int, level: int) -> list[bytes]:
    """``data`` cut behind every closing bracket that returns to ``level``; the last part is what follows the last of them."""
    out, held = [], []
    pieces = data.split(closer)
    for k, piece in enumerate(pieces[:-1]):
        inside, more = walk(piece, inside)
        depth += more - (not inside)
        held.append(piece + closer)
        if not inside and depth == level:
            out.append(b"".join(held))
            held = []
    return [*out, b"".join(held) + pieces[-1]]


def element_of(group: bytes, opener: bytes, depth: int, level: int) -> tuple[bytes | None, bytes]:
    """(last key in front of the element, the element) of what lies between the ends of two elements."""
    key = None
    for match in _TOKEN.finditer(group):
        token = match.group()
        if token[:1] == b'"':
            key = match.group(1) if match.group(2) else key
        elif token in b"{[":
            if depth == level and token == opener:
                return key, group[match.start():]
            depth += 1
        else:
            depth -= 1
    raise ValueError("malformed document: no element before its end")


def _chunker(separator: bytes, size: int, states: bool):
    """Scanned pieces to chunks of about ``size`` bytes, by file and byte range, with their effects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, full, seq, held, length = None, 0, 0, [], 0

        def chunk():
            nonlocal seq, held, length
            data = separator.join([*held, b""])
            flips, outside, within = effect(held) if states else (False, 0, 0)
            try:
                data.decode("utf-8")
                valid = True
            except UnicodeDecodeError:
                valid = False
            values = [home[0], full, home[1], seq, data, flips, outside, within, valid]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
            seq, held, length = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            for file, size_of, start, value in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "start", "value"))):
                if (file, start) != home:
                    if held:
                        yield chunk()
                    home, full, seq = (file, start), size_of, 0
                held.append(value)
                length += len(value) + len(separator)
                if length >= size:
                    yield chunk()
        if held:
            yield chunk()

    return run


CHUNK = "file string, size long, start long, seq long, data binary, flips boolean, outside long, within long, valid boolean"


def chunks(spark: SparkSession, path, separator: str, size: int = CHUNK_BYTES, states: bool = False) -> DataFrame:
    """(file, size, start, seq, data, ...): the bytes of files, cut behind ``separator``, in the order of start and seq.

    Each range Spark gives to a task is cut by itself. The separator is added behind the very last piece, too.
    """
    scan = spark.read.option("lineSep", separator).text(path)
    rows = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                       F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    return stage(rows.mapInArrow(_chunker(separator.encode(), size, states), CHUNK), "chunks")


def _cutter(opener: bytes, closer: bytes, level: int):
    """Chunks to their elements, a chunk at a time: what a batch holds is never in Python objects all at once."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                file, number, data, inside, depth = (batch.column(c)[at].as_py() for c in ("file", "number", "data", "inside", "depth"))
                groups = split_elements(data, closer, inside, depth, level)
                ends = len(groups) - 1
                rows = [(file, number, 0, ends, None, groups[0])] if ends else []
                for i, group in enumerate(groups[1:-1], 1):
                    rows.append((file, number, i, ends, *element_of(group, opener, level, level)))
                rows.append((file, number, None, ends, None, groups[-1]))  # goes on in the next chunk that has an end
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "number", "i", "ends", "key", "data"])

    return run


def _finder(opener: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FOUND_ROWS):
                some = batch.slice(at, FOUND_ROWS)
                found = [element_of(b"".join(p["data"] for p in pieces.as_py()), opener, 0 if first.as_py() else level, level)
                         for first, pieces in zip(some.column("first"), some.column("pieces"))]
                yield pa.RecordBatch.from_arrays(
                    [some.column("file"), some.column("number"), pa.array([k for k, _ in found], pa.binary()), pa.array([e for _, e in found], pa.binary())],
                    names=["file", "number", "key", "data"])

    return run


def read_elements(spark: SparkSession, path, opener: str, level: int, encoding: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file, encoding, key, pos, element): the elements of all arrays at a nesting of ``level`` in JSON documents, one a file.

    ``opener`` is { or [, what the elements start with; ``key`` names the array, ``pos`` is the place in it, from 0. A file is
    UTF-8 where all of it is valid, else Latin-1. Elements are given as text and not checked; empty files have none.
    """
    closer = {"{": "}", "[": "]"}[opener]
    held = chunks(spark, path, closer, chunk_bytes, states=True)
    # The state before every chunk: a row a chunk, without its data.
    order = Window.partitionBy("file").orderBy("start", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    states = held.select("file", "size", "start", "seq", "flips", "outside", "within", "valid", F.octet_length("data").alias("bytes")).select(
        "*", (F.row_number().over(order) - 1).cast("long").alias("number"),
        (F.coalesce(F.sum(F.col("flips").cast("long")).over(before), F.lit(0)) % 2 == 1).alias("inside"))
    grown = F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))
    states = stage(states.withColumn("grown", grown).select(
        "file", "size", "start", "seq", "number", "inside", F.coalesce(F.sum("grown").over(before), F.lit(0)).alias("depth"), "grown", "flips", "valid", "bytes"), "states")
    # A file that ends inside something is malformed; the bracket added behind a file that does not end in one does not count.
    added = (F.sum("bytes") > F.first("size")).cast("int")
    files = states.groupBy("file").agg(F.min("valid").alias("utf8"), (F.sum("grown") + added).alias("left"), (F.sum(F.col("flips").cast("int")) % 2).alias("open"))
    files = stage(files.select("file", "utf8", ((F.col("left") == 0) & (F.col("open") == 0)).alias("sound")), "files")
    bad = files.where("NOT sound").select("file").take(3)
    if bad:
        raise ValueError(f"malformed documents: {', '.join(r['file'] for r in bad)}")
    states = states.select("file", "start", "seq", "number", "inside", "depth")
    known = held.select("file", "start", "seq", "data").join(broadcast_if_small(states), ["file", "start", "seq"])
    known = known.select("file", "number", "data", "inside", F.col("depth").cast("long").alias("depth"))
    parts = stage(known.mapInArrow(_cutter(opener.encode(), closer.encode(), level), "file string, number long, i long, ends long, key binary, data binary"), "parts")

    # Ends up to each chunk, and for what is unfinished in a chunk the next one with an end.
    each = parts.where("i IS NULL").select("file", "number", "ends")
    upto = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("file").orderBy("number").rowsBetween(1, Window.unboundedFollowing)
    each = stage(each.select("file", "number", "ends", F.coalesce(F.sum("ends").over(upto), F.lit(0)).alias("before"),
                             F.min(F.when(F.col("ends") > 0, F.col("number"))).over(behind).alias("owner")), "ends")
    small = broadcast_if_small(each)
    pieces = parts.where("i IS NULL").select("file", "number", "data").join(small.select("file", "number", "owner"), ["file", "number"]).where("owner IS NOT NULL")
    pieces = pieces.unionByName(parts.where("i = 0").select("file", "number", "data", F.col("number").alias("owner")))
    gathered = pieces.groupBy("file", F.col("owner").alias("number")).agg(F.array_sort(F.collect_list(F.struct("number", "data"))).alias("pieces"))
    first = each.where("ends > 0").groupBy("file").agg(F.min("number").alias("first_end"))
    gathered = gathered.join(first, "file").select("file", "number", (F.col("number") == F.col("first_end")).alias("first"), "pieces")
    joined = gathered.mapInArrow(_finder(opener.encode(), level), "file string, number long, key binary, data binary")
    elements = parts.where("i > 0").select("file", "number", "i", "key", "data").unionByName(joined.withColumn("i", F.lit(0).cast("long")))

    # An element without a key in front is in the array of the last one that had.
    elements = elements.join(small.select("file", "number", "before"), ["file", "number"])
    run = F.when(F.col("key").isNotNull(), F.struct("key", (F.col("before") + F.col("i")).alias("at")))
    inside = Window.partitionBy("file", "number").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    elements = stage(elements.select("file", "number", "data", (F.col("before") + F.col("i")).alias("n"), "i", F.last(run, ignorenulls=True).over(inside).alias("run")), "elements")
    last = elements.groupBy("file", "number").agg(F.max_by("run", "i").alias("run"))
    carried = last.select("file", "number", F.last("run", ignorenulls=True).over(upto).alias("carried"))
    out = elements.join(broadcast_if_small(stage(carried, "carried")), ["file", "number"]).join(broadcast_if_small(files), "file")
    run, as_utf8 = F.coalesce("run", "carried"), F.col("utf8") if encoding is None else F.lit(encoding.lower() in ("utf-8", "utf8"))

    def text(data):
        return F.when(as_utf8, F.decode(data, "UTF-8")).otherwise(F.decode(data, encoding if encoding and encoding.lower() not in ("utf-8", "utf8") else "ISO-8859-1"))

    used = F.when(as_utf8, "utf-8").otherwise("latin-1") if encoding is None else F.lit(encoding.lower())
    raw = text(run["key"])
    key = F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>")[0]
    return out.select("file", used.alias("encoding"), F.when(F.contains(raw, F.lit("\\")), key).otherwise(raw).alias("key"),
                      (F.col("n") - run["at"]).alias("pos"), text(F.col("data")).alias("element"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, size, at, state = None, 0, 0, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64()), pa.array([state.hexdigest()])], names=["path", "length", "sha256"])

    for batch in batches:
        for here, length, data in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "data"))):
            if here != file:
                if file is not None:
                    yield done()
                file, size, at, state = here, length, 0, hashlib.sha256()
            data = data[:size - at]  # without the separator added behind the last piece
            state.update(data)
            at += len(data)
    if file is not None:
        yield done()


def checksums(spark: SparkSession, path, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, length, sha256) of files of any size: read in ranges, hashed in order, a chunk held at a time.

    The digest of one file is a chain, so one task hashes it, while all read; empty files have no row, as Spark's scans skip them.
    """
    held = chunks(spark, path, "\n", chunk_bytes).select("file", F.col("size").alias("length"), "start", "seq", "data")
    dealt = held.repartition("file").sortWithinPartitions("file", "start", "seq")
    return dealt.select("file", "length", "data").mapInArrow(_digested, "path string, length long, sha256 string")
