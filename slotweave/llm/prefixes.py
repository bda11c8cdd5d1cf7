"""The trie of conversation prefixes, from sorted sequences and range minima of their longest common prefixes.

Equal conversations are one class, and classes are numbered in the order of their turns. Sequences of any length are
ranked without being gathered: blocks of a few turns get dense ranks, pairs of neighbouring ranks get ranks again, until one
is left. Going down the same levels gives the longest common prefix of two neighbouring classes. A node of the trie is
a class and a depth greater than what the class before shares: its members are the classes around it whose common
prefixes are never shorter. Each node finds the ends of that interval by itself, by binary descent in sparse tables of range
minima: inside its block of classes first, then among the minima of blocks. What a node says about its
subtree is then a difference of running sums, or a range minimum; no group of conversations is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.session import broadcast_if_small, stage
from slotweave.sources.ordinals import number_sorted

BLOCK_TURNS = 32  # turns ranked as one
BLOCK = 4096  # classes in a sparse table, members in a piece of a list of ids
SPAN = 1 << 16  # depths of one class that ask the same copy of a block
FAMILY, SHARED = 5, 9  # conversations that share their beginning, and the modulus of its length
NONE = hashlib.sha256(b"").hexdigest()


def _div(column: str | Column, by: int) -> Column:
    return F.call_function("div", F.col(column) if isinstance(column, str) else column, F.lit(by)).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, bytes): turns from 0 in the order of turn numbers, null first, equal ones by digest.

    The digest stands for role and text (null: empty), ``bytes`` is the text's length in UTF-8. Rows without
    a conv_id are no conversation's and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(key, 1, 16).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    return number_sorted(rows, ["turn", "key"], ["conv_id"], out="place").select("conv_id", "place", "key", "bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns whose first h are those of conversation c - c % family, and all conv_ids; h is crc32(c) % shared.

    Fewer turns there are all taken, and none where it is absent; c goes on with its own turns after its first h.
    """
    sizes = stage(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = sizes.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("given"))
    convs = stage(convs.join(bases, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("given", F.lit(0))).alias("taken")), "convs")
    first = turns.where(F.col("place") < shared - 1).withColumnRenamed("conv_id", "base")
    heads = first.join(convs.where("h > 0"), "base").where("place < h").select("conv_id", "place", "key", "bytes")
    own = turns.join(convs, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "key", "bytes")
    return stage(heads.unionByName(own), "rebuilt"), convs.select("conv_id")


def _ranked(df: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the dense ``rank`` of their columns, and the table of ranks."""
    ranks = stage(number_sorted(df.select(*columns).distinct(), columns, out="rank"), name)
    return df.join(ranks, columns), ranks


def classes_of(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, cls) of all conversations, and (cls, lcp) of all classes but the first.

    Classes are numbered in the order of their sequences; lcp is how many turns a class shares with the one before.
    """
    gathered = F.array_sort(F.collect_list(F.struct("place", "key")))
    blocks = turns.groupBy("conv_id", _div("place", BLOCK_TURNS).alias("b")).agg(F.transform(gathered, lambda t: t["key"]).alias("keys"))
    bare = ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    none = F.array().cast("array<binary>")
    blocks = stage(blocks.unionByName(bare.select("conv_id", F.lit(0).cast("long").alias("b"), none.alias("keys"))), "blocks")
    most = blocks.agg(F.max("b")).first()[0] or 0
    level, ground = _ranked(blocks, ["keys"], "ranks")
    level, pairs = stage(level.select("conv_id", "b", "rank"), "level"), []
    while most:
        side = lambda k: F.max(F.when(F.col("b") % 2 == k, F.col("rank")))
        two = level.groupBy("conv_id", _div("b", 2).alias("b")).agg(side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))
        level, ranks = _ranked(two, ["left", "right"], "ranks")
        level = stage(level.select("conv_id", "b", "rank"), "level")
        pairs.append(ranks)
        most //= 2

    # From the widest windows down: the first half where they differ, else the second.
    members = level.select("conv_id", F.col("rank").alias("cls"))
    after = (pairs[-1] if pairs else ground).where("rank > 0")
    now = after.select(F.col("rank").alias("cls"), (F.col("rank") - 1).alias("a"), F.col("rank").alias("z"), F.lit(0).cast("long").alias("same"))
    for k in range(len(pairs) - 1, -1, -1):
        for end in ("a", "z"):
            half = pairs[k].select(F.col("rank").alias(end), F.col("left").alias(f"{end}l"), F.col("right").alias(f"{end}r"))
            now = now.join(half, end, "left").fillna(-1, [f"{end}l", f"{end}r"])
        equal = F.col("al") == F.col("zl")
        now = stage(now.select("cls", F.when(equal, F.col("ar")).otherwise(F.col("al")).alias("a"), F.when(equal, F.col("zr")).otherwise(F.col("zl")).alias("z"),
                               (F.col("same") + F.when(equal, 1 << k).otherwise(0)).alias("same")), "descent")
    for end in ("a", "z"):
        now = now.join(ground.select(F.col("rank").alias(end), F.col("keys").alias(f"{end}k")), end, "left")
    short = F.least(F.coalesce(F.size("ak"), F.lit(0)), F.coalesce(F.size("zk"), F.lit(0)))
    differ = F.filter(F.sequence(F.lit(0), short - 1), lambda i: F.get("ak", i) != F.get("zk", i))
    inside = F.when(short <= 0, 0).otherwise(F.coalesce(F.array_min(differ), short))
    return members, now.select("cls", (F.col("same") * BLOCK_TURNS + inside).cast("long").alias("lcp"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of the 2^k values from each place on, for every k that fits."""
    out, width = [values], 1
    while 2 * width <= len(values):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out


def first_below(table: list[np.ndarray], start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """By binary descent, the first place from ``start`` on with a value below ``limit``; the number of values if none."""
    at, n = start.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        while True:  # the widest table may be used twice
            fits = at + (1 << k) <= n
            fits[fits] = table[k][at[fits]] >= limit[fits]
            if not fits.any():
                break
            at[fits] += 1 << k
    return at


def range_min(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value from ``low`` to ``high``, both included, of two overlapping powers of two."""
    k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=np.int64)
    for level in np.unique(k):
        some = k == level
        out[some] = np.minimum(table[level][low[some]], table[level][high[some] + 1 - (1 << int(level))])
    return out


def _search_block(table: list[np.ndarray], origin: int, at: np.ndarray, arg: np.ndarray) -> list[int | None]:
    found = first_below(table, at - origin, arg)
    return [None if f == len(table[0]) else f + origin for f in found.tolist()]


def _least_in_block(table: list[np.ndarray], origin: int, at: np.ndarray, arg: np.ndarray) -> list[int | None]:
    return range_min(table, at - origin, arg - origin).tolist()


def _answering(solve: Callable) -> Callable:
    """Answers queries of sorted (block, salt): the block's values come first, then its queries, as many as there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, values, table, origin = None, [], None, 0
        for batch in batches:
            block, salt, kind, at, arg, cls, depth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "salt", "kind", "at", "arg", "cls", "depth"))
            new = (np.diff(block) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (here := (block[a], salt[a])) != home:
                    home, values, table = here, [], None
                if kind[a] == 0:
                    if not values:
                        origin = int(at[a])
                    values.append(arg[a:b])
                    continue
                if table is None:
                    table = sparse_table(np.concatenate(values)) if values else None
                out = solve(table, origin, at[a:b], arg[a:b]) if table is not None else [None] * (b - a)
                yield pa.RecordBatch.from_arrays([pa.array(cls[a:b]), pa.array(depth[a:b]), pa.array(out, pa.int64())], names=["cls", "depth", "found"])

    return run


def _in_blocks(values: DataFrame, queries: DataFrame, solve: Callable, block: int) -> DataFrame:
    """(cls, depth, found) of queries (cls, depth, at, arg) about the block of values (pos, val) that ``at`` lies in."""
    asked = queries.select("cls", "depth", "at", "arg", _div("at", block).alias("block"), _div("depth", SPAN).alias("salt"))
    homes = asked.select("block", "salt").distinct()
    zero = F.lit(0).cast("long")
    held = values.select(F.col("pos").alias("at"), F.col("val").alias("arg"), _div("pos", block).alias("block")).join(homes, "block")
    both = held.select("block", "salt", F.lit(0).alias("kind"), "at", "arg", zero.alias("cls"), zero.alias("depth")).unionByName(
        asked.select("block", "salt", F.lit(1).alias("kind"), "at", "arg", "cls", "depth"))
    dealt = both.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "at")
    return stage(dealt.mapInArrow(_answering(solve), "cls long, depth long, found long"), "answers")


def _minima(values: DataFrame, block: int) -> DataFrame:
    return stage(values.groupBy(_div("pos", block).alias("pos")).agg(F.min("val").alias("val")), "minima")


def search(values: DataFrame, n: int, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cls, depth, found): the first position from ``at`` on whose value is below ``arg``, null if there is none.

    Answered inside the block of ``at``, else by a search among the minima of the blocks behind it and then inside the one found.
    """
    inside = _in_blocks(values, queries, _search_block, block)
    if n <= block:
        return inside
    still = inside.where("found IS NULL").select("cls", "depth").join(queries, ["cls", "depth"])
    above = search(_minima(values, block), -(-n // block), still.select("cls", "depth", (_div("at", block) + 1).alias("at"), "arg"), block)
    down = above.where("found IS NOT NULL").join(queries.select("cls", "depth", "arg"), ["cls", "depth"])
    below = _in_blocks(values, down.select("cls", "depth", (F.col("found") * block).alias("at"), "arg"), _search_block, block)
    return inside.where("found IS NOT NULL").unionByName(above.where("found IS NULL")).unionByName(below)


def least(values: DataFrame, n: int, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cls, depth, found): the least value at positions ``at`` to ``arg``, from the ends' blocks and the blocks between."""
    first, last = _div("at", block), _div("arg", block)
    one = queries.where(first == last)
    apart = queries.where(first < last)
    ends = apart.select("cls", "depth", "at", ((first + 1) * block - 1).alias("arg")).unionByName(apart.select("cls", "depth", (last * block).alias("at"), "arg"))
    out = _in_blocks(values, one.unionByName(ends), _least_in_block, block)
    if n > 2 * block:
        between = apart.where(last - first > 1).select("cls", "depth", (first + 1).alias("at"), (last - 1).alias("arg"))
        out = out.unionByName(least(_minima(values, block), -(-n // block), between, block))
    return out.groupBy("cls", "depth").agg(F.min("found").alias("found"))


def _running(df: DataFrame, order: str, columns: list[str], parts: list[str], size: int, back: bool = False) -> DataFrame:
    """Rows with ``upto_<column>``: sums up to and with the row (from it on, if ``back``), by blocks of bounded size."""
    tagged = df.withColumn("_block", _div(order, size))
    sums = tagged.groupBy(*parts, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    way = F.col("_block").desc() if back else F.col("_block")
    before = Window.partitionBy(*parts).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*parts, "_block", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*parts, "_block").orderBy(F.col(order).desc() if back else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    here = tagged.select("*", *[F.sum(c).over(inside).alias(f"_here_{c}") for c in columns])
    out = here.join(sums, [*parts, "_block"])
    return out.select(*df.columns, *[(F.col(f"_here_{c}") + F.col(f"_{c}")).alias(f"upto_{c}") for c in columns])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each class' list of ids from its pieces in order; one piece is held at a time."""
    def done():
        return pa.RecordBatch.from_arrays([pa.array([cls], pa.int64()), pa.array([state.hexdigest()])], names=["cls", "ends_sha256"])

    cls, state = None, None
    for batch in batches:
        for here, text in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist()):
            if here != cls:
                if cls is not None:
                    yield done()
                cls, state = here, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if cls is not None:
        yield done()


def _member_digests(members: DataFrame, classes: DataFrame, piece: int = BLOCK) -> DataFrame:
    """(cls, ends_sha256): the SHA-256 of the members' ids in order, joined by commas."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    large = broadcast_if_small(stage(classes.where(F.col("n") > piece).select("cls"), "large"))
    small = members.join(large, "cls", "left_anti").groupBy("cls").agg(F.sha2(joined, 256).alias("ends_sha256"))
    ordered = number_sorted(members.join(large, "cls", "left_semi"), ["conv_id"], ["cls"], out="idx")
    pieces = ordered.groupBy("cls", _div("idx", piece).alias("piece")).agg(joined.alias("text"))
    pieces = pieces.repartition("cls").sortWithinPartitions("cls", "piece")
    return small.unionByName(pieces.mapInArrow(_hashed, "cls long, ends_sha256 string"))


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, place, key, bytes)``, places from 0 without gaps, and of all ``ids(conv_id)``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per distinct prefix, the empty one
    included. Conversations without turns end at the root; without conversations there are no nodes.
    """
    members, lcps = classes_of(turns, ids)
    members = stage(members, "members")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    classes = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    classes = classes.join(sizes, "conv_id", "left").join(lcps, "cls", "left").select(
        "cls", "conv_id", "n", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("lcp", F.lit(-1)).alias("lcp"))
    classes = stage(classes, "classes")
    after = classes.select((F.col("cls") - 1).alias("cls"), F.col("lcp").alias("next"))
    classes = classes.join(after, "cls", "left").fillna(-1, ["next"]).withColumn("leaf", (F.col("next") < F.col("len")).cast("long"))
    classes = stage(_running(classes, "cls", ["n", "leaf"], [], block), "classes")
    n = classes.count()

    # Candidates: what a class does not share with the one before. Its first and last members are found each on their own.
    own = classes.select("conv_id", "cls", "lcp", "next", "len", "n", "leaf", "upto_n", "upto_leaf")
    nodes = turns.join(own, "conv_id").where(F.col("place") >= F.col("lcp")).withColumn("depth", F.col("place") + 1).drop("place", "key")
    root = own.where("cls = 0").select("*", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("depth"))
    nodes = stage(nodes.unionByName(root.select(*nodes.columns)), "nodes")
    shared = nodes.where("depth <= next")
    right = shared.select("cls", "depth", (F.col("cls") + 1).alias("at"), F.col("depth").alias("arg"))
    lasts = search(classes.select(F.col("cls").alias("pos"), F.col("lcp").alias("val")), n, right, block)
    lasts = stage(lasts.select("cls", "depth", F.coalesce(F.col("found") - 1, F.lit(n - 1)).alias("last")), "lasts")
    # The parent of a class' first node starts at the last class before that shares less; mirrored, a search to the right.
    mirror = lambda c: F.lit(n - 1) - F.col(c)
    left = classes.where("cls > 0").select("cls", F.col("lcp").alias("depth"), mirror("cls").alias("at"), F.col("lcp").alias("arg"))
    firsts = search(classes.select(mirror("cls").alias("pos"), F.col("lcp").alias("val")), n, left, block)
    firsts = stage(firsts.select("cls", "depth", mirror("found").alias("parent")), "firsts")

    lowest = least(classes.select(F.col("cls").alias("pos"), F.col("conv_id").alias("val")), n,
                   lasts.select("cls", "depth", F.col("cls").alias("at"), F.col("last").alias("arg")), block)
    upto = classes.select(F.col("cls").alias("last"), F.col("upto_n").alias("last_n"), F.col("upto_leaf").alias("last_leaf"))
    wide = shared.drop("conv_id").join(lasts, ["cls", "depth"]).join(lowest, ["cls", "depth"]).withColumnRenamed("found", "conv_id").join(upto, "last")
    alone = nodes.where("depth > next").select("*", F.col("cls").alias("last"), F.col("upto_n").alias("last_n"), F.col("upto_leaf").alias("last_leaf"))
    nodes = alone.unionByName(wide).select(
        "cls", "depth", "conv_id", "bytes", "lcp", "next", "len", "last", (F.col("last_n") - F.col("upto_n") + F.col("n")).alias("n_convs"),
        (F.col("last_leaf") - F.col("upto_leaf") + F.col("leaf")).alias("n_leaves"))
    nodes = stage(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")

    # Savings of a subtree: of the classes behind the first, and of the first from this depth on.
    own_saved = _running(nodes, "depth", ["saved"], ["cls"], block, back=True)
    totals = classes.select("cls").join(nodes.groupBy("cls").agg(F.sum("saved").alias("all")), "cls", "left").fillna(0, ["all"])
    totals = stage(_running(totals, "cls", ["all"], [], block), "totals").select("cls", "upto_all")
    ends = totals.select(F.col("cls").alias("last"), F.col("upto_all").alias("last_all"))
    zero = F.lit(0).cast("long")
    more = own_saved.where("last > cls").join(totals, "cls").join(ends, "last").withColumn("others", F.col("last_all") - F.col("upto_all")).drop("upto_all", "last_all")
    summed = own_saved.where("last = cls").withColumn("others", zero).unionByName(more)

    # Children: one that goes on in the class itself, and the classes that part here.
    parts = firsts.groupBy(F.col("parent").alias("cls"), "depth").agg(F.count("*").alias("parting"))
    summed = stage(summed.join(parts, ["cls", "depth"], "left"), "summed")
    # The parent is in the class too, but for a class' first node.
    up = summed.join(firsts.select("cls", (F.col("depth") + 1).alias("depth"), "parent"), ["cls", "depth"], "left")
    known = (F.col("depth") - 1 > F.col("lcp")) & (F.col("depth") - 1 > F.col("next"))
    plain = up.where(known & (F.col("depth") > 0)).withColumn("parent_conv_id", F.col("conv_id")).drop("parent")
    top = up.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).drop("parent")
    names = summed.select(F.col("cls").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    asked = up.where(~known & (F.col("depth") > 0)).withColumn("parent", F.coalesce("parent", "cls")).join(names, ["parent", "depth"], "left").drop("parent")
    out = plain.unionByName(top).unionByName(asked)

    digests = _member_digests(members, classes)
    ending = F.when(F.col("depth") == F.col("len"), F.col("cls"))
    out = out.withColumn("ending", ending).join(digests.withColumnRenamed("cls", "ending"), "ending", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        (F.coalesce("parting", zero) + (F.col("len") > F.col("depth")).cast("long")).alias("n_children"), "n_leaves",
        (F.col("others") + F.col("upto_saved")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the ``rebuilt`` conversations of a table (conv_id, turn, role, text); other columns are ignored.

    Null roles and texts are empty; rows that repeat a turn number keep places of their own.
    """
    return trie(*rebuilt(stage(numbered(conversations), "turns")))


def oracle() -> str:
    """The same in DuckDB's SQL, by grouping every prefix of every conversation."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, {step}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
rows AS (SELECT conv_id, turn, coalesce(text, '') AS text, substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, text, key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS place FROM rows),
convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
takes AS (SELECT c.conv_id, c.base, h, least(h, count(t.place)) AS taken FROM convs c LEFT JOIN turns t ON t.conv_id = c.base GROUP BY c.conv_id, c.base, h),
built AS (SELECT c.conv_id, place, text, key FROM takes c JOIN turns t ON t.conv_id = c.base AND place < h
  UNION ALL SELECT c.conv_id, place - h + taken, text, key FROM takes c JOIN turns t ON t.conv_id = c.conv_id AND place >= h),
paths AS (SELECT conv_id, place + 1 AS depth, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY place) AS path, strlen(text) AS bytes FROM built
  UNION ALL SELECT conv_id, 0, '', 0 FROM takes),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest
  FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path),
nodes AS (SELECT path, depth, left(path, 32 * (depth - 1)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM paths GROUP BY path, depth),
kids AS (SELECT up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
below AS (SELECT left(s.path, 32 * i) AS path, saved, (kids.n IS NULL)::BIGINT AS leaf FROM (SELECT path, saved, unnest(range(0, depth + 1)) AS i FROM nodes) s
  LEFT JOIN kids ON kids.path = s.path),
subtrees AS (SELECT path, sum(saved) AS saved, sum(leaf) AS leaves FROM below GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves::BIGINT AS n_leaves,
  subtrees.saved::BIGINT AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes n JOIN subtrees USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.up LEFT JOIN kids ON kids.path = n.path LEFT JOIN ends ON ends.path = n.path"""
