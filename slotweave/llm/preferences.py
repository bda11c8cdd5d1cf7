"""Preference formatting: what two conversations share is rendered once, what tells them apart twice.

The longest common prefix of turns of a chosen and a rejected conversation is the prompt; the turns after it are
the two completions, of which only the assistant's are trained on. The work is done turn by turn: a join on
(pair, place) finds where two conversations part, and offsets are running sums over blocks of turns, so a
conversation of any length is spread over tasks like any other rows and never gathered in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.session import stage
from slotweave.sources.ordinals import number_rows, number_sorted

BLOCK_TURNS = 1024
BLOCK_IDS = 512
TRAINED_ROLE = "assistant"

# How a turn is written: start, role, new line, text, end, new line.
START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """A turn as text; a null role or text is empty."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns by their place, from 0, in the order of turn numbers, then role and text.

    Turns without a number come behind those with one. Rows without conv_id are a conversation of their own. Rows that
    repeat a turn number get places of their own.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.col("turn").isNull().alias("late"))
    return number_sorted(rows, ["late", "turn", "role", "text"], ["conv_id"], out="place").select("conv_id", "place", "role", "text")


def _meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join on one column in which null meets null."""
    right = right.withColumnRenamed(key, "_key")
    return left.join(right, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns (pair_id, place, role, text) made of placed conversations.

    Chosen is each conversation as it is; rejected keeps the first half of its turns (rounded down) and goes on with
    the turns that the next conversation, by id, null first (after the last the first), has from there.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    order = stage(number_rows(sizes, ["conv_id"], [F.floor(F.col("conv_id") / BLOCK_IDS)], out="idx"), "order")
    many = order.count()
    follows = order.select(F.col("conv_id").alias("other"), F.pmod(F.col("idx") - 1, F.lit(max(1, many))).alias("idx"))
    pairs = stage(order.join(follows, "idx").select(
        F.col("conv_id").alias("pair_id"), F.floor(F.col("n") / 2).alias("half"), "other"), "pairs")
    chosen = turns.withColumnRenamed("conv_id", "pair_id")
    own = _meet(chosen, pairs.select("pair_id", "half"), "pair_id").where("place < half")
    rest = _meet(turns.withColumnRenamed("conv_id", "other"), pairs, "other").where("place >= half")
    columns = ["pair_id", "place", "role", "text"]
    return chosen.select(*columns), own.select(*columns).unionByName(rest.select(*columns))


def format_pairs(chosen: DataFrame, rejected: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(pair_id, part, place, role, content, start, length, trained): a row per rendered turn.

    ``part`` is prompt, chosen or rejected; ``start`` is the turn's first character in its part. Turns are the same
    when role and text are, nulls included. Equal conversations have a prompt only; where one ends inside the other
    its completion is empty. A pair with one side only has no prompt.
    """
    a, b = chosen.alias("a"), rejected.alias("b")
    on = F.col("a.pair_id").eqNullSafe(F.col("b.pair_id")) & (F.col("a.place") == F.col("b.place"))
    same = F.col("a.role").eqNullSafe(F.col("b.role")) & F.col("a.text").eqNullSafe(F.col("b.text"))
    missing = F.col("a.place").isNull() | F.col("b.place").isNull()
    parting = a.join(b, on, "full_outer").select(
        F.coalesce("a.pair_id", "b.pair_id").alias("pair_id"),
        F.when(missing | ~same, F.coalesce("a.place", "b.place")).alias("parts"))
    parting = stage(parting.groupBy("pair_id").agg(F.min("parts").alias("parts")), "parting")
    shared = F.col("parts").isNull() | (F.col("place") < F.col("parts"))

    def side(turns: DataFrame, name: str) -> DataFrame:
        return _meet(turns, parting, "pair_id").withColumn("part", F.when(shared, "prompt").otherwise(name)).drop("parts")

    rows = side(chosen, "chosen").unionByName(side(rejected, "rejected").where("part = 'rejected'"))
    rows = rows.select("pair_id", "part", "place", "role", rendered(F.col("role"), F.col("text")).alias("content"))
    rows = rows.withColumn("length", F.length("content").cast("long"))
    # Running sums: inside blocks of turns, and over the table of block sums.
    rows = rows.withColumn("block", F.floor(F.col("place") / BLOCK_TURNS))
    sums = rows.groupBy("pair_id", "part", "block").agg(F.sum("length").alias("size"))
    upto = Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pair_id", "part", "block", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pair_id", "part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed_rows = rows.withColumn("here", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in ("pair_id", "part", "block")], "before")
    same_block = F.col("pair_id").eqNullSafe(F.col("_pair_id")) & (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block"))
    placed_rows = placed_rows.join(sums, same_block)
    trained = (F.col("part") != "prompt") & F.coalesce(F.col("role") == trained_role, F.lit(False))
    return placed_rows.select(
        "pair_id", "part", "place", "role", "content", (F.col("before") + F.col("here")).alias("start"), "length",
        trained.alias("trained"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``format_pairs`` of the ``spliced`` pairs of a table (conv_id, turn, role, text); other columns are ignored."""
    turns = stage(placed(conversations), "turns")
    return format_pairs(*spliced(turns))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    content = f"'{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10)"
    return f"""WITH turns AS (SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn IS NULL, turn, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations),
sizes AS (SELECT conv_id, count(*) // 2 AS half, row_number() OVER (ORDER BY conv_id NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM turns GROUP BY conv_id),
convs AS (SELECT a.conv_id, a.half, b.conv_id AS other FROM sizes a JOIN sizes b ON b.i = (a.i + 1) % a.n),
chosen AS (SELECT conv_id AS pair_id, place, role, text FROM turns),
rejected AS (SELECT t.conv_id AS pair_id, place, role, text FROM turns t JOIN convs c ON t.conv_id IS NOT DISTINCT FROM c.conv_id WHERE place < half
  UNION ALL SELECT c.conv_id, place, role, text FROM turns t JOIN convs c ON t.conv_id IS NOT DISTINCT FROM c.other WHERE place >= half),
parting AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id,
  min(CASE WHEN a.place IS NULL OR b.place IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text THEN coalesce(a.place, b.place) END) AS parts
  FROM chosen a FULL JOIN rejected b ON a.pair_id IS NOT DISTINCT FROM b.pair_id AND a.place = b.place GROUP BY 1),
pieces AS (SELECT c.pair_id, CASE WHEN parts IS NULL OR place < parts THEN 'prompt' ELSE 'chosen' END AS part, place, role, {content} AS content
  FROM chosen c JOIN parting p ON c.pair_id IS NOT DISTINCT FROM p.pair_id
  UNION ALL SELECT r.pair_id, 'rejected', place, role, {content} FROM rejected r JOIN parting p ON r.pair_id IS NOT DISTINCT FROM p.pair_id WHERE place >= parts)
SELECT pair_id, part, place, role, content, coalesce(sum(length(content)) OVER (PARTITION BY pair_id, part ORDER BY place
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(content) AS length,
  part <> 'prompt' AND coalesce(role = '{TRAINED_ROLE}', false) AS trained FROM pieces"""
