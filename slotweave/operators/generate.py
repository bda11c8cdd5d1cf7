"""Slot-substitution generation.

Every example is a mixed-radix counter: slot i has the values of its kind, the last slot runs fastest.
The counter is cut inside the slot behind which at most CHUNK combinations lie: a chunk is one combination of the slots before,
as many values of that slot as still fit, and all of the slots after it. Ranges of chunks are spread over the cluster and multiplied
out there, chunk by chunk: no task holds more than CHUNK texts of an example at a time, however many combinations
the example or values the slot has.

Removing repeated texts inside an example needs no shuffle of generated rows: a combination is kept
exactly when it is the first one that spells its text, which the row can decide by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from slotweave.functions import annotation as A
from slotweave.functions import text as X
from slotweave.operators.splits import flag_heldout
from slotweave.operators.vocab import vocabulary_arrays
from slotweave.session import stage
from slotweave.sources.ordinals import BUCKET_ROWS

CHUNK = 1024
# Strides and capped totals stop here, far below the bigint limit, so one more product cannot overflow. An example
# with as many combinations is expanded only under a cap; without one it is an error.
MANY = 2**40

# Generated rows a task should make; the number of tasks follows from the expected output.
ROWS_PER_TASK = 2_000_000
# Chunks in a range, which one task multiplies out, and ranges counted out of one row.
RANGE = 64
RANGES = 4096

_SLOTS = "array<struct<lit:string,cands:array<string>,stride:bigint>>"


# A vocabulary up to this many values and characters is sent to every task as one map per source.
SMALL_VALUES = 100_000
SMALL_CHARS = 4_000_000


def is_small(vocabulary: DataFrame) -> bool:
    """Check the size of a (staged) vocabulary."""
    size = vocabulary.agg(F.count("*").alias("n"), F.sum(F.char_length("value") + F.char_length("kind")).alias("c")).first()
    return size["n"] <= SMALL_VALUES and (size["c"] or 0) <= SMALL_CHARS


def attach_candidates(examples: DataFrame, vocabulary: DataFrame, small: bool | None = None) -> DataFrame:
    """Give each example a map kind -> candidate values.

    A small vocabulary is one map per source and joins in place. A large one is joined by kind: Spark
    picks the join by run-time size, an over-long kind partition is split by adaptive execution, and
    rows are brought together again by a number of their own, so both ways give the same rows, repeated ids and rows
    without slots included.
    """
    arrays = vocabulary_arrays(vocabulary)
    small = is_small(vocabulary) if small is None else small
    if small:
        maps = arrays.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("kind", "vals"))).alias("cands"))
        joined = examples.join(F.broadcast(maps), "source", "left")
        empty = F.from_json(F.lit("{}"), "map<string,array<string>>")
        return joined.withColumn("cands", F.coalesce("cands", empty))
    kinds = F.array_distinct(F.filter(F.transform("parts", lambda p: p["kind"]), lambda k: k.isNotNull()))
    numbered = stage(examples.withColumn("_no", F.monotonically_increasing_id()), "numbered")
    exploded = numbered.select("_no", "source", F.explode(kinds).alias("kind"))
    matched = exploded.join(arrays, ["source", "kind"])
    found = matched.groupBy("_no").agg(F.map_from_entries(F.collect_list(F.struct("kind", "vals"))).alias("cands"))
    empty = F.from_json(F.lit("{}"), "map<string,array<string>>")
    joined = numbered.join(found, "_no", "left").withColumn("cands", F.coalesce("cands", empty))
    return joined.select(*examples.columns, "cands")


def _sizes(parts: Column, cands: Column) -> Column:
    """Choices per part: 1 for literals, 0 for kinds the vocabulary lacks."""
    return F.transform(
        parts,
        lambda p: F.when(p["kind"].isNull(), F.lit(1)).otherwise(
            F.coalesce(F.size(F.try_element_at(cands, p["kind"])), F.lit(0))
        ).cast("bigint"),
    )


def _product(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1).cast("bigint"), lambda a, n: F.least(a * n, F.lit(MANY)))


def combination_count(parts: Column, cands: Column) -> Column:
    """Combinations of one example before any cap, exactly; more than 38 digits are an error."""
    kind = "decimal(38,0)"
    return F.aggregate(_sizes(parts, cands), F.lit(1).cast(kind), lambda a, n: (a * n.cast(kind)).cast(kind))


def plan_examples(examples: DataFrame, vocabulary: DataFrame, cap: int | None = None,
                  unknown_slot: str = "error", small: bool | None = None) -> DataFrame:
    """Resolve candidates, strides and counts; one row per example."""
    if cap is not None and cap < 1:
        raise ValueError("cap must be positive")
    rows = attach_candidates(examples, vocabulary, small)
    sizes = _sizes(F.col("parts"), F.col("cands"))
    rows = rows.withColumn("_sizes", sizes).withColumn("combinations", _product(F.col("_sizes")))
    slots = F.transform(
        "parts",
        lambda p, i: F.struct(
            F.when(p["kind"].isNull(), p["value"]).alias("lit"),
            F.when(p["kind"].isNotNull(), F.try_element_at(F.col("cands"), p["kind"])).alias("cands"),
            _product(F.slice("_sizes", i + 2, F.size("_sizes"))).alias("stride"),
        ),
    ).cast(_SLOTS)
    too_many = F.raise_error(F.concat(F.lit("too many combinations without a cap: "), F.col("utterance"))).cast("bigint")
    total = F.when(F.col("combinations") < MANY, F.col("combinations")).otherwise(too_many) if cap is None else F.least(
        F.col("combinations"), F.lit(cap))
    if unknown_slot == "error":
        missing = F.raise_error(F.concat(F.lit("slot kind without vocabulary in "), F.col("utterance"))).cast("bigint")
        total = F.when(F.col("combinations") == 0, missing).otherwise(total)
    elif unknown_slot != "original_only":
        raise ValueError("unknown_slot must be 'error' or 'original_only'")
    truncated = F.lit(False) if cap is None else F.col("combinations") > cap
    return rows.select(
        *[c for c in rows.columns if c not in ("cands", "_sizes")],
        slots.alias("slots"), total.alias("total"), truncated.alias("truncated"),
    )


def spell(slots: Column, idx: Column) -> Column:
    """Text of combination ``idx``."""
    return F.array_join(
        F.transform(
            slots,
            lambda s: F.when(s["cands"].isNull(), s["lit"]).otherwise(
                F.get(s["cands"], (X.int_div(idx, s["stride"]) % F.size(s["cands"])).cast("int"))
            ),
        ),
        "",
    )


def _deepest_rank(slots: Column, idx: Column) -> Column:
    """Largest 1-based vocabulary rank a combination uses; 0 without slots."""
    return F.aggregate(
        slots,
        F.lit(0).cast("bigint"),
        lambda a, s: F.when(s["cands"].isNull(), a).otherwise(
            F.greatest(a, X.int_div(idx, s["stride"]) % F.size(s["cands"]) + 1)
        ),
    )


def may_collide(slots: Column) -> Column:
    """Whether two combinations could spell the same text.

    They can only part at a slot (not the last one) whose value w extends to another value v = w + u
    with u and the following literal prefixes of one another. An empty literal always allows it.
    """
    last = F.size(slots) - 1

    def risky(s, i):
        following = F.coalesce(F.get(slots, i + 1)["lit"], F.lit(""))
        extends = F.exists(
            s["cands"],
            lambda w: F.exists(
                s["cands"],
                lambda v: (v != w)
                & F.startswith(v, w)
                & (
                    F.startswith(F.substr(v, F.char_length(w) + 1), following)
                    | F.startswith(following, F.substr(v, F.char_length(w) + 1))
                ),
            ),
        )
        return F.when(s["cands"].isNull() | (i == last), F.lit(False)).otherwise(extends)

    return F.exists(F.transform(slots, risky), lambda b: b)


def spellings(slots: Column, text: Column) -> Column:
    """How ``text`` can be spelled: struct(idx of the first combination, depth of the shallowest one).

    Walks the slots keeping one state per text position reachable so far. States stay in index order,
    so the first one at a position has the smallest index; the depth (deepest rank used) is minimised
    on its own.
    """
    state = "array<struct<at:int,idx:bigint,depth:bigint>>"
    zero = F.lit(0).cast("bigint")
    start = F.array(F.struct(F.lit(1).alias("at"), zero.alias("idx"), zero.alias("depth"))).cast(state)

    def step(states, s):
        options = F.coalesce(s["cands"], F.array(s["lit"]))
        free = s["cands"].isNotNull()
        moved = F.flatten(
            F.transform(
                states,
                lambda st: F.filter(
                    F.transform(
                        options,
                        lambda c, j: F.when(
                            F.substr(text, st["at"], F.char_length(c)) == c,
                            F.struct(
                                (st["at"] + F.char_length(c)).alias("at"),
                                (st["idx"] + j.cast("bigint") * s["stride"]).alias("idx"),
                                F.when(free, F.greatest(st["depth"], j.cast("bigint") + 1))
                                .otherwise(st["depth"])
                                .alias("depth"),
                            ),
                        ),
                    ),
                    lambda m: m.isNotNull(),
                ),
            )
        ).cast(state)

        def absorb(kept, m):
            lowered = F.transform(
                kept,
                lambda k: F.struct(
                    k["at"].alias("at"),
                    k["idx"].alias("idx"),
                    F.when(k["at"] == m["at"], F.least(k["depth"], m["depth"])).otherwise(k["depth"]).alias("depth"),
                ),
            ).cast(state)
            known = F.exists(kept, lambda k: k["at"] == m["at"])
            return F.when(known, lowered).otherwise(F.concat(kept, F.array(m)).cast(state))

        return F.aggregate(moved, F.array().cast(state), absorb)

    ends = F.aggregate(slots, start, step)
    return F.get(F.filter(ends, lambda e: e["at"] == F.char_length(text) + 1), F.lit(0))


def task_count(planned: DataFrame) -> int:
    """Tasks for the expansion, from the rows it will make: a session's shuffle setting is tuned to
    inputs, and the output may be hundreds of times larger."""
    expected = planned.agg(F.sum((F.col("total") + 1).cast("double")).alias("rows")).first()["rows"] or 0.0
    least = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(expected / ROWS_PER_TASK))


def _cut(planned: DataFrame) -> DataFrame:
    """Where each example's counter is cut: ``_place`` of the slot, ``_block`` combinations behind it, ``_wide`` of its values a chunk.

    As many slots as have at most CHUNK combinations together lie behind the cut; of the slot at the cut, which may have any
    number of values, a chunk takes as many as still fit.
    """
    slots, one = F.col("slots"), F.lit(1).cast("bigint")
    strides = F.concat(F.transform(slots, lambda s: s["stride"]), F.array("combinations"))
    block = F.coalesce(F.array_max(F.filter(strides, lambda x: (x >= 1) & (x <= CHUNK))), one)
    rows = planned.withColumn("_block", block)
    place = F.coalesce(F.array_position(F.transform(slots, lambda s: F.coalesce(s["cands"].isNotNull() & (s["stride"] == F.col("_block")), F.lit(False))), True), F.lit(0))
    rows = rows.withColumn("_place", place.cast("int")).withColumn("_wide", F.greatest(X.int_div(F.lit(CHUNK).cast("bigint"), F.col("_block")), one))
    values = F.when(F.col("_place") > 0, F.size(F.get(slots, F.col("_place") - 1)["cands"])).otherwise(1)
    rows = rows.withColumn("_values", F.greatest(values.cast("bigint"), one))
    # Chunks of one turn of the slot at the cut, and of all; a cap may end inside a turn.
    turn, size = F.col("_block") * F.col("_values"), F.col("_block") * F.col("_wide")
    rows = rows.withColumn("_parts", X.int_div(F.col("_values") + F.col("_wide") - 1, F.col("_wide")))
    rest = F.col("total") - X.int_div(F.col("total"), turn) * turn
    chunks = X.int_div(F.col("total"), turn) * F.col("_parts") + X.int_div(rest + size - 1, size)
    return rows.withColumn("_chunks", F.greatest(chunks, one))


def _ranges(count: Column, size: int, name: str) -> Column:
    """0, 1, ... for each ``size`` of ``count`` things."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), X.int_div(count - 1, F.lit(size).cast("bigint")))).alias(name)


def _inside(number: Column, count: Column, size: int, name: str) -> Column:
    """The things of range ``number``."""
    return F.explode(F.sequence(number * size, F.least(number * size + size, count) - 1)).alias(name)


def expand(planned: DataFrame, with_depth: bool = False, partitions: int | None = None) -> DataFrame:
    """Original first (variant 0), then the distinct products in order (variant = index + 1).

    ``with_depth`` adds the smallest depth k at which the text appears; 0 for originals. Chunks are counted out as a tree: ranges
    of ranges, ranges, which are dealt over the tasks, and the chunks of a range; no row holds more than a level of it.
    """
    n = partitions or task_count(planned)
    slots = F.col("slots")
    sized = _cut(planned.withColumn("_risky", may_collide(slots)))
    ranges = X.int_div(F.col("_chunks") + RANGE - 1, F.lit(RANGE).cast("bigint"))
    dealt = sized.withColumn("_ranges", ranges).select("*", _ranges(F.col("_ranges"), RANGES, "_far"))
    dealt = dealt.select("*", _inside(F.col("_far"), F.col("_ranges"), RANGES, "_near")).drop("_far", "_ranges")
    spread = dealt.repartition(n, "source", "ex_id", "_near").select("*", _inside(F.col("_near"), F.col("_chunks"), RANGE, "_chunk"))
    lead, part = X.int_div(F.col("_chunk"), F.col("_parts")), F.col("_chunk") % F.col("_parts")
    spread = spread.withColumn("_from", part * F.col("_wide")).withColumn(
        "_first", lead * F.col("_block") * F.col("_values") + F.col("_from") * F.col("_block"))
    spelt = spread.withColumn("_t", F.explode(_chunk_texts(with_depth)))
    original = F.col("_t.variant") == 0
    spelt = spelt.filter(original | (F.col("_t.text") != F.col("utterance"))).withColumn(
        "_ways", F.when(F.col("_risky") & ~original, spellings(slots, F.col("_t.text")))
    )
    kept = spelt.filter(F.col("_ways").isNull() | (F.col("_ways.idx") + 1 == F.col("_t.variant")))
    extra = [F.coalesce(F.col("_ways.depth"), F.col("_t.depth")).alias("depth")] if with_depth else []
    carried = [c for c in planned.columns if c not in ("slots", "total", "utterance", "parts")]
    return kept.select(*carried, F.col("_t.variant").alias("variant"), F.col("_t.text").alias("utterance"), *extra)


def _chunk_texts(with_depth: bool) -> Column:
    """Texts of one chunk row, as structs (variant, text, depth); the first chunk starts with the original.

    The generator spells them, not a projection: a filter behind a projection would spell them twice.
    """
    slots, first, place, zero = F.col("slots"), F.col("_first"), F.col("_place"), F.lit(0).cast("bigint")
    lead = F.slice(slots, F.lit(1), F.greatest(place - 1, F.lit(0)))
    tail = F.slice(slots, place + 1, F.greatest(F.size(slots), F.lit(1)))
    at_cut = F.slice(F.get(slots, place - 1)["cands"], (F.col("_from") + 1).cast("int"), F.col("_wide").cast("int"))

    def text(value, depth):
        fields = [value.alias("text")] + ([depth.alias("depth")] if with_depth else [])
        return F.struct(*fields)

    def depth_of(a):
        return a["depth"] if with_depth else zero

    def multiply(acc, s):
        grown = F.flatten(
            F.transform(
                acc,
                lambda a: F.transform(
                    s["cands"],
                    lambda c, j: text(F.concat(a["text"], c), F.greatest(depth_of(a), j.cast("bigint") + 1)),
                ),
            )
        )
        fixed = F.transform(acc, lambda a: text(F.concat(a["text"], s["lit"]), depth_of(a)))
        return F.when(s["cands"].isNull(), fixed).otherwise(grown)

    before, deepest = spell(lead, first), _deepest_rank(lead, first)
    values = F.transform(at_cut, lambda c, j: text(F.concat(before, c), F.greatest(deepest, F.col("_from") + j.cast("bigint") + 1)))
    start = F.when(place > 0, values).otherwise(F.array(text(before, deepest)))
    here = F.least(F.col("_wide") * F.col("_block"), F.col("total") - first)
    products = F.slice(F.aggregate(tail, start, multiply), F.lit(1), here.cast("int"))

    def numbered(t, i):
        fields = [(first + i.cast("bigint") + 1).alias("variant"), t["text"].alias("text")]
        return F.struct(*fields, *([t["depth"].alias("depth")] if with_depth else []))

    originals = F.struct(zero.alias("variant"), F.col("utterance").alias("text"), *([zero.alias("depth")] if with_depth else []))
    own = F.transform(products, numbered)
    none = F.slice(F.array(originals), 1, 0)
    own = F.when(F.col("total") > 0, own).otherwise(none)
    return F.when(first == 0, F.concat(F.array(originals), own)).otherwise(own)


def generate(examples: DataFrame, vocabulary: DataFrame, cap: int | None = None,
             unknown_slot: str = "error", commas: str = "keep", small: bool | None = None) -> DataFrame:
    """(source, ex_id, ..., variant, utterance, pattern) for every example.

    Examples need: source, ex_id, utterance, parts; other columns are carried along.
    """
    ready = examples.withColumn("pattern", A.parts_to_pattern(F.col("parts")))
    out = expand(plan_examples(ready, vocabulary, cap, unknown_slot, small))
    if commas == "space":
        return out.withColumns({c: X.commas_to_spaces(F.col(c)) for c in ("utterance", "pattern")})
    if commas != "keep":
        raise ValueError("commas must be 'keep' or 'space'")
    return out


def originals_only(examples: DataFrame) -> DataFrame:
    """Depth 0: no substitution."""
    return examples.select(
        *[c for c in examples.columns if c != "parts"],
        F.lit(0).cast("bigint").alias("variant"), A.parts_to_pattern(F.col("parts")).alias("pattern"),
    )


def retain_groups(rows: DataFrame, retain: str = "all", rank: str = "label_rank") -> DataFrame:
    """``last`` keeps only the last label group of each source, as the historic writer did."""
    if retain == "all":
        return rows
    if retain != "last":
        raise ValueError("retain must be 'all' or 'last'")
    last = rows.groupBy("source").agg(F.max(rank).alias(rank))
    return rows.join(last, ["source", rank], "left_semi")


def size_estimate(examples: DataFrame, vocabulary: DataFrame, parts: list[str]) -> DataFrame:
    """Upper bound of generated rows before generating anything."""
    rows = attach_candidates(examples, vocabulary)
    return rows.groupBy(*parts).agg(
        F.count("*").alias("examples"),
        F.sum(combination_count(F.col("parts"), F.col("cands"))).alias("combinations"),
    )


def depth_sweep(examples: DataFrame, vocabulary: DataFrame, depths: list[int], parts: list[str],
                unknown_slot: str = "error") -> DataFrame:
    """Rows per part for every depth k, from one generation at the deepest k.

    The top-k lists are prefixes of one another: a combination exists at depth k exactly when no rank
    it uses exceeds k. A text spelled by several combinations counts from the shallowest one.
    """
    ready = examples.withColumn("pattern", A.parts_to_pattern(F.col("parts")))
    planned = plan_examples(ready, vocabulary.filter(F.col("rank") <= max(depths)), None, unknown_slot)
    by_depth = expand(planned, with_depth=True).groupBy(*parts, "depth").agg(F.count("*").alias("n"))
    reached = by_depth.select(
        *parts, "n", F.explode(F.array(*[F.lit(k) for k in sorted(depths)])).alias("k"), "depth"
    ).filter(F.col("depth") <= F.col("k"))
    return reached.groupBy(*parts, "k").agg(F.sum("n").alias("rows"))


def generation_report(generated: DataFrame, keys: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per-source counts of one generation pass; ``generated`` is the unfiltered output."""
    flagged = flag_heldout(generated, keys, scope=scope)
    return flagged.groupBy("source").agg(
        F.count_if(F.col("variant") == 0).alias("train_examples"),
        F.count_if(~F.col("held")).alias("output_rows"),
        F.count_if(F.col("held")).alias("removed_rows"),
        F.count_if((F.col("variant") == 0) & F.col("truncated")).alias("truncated_examples"),
    )


def manifest(flagged: DataFrame, keys: DataFrame, vocabulary: DataFrame, ks: dict[str, int], cap: int | None = None,
             scope: list[str] | None = None) -> DataFrame:
    """Provenance per declared source, from a generation with its ``held`` flag (``flag_heldout``).

    status, top_k, cap, train examples, output, removed and truncated counts, held-out keys, vocabulary values and
    a digest of the vocabulary. A source that gave no rows is there as missing.
    """
    spark = flagged.sparkSession
    settings = spark.createDataFrame([(s, k, cap) for s, k in ks.items()], "source string, top_k int, cap int")
    counts = flagged.groupBy("source").agg(
        F.count_if(F.col("variant") == 0).alias("train_examples"), F.count_if(~F.col("held")).alias("output_rows"),
        F.count_if(F.col("held")).alias("removed_rows"),
        F.count_if((F.col("variant") == 0) & F.col("truncated")).alias("truncated_examples"))
    per_kind = vocabulary.groupBy("source", "kind").agg(
        F.count("*").alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "value")))), 256).alias("h"))  # k values
    words = per_kind.groupBy("source").agg(
        F.sum("n").alias("vocabulary_values"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "h")))), 256).alias("vocabulary_sha256"))
    scoped = "source" in (scope or [])
    held = keys.groupBy("source").agg(F.count("*").alias("heldout_keys")) if scoped else keys.agg(F.count("*").alias("heldout_keys"))
    out = settings.join(counts, "source", "left").join(words, "source", "left")
    out = out.join(held, "source", "left") if scoped else out.withColumn("heldout_keys", held.scalar())
    numbers = ["train_examples", "output_rows", "removed_rows", "truncated_examples", "heldout_keys", "vocabulary_values"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers})
    return out.withColumn("status", F.when(F.col("output_rows") > 0, "prepared").otherwise("missing"))


def observed_output(generated: DataFrame, keys: DataFrame, sources: list[str],
                    scope: list[str] | None = None) -> tuple[DataFrame, Observation]:
    """The output plus its report as an observation: both come out of the same write."""
    flagged = flag_heldout(generated, keys, scope=scope)
    seen = Observation("generation")
    metrics = []
    for s in sources:
        here = F.col("source") == s
        metrics += [
            F.count_if(here & (F.col("variant") == 0)).alias(f"{s}_train_examples"),
            F.count_if(here & ~F.col("held")).alias(f"{s}_output_rows"),
            F.count_if(here & F.col("held")).alias(f"{s}_removed_rows"),
            F.count_if(here & (F.col("variant") == 0) & F.col("truncated")).alias(f"{s}_truncated_examples"),
        ]
    return flagged.observe(seen, *metrics).filter(~F.col("held")).drop("held"), seen


def number_source_rows(rows: DataFrame, out: str = "source_row") -> DataFrame:
    """0-based row numbers per source in (ex_id, variant) order.

    Ranks are taken inside blocks of one example's variants; block sizes are summed within examples,
    example sizes within id ranges, and id ranges within the source.
    """
    block = X.int_div(F.col("variant"), F.lit(BUCKET_ROWS))
    tagged = rows.withColumn("_vb", block)
    keys = ["source", "ex_id", "_vb"]
    before = Window.unboundedPreceding
    sizes = tagged.groupBy(*keys).agg(F.count("*").alias("_n"))
    in_example = F.sum("_n").over(Window.partitionBy("source", "ex_id").orderBy("_vb").rowsBetween(before, -1))
    blocks = sizes.withColumn("_in_example", F.coalesce(in_example, F.lit(0)))
    examples = sizes.groupBy("source", "ex_id").agg(F.sum("_n").alias("_n")).withColumn(
        "_range", X.int_div(F.col("ex_id"), F.lit(BUCKET_ROWS))
    )
    in_range = F.sum("_n").over(Window.partitionBy("source", "_range").orderBy("ex_id").rowsBetween(before, -1))
    ranges = examples.groupBy("source", "_range").agg(F.sum("_n").alias("_n"))
    in_source = F.sum("_n").over(Window.partitionBy("source").orderBy("_range").rowsBetween(before, -1))
    starts = (
        examples.withColumn("_in_range", F.coalesce(in_range, F.lit(0)))
        .join(ranges.select("source", "_range", F.coalesce(in_source, F.lit(0)).alias("_in_source")), ["source", "_range"])
        .select("source", "ex_id", (F.col("_in_range") + F.col("_in_source")).alias("_start"))
    )
    offsets = blocks.join(starts, ["source", "ex_id"]).select(*keys, (F.col("_start") + F.col("_in_example")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("variant")) - 1
    ranked = tagged.withColumn("_pos", inside)
    return ranked.join(offsets, keys).select(*rows.columns, (F.col("_before") + F.col("_pos")).cast("bigint").alias(out))
