"""Slot vocabularies and corpus counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.functions import annotation as A
from slotweave.functions import text as X
from slotweave.session import broadcast_if_small, stage

# Substitution depth per source.
TOP_K = {"snips": 5, "atis": 2, "massive": 3, "hwu": 3, "clinc": 5}
# Depths of the released corpus; only one source differs.
RELEASED_TOP_K = {**TOP_K, "snips": 2}


def k_for_source(source: Column, ks: dict[str, int] | int) -> Column:
    if isinstance(ks, int):
        return F.lit(ks)
    table = F.create_map(*[F.lit(v) for kv in ks.items() for v in kv])
    return F.coalesce(
        F.try_element_at(table, source),
        F.raise_error(F.concat(F.lit("no top-k for source "), source)).cast("int"),
    )


def slot_occurrences(examples: DataFrame, count: str = "occurrence") -> DataFrame:
    """(source, kind, value, ord, pos), one row per slot part.

    ``count='per_example'`` keeps each (kind, value) once per example; this is done inside the row.
    """
    if count not in ("occurrence", "per_example"):
        raise ValueError("count must be 'occurrence' or 'per_example'")
    slots = F.filter("parts", lambda p: p["kind"].isNotNull() & p["value"].isNotNull())  # a literal bracket has no value
    if count == "per_example":
        slots = F.array_distinct(slots)
    return examples.select("source", F.col("ex_id").alias("ord"), F.posexplode(slots).alias("pos", "p")).select(
        "source", F.col("p.kind").alias("kind"), F.col("p.value").alias("value"), "ord", "pos"
    )


def entity_value_occurrences(examples: DataFrame, roles: bool = False) -> DataFrame:
    """Historic variant: the entity's own value field, in entity order, role prefix removed."""
    rows = examples.select("source", F.col("ex_id").alias("ord"), F.posexplode("spans").alias("pos", "e"))
    kind = F.col("e.kind") if roles else A.strip_role(F.col("e.kind"))
    return rows.select("source", kind.alias("kind"), F.col("e.value").alias("value"), "ord", "pos")


# Slots an example may have; (ord, pos) is packed into one number so that counting stays a hash
# aggregate (a struct minimum would sort all occurrences first). Overflow and longer examples are errors.
MAX_SLOTS = 65_536


def slot_frequencies(occurrences: DataFrame) -> DataFrame:
    """Count and first appearance per (source, kind, value); combined on the map side."""
    too_long = F.raise_error(F.lit("too many slots in one example")).cast("bigint")
    place = F.when(F.col("pos") < MAX_SLOTS, F.col("ord") * F.lit(MAX_SLOTS).cast("bigint") + F.col("pos")).otherwise(too_long)
    return occurrences.groupBy("source", "kind", "value").agg(F.count("*").alias("cnt"), F.min(place).alias("first"))


def top_values(frequencies: DataFrame, ks: dict[str, int] | int) -> DataFrame:
    """The k most frequent values per kind, ties by first appearance.

    The literal bound lets Spark prune every task to k rows per kind before the shuffle, so a kind
    with a third of all values never lands in one task.
    """
    deepest = ks if isinstance(ks, int) else max(ks.values())
    w = Window.partitionBy("source", "kind").orderBy(F.col("cnt").desc(), F.col("first").asc())
    ranked = frequencies.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= deepest)
    return ranked.filter(F.col("rank") <= k_for_source(F.col("source"), ks)).select(
        "source", "kind", "rank", "value", "cnt"
    )


def slot_vocabulary(examples: DataFrame, ks: dict[str, int] | int, count: str = "occurrence") -> DataFrame:
    return top_values(slot_frequencies(slot_occurrences(examples, count)), ks)


def mask_beyond(rows: DataFrame, text: str, kinds: DataFrame, k: int) -> DataFrame:
    """Keep the ``k`` most frequent slot tokens of ``kinds(kind, n)``; every other one becomes the placeholder.

    Only k names are ranked; tokens that ``kinds`` does not know stay as they are. Rows are told apart by nothing but the tokens
    they hold: each distinct list of tokens is looked up once.
    """
    kept = stage(kinds.orderBy(F.col("n").desc(), "kind").limit(k).select("kind"), "kept")
    others = kinds.join(broadcast_if_small(kept), "kind", "left_anti").select(
        F.concat(F.lit("{"), "kind", F.lit("}")).alias("token"))
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\{[^{}]*\}"), 0)))
    tagged = rows.withColumn("_tokens", tokens)
    lists = tagged.where(F.size("_tokens") > 0).select("_tokens").distinct()
    found = lists.select("_tokens", F.explode("_tokens").alias("token")).join(others, "token").groupBy("_tokens").agg(
        F.collect_set("token").alias("_beyond"))
    none = F.array().cast("array<string>")
    masked = F.aggregate(F.coalesce("_beyond", none), F.col(text), lambda out, token: F.replace(out, token, F.lit(X.SLOT)))
    return tagged.join(found, "_tokens", "left").withColumn(text, masked).select(*rows.columns)


def vocabulary_arrays(vocabulary: DataFrame) -> DataFrame:
    """One row per (source, kind) with at most k values in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return vocabulary.groupBy("source", "kind").agg(F.transform(ordered, lambda s: s["value"]).alias("vals"))


def corpus_summary(examples: DataFrame) -> DataFrame:
    """Rows, slot kinds, value strings, raw and masked templates per source."""
    rows = examples.groupBy("source").agg(
        F.count("*").alias("examples"),
        F.count_distinct(A.parts_to_annotation(F.col("parts"))).alias("raw_templates"),
        F.count_distinct(A.parts_to_pattern(F.col("parts"))).alias("masked_templates"),
    )
    slots = slot_occurrences(examples).groupBy("source").agg(
        F.count_distinct("kind").alias("slot_kinds"), F.count_distinct("value").alias("slot_values")
    )
    return rows.join(slots, "source", "left").select(
        "source", "examples", "raw_templates", "masked_templates",
        F.coalesce("slot_kinds", F.lit(0)).cast("bigint").alias("slot_kinds"),
        F.coalesce("slot_values", F.lit(0)).cast("bigint").alias("slot_values"),
    )


def original_statistics(evidence: DataFrame) -> DataFrame:
    """Originals, slot types, value strings and templates per source, from evidence rows."""
    rows = evidence.groupBy("source").agg(
        F.count("*").alias("originals"), F.count_distinct("template").alias("templates")
    )
    slots = (
        evidence.select("source", F.explode("slots").alias("s"))
        .groupBy("source")
        .agg(F.count_distinct("s.type").alias("slots"), F.count_distinct("s.value").alias("values"))
    )
    return rows.join(slots, "source", "left").select(
        "source", "originals", F.coalesce("slots", F.lit(0)).cast("bigint").alias("slots"),
        F.coalesce("values", F.lit(0)).cast("bigint").alias("values"), "templates",
    )


def label_and_value_counts(occurrences: DataFrame) -> DataFrame:
    """Entity-label and entity-value counters in one long table."""
    stacked = occurrences.select(
        F.explode(
            F.array(
                F.struct(F.lit("label").alias("counter"), F.col("kind").alias("item")),
                F.struct(F.lit("value").alias("counter"), F.col("value").alias("item")),
            )
        ).alias("c")
    )
    return stacked.groupBy("c.counter", "c.item").agg(F.count("*").alias("cnt"))


def summed_statistics(per_source: DataFrame, sources: list[str]) -> DataFrame:
    """Totals are sums of per-source counts; null while any source is missing."""
    metrics = [c for c in per_source.columns if c != "source"]
    present = F.count_if(F.col("source").isin(*sources)) == len(sources)
    return per_source.agg(*[F.when(present, F.sum(m)).alias(m) for m in metrics])


def slot_count_histogram(pairs: DataFrame, parts: list[str]) -> DataFrame:
    return pairs.groupBy(*parts, X.slot_count(F.col("pattern")).alias("slot_count")).agg(F.count("*").alias("cnt"))
