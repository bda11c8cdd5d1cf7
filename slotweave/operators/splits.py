"""Held-out handling: routing, decontamination, cascades, audits, samples, label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.functions import text as X
from slotweave.sources.ordinals import number_sorted


def heldout_keys(df: DataFrame, text: str = "utterance", scope: list[str] | None = None) -> DataFrame:
    """Distinct comparison keys, per ``scope`` columns or pooled."""
    return X.with_match_key(df.select(*(scope or []), F.col(text).alias("_text")), "_text").drop("_text").distinct()


def exact_partition(rows: DataFrame, valid: DataFrame, test: DataFrame, split: str, text: str = "utterance") -> DataFrame:
    """Exact membership: train is in neither list, valid and test are in theirs."""
    if split == "train":
        out = rows.join(valid.select(text).distinct(), text, "left_anti")
        return out.join(test.select(text).distinct(), text, "left_anti")
    keys = {"valid": valid, "test": test}[split]
    return rows.join(keys.select(text).distinct(), text, "left_semi")


def route_by_membership(rows: DataFrame, valid: DataFrame, test: DataFrame, text: str = "utterance") -> DataFrame:
    """Attach ``split`` with precedence valid, test, train. Both lists share one join."""
    members = (
        valid.select(F.col(text).alias("_member"), F.lit(0).alias("_rank"))
        .unionByName(test.select(F.col(text).alias("_member"), F.lit(1).alias("_rank")))
        .groupBy("_member")
        .agg(F.min("_rank").alias("_rank"))
    )
    split = F.when(F.col("_rank") == 0, "valid").when(F.col("_rank") == 1, "test").otherwise("train")
    return rows.join(members, rows[text] == members["_member"], "left").select(
        *[rows[c] for c in rows.columns], split.alias("split")
    )


def decontaminate(rows: DataFrame, keys: DataFrame, text: str = "utterance", scope: list[str] | None = None) -> DataFrame:
    """Drop rows whose comparison key is held out."""
    on = [*(scope or []), "key"]
    return X.with_match_key(rows, text).join(keys, on, "left_anti").select(*rows.columns)


def flag_heldout(rows: DataFrame, keys: DataFrame, text: str = "utterance", scope: list[str] | None = None,
                 out: str = "held") -> DataFrame:
    """Keep every row and say whether it is held out, so counts and output come from one pass."""
    on = [*(scope or []), "key"]
    tagged = keys.withColumn("_hit", F.lit(True))
    joined = X.with_match_key(rows, text).join(tagged, on, "left")
    return joined.select(*rows.columns, F.coalesce("_hit", F.lit(False)).alias(out))


def cascade(rows: DataFrame, parts: list[str] | None = None, text: str = "utterance") -> DataFrame:
    """Flag valid rows found in train, and test rows found in train or in a kept valid row.

    A valid row that is not kept is in train itself, so a test row is excluded exactly when its key is
    in train or valid: one key table and one join decide every split.
    """
    parts = parts or []
    keyed = X.with_match_key(rows, text)
    seen = (
        keyed.filter(F.col("split").isin("train", "valid"))
        .groupBy(*parts, "key")
        .agg(F.bool_or(F.col("split") == "train").alias("_in_train"))
    )
    excluded = (
        F.when(F.col("split") == "train", F.lit(False))
        .when(F.col("split") == "valid", F.coalesce("_in_train", F.lit(False)))
        .otherwise(F.col("_in_train").isNotNull())
    )
    return keyed.join(seen, [*parts, "key"], "left").select(*rows.columns, excluded.alias("excluded"))


def cascade_counts(rows: DataFrame, parts: list[str] | None = None, text: str = "utterance") -> DataFrame:
    """Rows and excluded rows per part and split under ``cascade``, from one grouping by key instead of a join."""
    parts = parts or []
    by_key = X.with_match_key(rows, text).groupBy(*parts, "key").agg(
        *[_split_count(s).alias(s) for s in ("train", "valid")],
        F.count_if(~F.coalesce(F.col("split").isin("train", "valid"), F.lit(False))).alias("test"))
    zero = F.lit(0).cast("bigint")
    cells = F.array(
        F.struct(F.lit("train").alias("split"), F.col("train").alias("n"), zero.alias("out")),
        F.struct(F.lit("valid").alias("split"), F.col("valid").alias("n"), F.when(F.col("train") > 0, F.col("valid")).otherwise(zero).alias("out")),
        F.struct(F.lit("test").alias("split"), F.col("test").alias("n"),
                 F.when(F.col("train") + F.col("valid") > 0, F.col("test")).otherwise(zero).alias("out")),
    )
    split = by_key.select(*parts, F.inline(cells)).where("n > 0")
    return split.groupBy(*parts, "split").agg(F.sum("n").alias("row_count"), F.sum("out").alias("excluded"))


def flag_training_overlap(rows: DataFrame, training: DataFrame, text: str = "utterance",
                          scope: list[str] | None = None) -> DataFrame:
    """Flag valid/test rows whose key occurs in the actual training texts; train rows never are."""
    flagged = flag_heldout(rows, heldout_keys(training, text, scope), text, scope, out="excluded")
    return flagged.withColumn("excluded", F.col("excluded") & (F.col("split") != "train"))


def bag_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose multiplicity differs, with both counts; empty when the bags are equal."""
    tagged = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    counts = tagged.groupBy(*columns).agg(F.sum("_a").alias("left_count"), F.sum("_b").alias("right_count"))
    return counts.filter(F.col("left_count") != F.col("right_count"))


def not_contained(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``a`` missing from ``b``; a subset assertion holds when this is empty."""
    return a.join(b.select(*columns).distinct(), columns, "left_anti")


def _split_count(split: str) -> Column:
    return F.count_if(F.col("split") == split)


def split_audit(rows: DataFrame, parts: list[str] | None = None, text: str = "utterance") -> DataFrame:
    """Rows, intents, duplicates and overlaps per part, each from one grouping on its own key."""
    parts = parts or []
    names = ("train", "valid", "test")
    by_key = X.with_match_key(rows, text).groupBy(*parts, "key").agg(*[_split_count(s).alias(s) for s in names])
    texts = by_key.groupBy(*parts).agg(
        *[F.sum(s).alias(f"{s}_rows") for s in names],
        *[F.sum(F.greatest(F.col(s) - 1, F.lit(0))).alias(f"{s}_duplicates") for s in names],
        F.sum(F.when(F.col("train") > 0, F.col("test")).otherwise(0)).alias("train_test_overlap"),
        F.sum(F.when(F.col("train") > 0, F.col("valid")).otherwise(0)).alias("train_valid_overlap"),
    )
    by_intent = rows.groupBy(*parts, "intent").agg(*[_split_count(s).alias(s) for s in names])
    intents = by_intent.groupBy(*parts).agg(
        *[F.count_if(F.col(s) > 0).alias(f"{s}_intents") for s in names],
        F.count_if((F.col("test") > 0) & (F.col("train") == 0)).alias("absent_intents"),
    )
    counts = [c for c in [*texts.columns, *intents.columns] if c not in parts]
    both = texts.unionByName(intents, allowMissingColumns=True)
    return both.groupBy(*parts).agg(*[F.max(c).alias(c) for c in dict.fromkeys(counts)])


def absent_intents(rows: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """Test intents that train does not have."""
    parts = parts or []
    by_intent = rows.groupBy(*parts, "intent").agg(_split_count("train").alias("train"), _split_count("test").alias("test"))
    return by_intent.filter((F.col("test") > 0) & (F.col("train") == 0)).select(*parts, "intent")


def seeded_sample(rows: DataFrame, n: int, seed: int, id_col: str, parts: list[str] | None = None) -> DataFrame:
    """The ``n`` rows per part with the smallest seeded hash; callers order by their own index.

    Counting by hash prefix tells which prefixes hold the smallest n hashes; every other row is dropped
    before any shuffle, and only the kept prefixes are ranked.
    """
    if n < 1:
        raise ValueError("sample limits must be positive")
    parts = parts or []
    keys = [*parts, "_b"]
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_col).cast("string")))
    hashed = rows.withColumn("_h", digest).withColumn("_b", F.substr("_h", F.lit(1), F.lit(4)))
    sizes = hashed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*parts).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    needed = sizes.select(*keys, F.coalesce(before, F.lit(0)).alias("_before")).filter(F.col("_before") < n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", id_col)) + F.col("_before")
    kept = hashed.join(needed, keys).withColumn("_place", place).filter(F.col("_place") <= n)
    return kept.select(*rows.columns)


def label_vocabulary(rows: DataFrame, label: str = "intent", out: str = "label_idx") -> DataFrame:
    """Sorted distinct labels with their position."""
    labels = rows.select(label).distinct()
    return number_sorted(labels, [label], out=out)


def label_index(rows: DataFrame, labels: DataFrame, label: str = "intent", unknown: str = "UNK",
                out: str = "label_idx") -> DataFrame:
    """Position of the label, else the position of the unknown label."""
    fallback = labels.filter(F.col(label) == unknown).agg(F.max(out)).scalar()
    joined = rows.join(labels, label, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), fallback)).select(*rows.columns, out)
