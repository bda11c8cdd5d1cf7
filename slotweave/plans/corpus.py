"""The corpus job: decontaminate, count values, generate, filter, number, package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.operators import generate as G
from slotweave.operators import packaging as P
from slotweave.operators import splits as S
from slotweave.operators import vocab as V
from slotweave.session import broadcast_if_small, stage
from slotweave.sources.ordinals import by_ord, number_rows


def heldout(rows: DataFrame, scope: list[str]) -> DataFrame:
    return S.heldout_keys(rows.filter(F.col("split") != "train"), scope=scope)


def clean_training(rows: DataFrame, scope: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Training examples without held-out texts, per source unless told otherwise."""
    scope = ["source"] if scope is None else scope
    keys = heldout(rows, scope) if keys is None else keys
    return S.decontaminate(rows.filter(F.col("split") == "train"), keys, scope=scope)


def staged_training(rows: DataFrame, scope: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Clean examples as a written table: counting and generation both read them."""
    return stage(clean_training(rows, scope, keys), "examples")


def staged_vocabulary(clean: DataFrame, ks: dict[str, int] | int) -> DataFrame:
    """The vocabulary as a written table: it must be complete before generation starts, and its size
    decides how examples get their candidates."""
    return stage(V.slot_vocabulary(clean, ks), "vocabulary")


def generation_inputs(rows: DataFrame, ks: dict[str, int] | int, scope: list[str], cap: int | None = None,
                      unknown_slot: str = "error") -> tuple[DataFrame, DataFrame]:
    """The unfiltered generation and the held-out keys it must be filtered with.

    Keys filter the input and the output, examples are counted and expanded: both are written once.
    Keys are broadcast when they are measured to be small, so generated rows are then filtered where
    they are made.
    """
    keys = broadcast_if_small(stage(heldout(rows, scope), "heldout"))
    clean = staged_training(rows, scope, keys)
    vocabulary = staged_vocabulary(clean, ks)
    return G.generate(clean, vocabulary, cap, unknown_slot), keys


def augment(rows: DataFrame, ks: dict[str, int] | int, scope: list[str], cap: int | None = None,
            unknown_slot: str = "error") -> DataFrame:
    """Annotated rows of all splits in, training pairs out.

    ``scope=['source']`` isolates the sources; ``scope=[]`` pools the held-out keys.
    """
    generated, keys = generation_inputs(rows, ks, scope, cap, unknown_slot)
    return S.decontaminate(generated, keys, scope=scope)


def number_examples(rows: DataFrame, order: str, out: str = "pair") -> DataFrame:
    return number_rows(rows, [order], by_ord(order), out=out)


def release(rows: DataFrame, ks: dict[str, int] | int, scope: list[str]) -> DataFrame:
    """The released table: utterance, pattern, slot_count, source, source_row."""
    pairs = stage(augment(rows, ks, scope), "pairs")  # numbering reads them twice
    return P.released_rows(pairs)
