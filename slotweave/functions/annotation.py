"""Annotated utterances as ``parts``: an ordered array of (value, kind); kind is null for literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotweave.functions.text import SLOT, strip, ws_class

PARTS_TYPE = "array<struct<value:string,kind:string>>"
SPANS_TYPE = "array<struct<start:bigint,stop:bigint,kind:string,value:string>>"


def _annotation_pattern() -> str:
    return rf"\[([^\[\]:]+?){ws_class()}+:{ws_class()}+([^\[\]]*?)\]"


def _part(value: Column, kind: Column | None) -> Column:
    k = F.lit(None).cast("string") if kind is None else kind
    return F.struct(value.alias("value"), k.alias("kind"))


def parse_annotation(annotation: Column) -> Column:
    """``go [city : Rome]`` to parts. Brackets without `` : `` stay literal text."""
    pattern = _annotation_pattern()
    literals = F.split(annotation, pattern, -1)
    kinds = F.regexp_extract_all(annotation, F.lit(pattern), 1)
    values = F.regexp_extract_all(annotation, F.lit(pattern), 2)
    typed = F.zip_with(values, kinds, lambda v, k: _part(v, F.nullif(strip(k), F.lit(""))))
    pieces = F.zip_with(
        literals, typed, lambda lit, t: F.array(_part(lit, None), t)
    )
    return F.filter(F.flatten(pieces), lambda p: p.isNotNull()).cast(PARTS_TYPE)


def strict_mask(annotation: Column) -> Column:
    """Looser spacing than parse_annotation; null when any bracket is left over."""
    ws = ws_class()
    masked = F.regexp_replace(annotation, rf"\[([^\[\]:]+?){ws}*:{ws}*([^\[\]]+)\]", SLOT)
    return F.when(~masked.rlike(r"[\[\]]"), masked)


def sorted_spans(spans: Column) -> Column:
    return F.array_sort(spans)


def spans_valid(text: Column, spans: Column) -> Column:
    """Non-empty, ordered, non-overlapping and inside the text (code-point offsets)."""
    s = sorted_spans(spans)
    ok = F.transform(
        s,
        lambda e, i: (F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(s, i - 1)["stop"]) <= e["start"])
        & (e["start"] >= 0)
        & (e["start"] < e["stop"])
        & (e["stop"] <= F.char_length(text)),
    )
    return F.forall(ok, lambda b: F.coalesce(b, F.lit(False)))


def repair_whole_span(text: Column, spans: Column) -> Column:
    """The single span whose value is the whole text is reset to cover it."""
    whole = F.array(
        F.struct(
            F.lit(0).cast("bigint").alias("start"),
            F.char_length(text).cast("bigint").alias("stop"),
            F.get(spans, 0)["kind"].alias("kind"),
            F.get(spans, 0)["value"].alias("value"),
        )
    ).cast(SPANS_TYPE)
    return F.when(needs_repair(text, spans), whole).otherwise(spans)


def needs_repair(text: Column, spans: Column) -> Column:
    return (
        ~spans_valid(text, spans)
        & (F.size(spans) == 1)
        & (F.get(spans, 0)["value"].eqNullSafe(text))
    )


def spans_to_parts(text: Column, spans: Column) -> Column:
    """Slice the text at its spans; null when they are invalid."""
    s = sorted_spans(spans)

    def piece(e, i):
        prev = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(s, i - 1)["stop"])
        return F.array(
            _part(_slice(text, prev, e["start"]), None),
            _part(_slice(text, e["start"], e["stop"]), e["kind"]),
        )

    last = F.coalesce(F.get(s, F.size(s) - 1)["stop"], F.lit(0).cast("bigint"))
    tail = F.array(_part(_slice(text, last, F.char_length(text).cast("bigint")), None))
    parts = F.concat(F.flatten(F.transform(s, piece)), tail).cast(PARTS_TYPE)
    return F.when(spans_valid(text, spans), parts)


def _slice(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))


def offset_mask(text: Column, spans: Column, typed: bool = False) -> Column:
    """Historic masking: spans in the given order with a running shift, nothing checked."""

    def insert(acc, e):
        token = (
            F.concat(F.lit("["), e["kind"], F.lit(" : "), e["value"], F.lit("]")) if typed else F.lit(SLOT)
        )
        start = (e["start"] + acc["shift"]).cast("int")
        stop = (e["stop"] + acc["shift"]).cast("int")
        return F.struct(
            F.concat(
                F.substring(acc["text"], F.lit(1), start),
                token,
                F.substring(acc["text"], stop + 1, F.char_length(acc["text"])),
            ).alias("text"),
            (acc["shift"] + F.char_length(token) - (e["stop"] - e["start"])).cast("bigint").alias("shift"),
        )

    start = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("shift"))
    return F.aggregate(spans, start, insert, lambda acc: acc["text"])


def strip_role(kind: Column) -> Column:
    """``fromloc.city_name`` to ``city_name``."""
    return F.when(F.contains(kind, F.lit(".")), F.split_part(kind, F.lit("."), F.lit(2))).otherwise(kind)


def parts_to_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["value"]), "")


def parts_to_pattern(parts: Column) -> Column:
    return F.array_join(
        F.transform(parts, lambda p: F.when(p["kind"].isNull(), p["value"]).otherwise(F.lit(SLOT))), ""
    )


def parts_to_annotation(parts: Column) -> Column:
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p["kind"].isNull(), p["value"]).otherwise(
                F.concat(F.lit("["), p["kind"], F.lit(" : "), p["value"], F.lit("]"))
            ),
        ),
        "",
    )


def legacy_brackets_to_parts(annotation: Column) -> Column:
    """Historic reading: a bracket group's kind is the text before `` : ``.

    A group without `` : `` is a literal: it masks like a slot, but has no value to count, and its kind is the
    group itself, which no vocabulary holds.
    """
    group = r"\[[^\[\]]+\]"
    literals = F.split(annotation, group, -1)
    groups = F.regexp_extract_all(annotation, F.lit(group), 0)
    typed = F.transform(
        groups,
        lambda g: _part(
            F.get(F.split(F.btrim(g, F.lit("[] ")), " : "), F.lit(1)),
            F.when(F.contains(g, F.lit(" : ")), F.get(F.split(F.btrim(g, F.lit("[] ")), " : "), F.lit(0))).otherwise(g),
        ),
    )
    pieces = F.zip_with(literals, typed, lambda lit, t: F.array(_part(lit, None), t))
    return F.filter(F.flatten(pieces), lambda p: p.isNotNull()).cast(PARTS_TYPE)


def legacy_slot_values(annotation: Column) -> Column:
    """Historic slot values of one example: a set of (kind, value), value cut at a second colon."""
    groups = F.regexp_extract_all(annotation, F.lit(r"\[[^\[\]]+\]"), 0)
    return F.array_distinct(
        F.transform(
            groups,
            lambda g: F.struct(
                F.btrim(F.get(F.split(F.btrim(g, F.lit("[] ")), ":"), F.lit(1)), F.lit(" ")).alias("value"),
                F.btrim(F.get(F.split(F.btrim(g, F.lit("[] ")), ":"), F.lit(0)), F.lit(" ")).alias("kind"),
            ),
        )
    )
