"""Scalar text expressions. Everything here is a native Column expression: no Python worker."""

from __future__ import annotations

import json
import sys
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the placeholder a slot is masked with.
SLOT = "{SLOT}"

# Split names and their synonyms.
SPLIT_NAMES = {
    "train": "train",
    "valid": "valid",
    "dev": "valid",
    "validation": "valid",
    "test": "test",
}


def _code_points():
    return (chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF)


@cache
def whitespace_chars() -> str:
    """Every character Unicode text splitting treats as white space."""
    return "".join(c for c in _code_points() if c.isspace())


def char_class(chars: str) -> str:
    """A regular-expression class of exactly these characters, neighbours joined to ranges."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]"


@cache
def ws_class() -> str:
    """The same set as a regular-expression class."""
    return char_class(whitespace_chars())


@cache
def _plain_latin() -> str:
    """Latin characters whose case folding is their lower case."""
    return char_class("".join(c for c in map(chr, range(0x250)) if c.casefold() == c.lower() and c != "\u0130"))


@cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Full case folding as (one-to-one from, one-to-one to, one-to-many map)."""
    src, dst, many = [], [], {}
    for c in _code_points():
        folded = c.casefold()
        if folded == c:
            continue
        if len(folded) == 1:
            src.append(c)
            dst.append(folded)
        else:
            many[c] = folded
    return "".join(src), "".join(dst), many


def casefold(x: Column) -> Column:
    """Full Unicode case folding, cheapest way first.

    ASCII and (once the sharp s is spelt out) Latin rows are folded by ``lower``. Any other row pays for
    the code-point table, and only one holding a character that folds to several pays for the map.
    """
    src, dst, many = _fold_tables()
    pairs = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    expanded = F.array_join(
        F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), ""
    )
    whole = F.when(x.rlike(char_class("".join(many))), expanded).otherwise(x)
    spelt = F.replace(x, F.lit("ß"), F.lit("ss"))
    return (
        F.when(F.octet_length(x) == F.char_length(x), F.lower(x))
        .when(spelt.rlike(f"^{_plain_latin()}*$"), F.lower(spelt))
        .otherwise(F.translate(whole, src, dst))
    )


def strip(x: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(x, F.lit(whitespace_chars()))


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"{ws_class()}+$", "")


def collapse_whitespace(x: Column) -> Column:
    """Runs of white space to one space, none at the ends. Single spaces never match, so most are free."""
    ws = ws_class()
    other = char_class(whitespace_chars().replace(" ", ""))
    return F.trim(F.regexp_replace(x, f"{other}{ws}*| {ws}+", " "))


def text_key(x: Column) -> Column:
    """Comparison key: case-folded, white space collapsed. Never written out as text."""
    return collapse_whitespace(casefold(x))


# Keys longer than this are compared by their digest, so long texts are never shuffled to be compared.
KEY_CHARS = 64


def with_match_key(df: DataFrame, text: str = "utterance", out: str = "key") -> DataFrame:
    """Add the key to join or group equal texts on: the comparison key, or a digest when it is long.

    A digest is one character longer than the longest plain key, so the two cannot be confused.
    """
    whole = F.col("_whole_key")
    compact = F.when(F.char_length(whole) <= KEY_CHARS, whole).otherwise(F.concat(F.lit("#"), F.sha2(whole, 256)))
    return df.withColumn("_whole_key", text_key(F.col(text))).withColumn(out, compact).drop("_whole_key")


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def commas_to_spaces(x: Column) -> Column:
    return F.translate(x, ",", " ")


def null_to_space(x: Column) -> Column:
    return F.coalesce(x, F.lit(" "))


def generic_mask(x: Column, drop_newlines: bool = False) -> Column:
    """Mask every bracket group, literal ones included."""
    masked = F.regexp_replace(x, r"\[[^\[\]]+\]", SLOT)
    return F.replace(masked, F.lit("\n"), F.lit("")) if drop_newlines else masked


def collapse_curly_slots(x: Column) -> Column:
    return F.regexp_replace(x, r"\{[^}]*\}", SLOT)


def keep_topk_slot_tokens(x: Column, ranked: list[str], k: int) -> Column:
    """Keep the first ``k`` slot tokens of ``ranked``; every later one becomes the placeholder."""
    others = F.array(*[F.lit(s) for s in ranked[k:]]).cast(T.ArrayType(T.StringType()))
    return F.aggregate(others, x, lambda text, token: F.replace(text, token, F.lit(SLOT)))


def slot_count(pattern: Column) -> Column:
    return F.regexp_count(pattern, F.lit(r"\{SLOT\}")).cast("bigint")


def strict_slot_count(raw: Column, pattern: Column) -> Column:
    """The declared count if it is plain ASCII digits and true for the pattern, else null."""
    ok = raw.rlike("^[0-9]{1,18}$")
    number = F.when(ok, raw).try_cast("bigint")
    return F.when(number == slot_count(pattern), number)


def normalise_split(x: Column) -> Column:
    """Split synonyms to train/valid/test; an unknown name stops the job."""
    names = F.create_map(*[F.lit(v) for kv in SPLIT_NAMES.items() for v in kv])
    return F.coalesce(
        F.try_element_at(names, x),
        F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(x, F.lit("null")))).cast("string"),
    )


def row_id(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def is_blank(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def four_views(utterance: Column, pattern: Column) -> Column:
    u, p = null_to_space(utterance), null_to_space(pattern)
    return F.array(u, u, p, p)


def text_policy(x: Column, task: Column, policy: str, exempt: tuple[str, ...] = ("massive",)) -> Column:
    """Preprocessing before encoding: ``none``, ``legacy`` (all but exempt tasks) or ``legacy-commas``."""
    if policy == "none":
        return x
    if policy == "legacy-commas":
        return commas_to_spaces(x)
    if policy == "legacy":
        return F.when(task.isin(*exempt), x).otherwise(commas_to_spaces(x))
    raise ValueError(f"unknown text policy {policy!r}")


def physical_lines(x: Column) -> Column:
    """Lines a record occupies once written: one plus its embedded newlines."""
    return (1 + F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit("")))).cast("bigint")
