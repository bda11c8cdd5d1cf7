"""Tagging texts with a dictionary of terms.

A trie automaton finds every term in one pass over a text. Of terms that overlap the leftmost is kept, of several at one
place the longest, as a reader of the dictionary would. Dictionaries are taken in parts of bounded size, so a large one is
several passes over the texts, which never move.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.session import small_batches, stage

PART_TERMS = 200_000  # terms of one automaton
SPANS = "array<struct<start:int,stop:int,label:string>>"
TAGGED = f"struct<spans:{SPANS},annotation:string>"

_GROUP = re.compile(r"\[[^\[\]]*\]")


def automaton(terms: list[tuple[str, str]]) -> ahocorasick.Automaton | None:
    """Of (term, label) pairs; a term with several labels has the first one in order."""
    if not terms:
        return None
    out = ahocorasick.Automaton()
    for term, label in sorted(terms, reverse=True):
        out.add_word(term, (len(term), label))
    out.make_automaton()
    return out


def occurrences(known: ahocorasick.Automaton | None, text: str, whole_words: bool) -> list[tuple[int, int, str]]:
    """Every (start, stop, label) outside bracket groups, by code points."""
    out, at = [], 0
    for a, b in [*(m.span() for m in _GROUP.finditer(text)), (len(text), len(text))]:
        if known is not None and a > at:
            for end, (size, label) in known.iter(text, at, a):
                start, stop = end - size + 1, end + 1
                if start < at or whole_words and (start and text[start - 1].isalnum() and text[start].isalnum() or stop < len(text) and text[stop].isalnum() and text[end].isalnum()):
                    continue
                out.append((start, stop, label))
        at = b
    return out


def chosen(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The leftmost, of those at one place the longest, without overlaps."""
    out, at = [], 0
    for start, stop, label in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        if start >= at:
            out.append((start, stop, label))
            at = stop
    return out


def annotated(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span as ``[label : text]``, in one pass."""
    out, at = [], 0
    for start, stop, label in spans:
        out += [text[at:start], "[", label, " : ", text[start:stop], "]"]
        at = stop
    return "".join([*out, text[at:]])


def _span_arrays(rows: Iterator[list[tuple[int, int, str]] | None]) -> pa.Array:
    """Lists of spans as an Arrow column, without an object for each span of a batch."""
    starts, stops, labels, ends, none, names = array("i"), array("i"), array("i"), array("i", [0]), [], {}
    for spans in rows:
        none.append(spans is None)
        for start, stop, label in spans or ():
            starts.append(start)
            stops.append(stop)
            labels.append(names.setdefault(label, len(names)))
        ends.append(len(starts))
    numbers = [pa.array(np.frombuffer(n, dtype=np.int32)) if len(n) else pa.array([], pa.int32()) for n in (starts, stops, labels)]
    spans = pa.StructArray.from_arrays([*numbers[:2], pa.array(list(names), pa.string()).take(numbers[2])], names=["start", "stop", "label"])
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), spans, mask=pa.array(none, pa.bool_()))


def _tagged_arrays(rows: Iterator[tuple[str | None, list[tuple[int, int, str]] | None]]) -> pa.Array:
    """Spans and annotation of each text of a batch; a text is annotated as soon as its spans are known."""
    annotations = []

    def each():
        for text, spans in rows:
            annotations.append(None if text is None else annotated(text, spans))
            yield None if text is None else spans

    spans = _span_arrays(each())
    return pa.StructArray.from_arrays([spans, pa.array(annotations, pa.string())], names=["spans", "annotation"])


def _finder(terms: list[tuple[str, str]], whole_words: bool):
    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = automaton(terms)
        for batch in batches:
            texts = (t.as_py() for t in batch)
            yield _span_arrays(None if t is None else occurrences(known, t, whole_words) for t in texts)

    return find


def _tagger(terms: list[tuple[str, str]], whole_words: bool):
    """All of it at once, where the terms are one part."""
    @F.arrow_udf(TAGGED)
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = automaton(terms)
        for batch in batches:
            texts = (t.as_py() for t in batch)
            yield _tagged_arrays((t, None if t is None else chosen(occurrences(known, t, whole_words))) for t in texts)

    return tag


def _chooser():
    @F.arrow_udf(TAGGED)
    def choose(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            pairs = ((t.as_py(), spans.as_py()) for t, spans in zip(texts, found))
            yield _tagged_arrays((t, None if t is None else chosen([(s["start"], s["stop"], s["label"]) for s in spans])) for t, spans in pairs)

    return choose


def tag_dictionary(df: DataFrame, text: str, terms: DataFrame, whole_words: bool = True, part_terms: int = PART_TERMS) -> DataFrame:
    """``df`` with ``spans`` (start, stop, label) and ``annotation``, the text with each span as ``[label : text]``.

    ``terms(term, label)`` are found as they are written; null and empty ones are none. Bracket groups that are in the text
    already, as pattern taggers leave them, are kept and not looked into. A null text has null results.
    """
    small_batches(df.sparkSession)
    held = stage(terms.where("term <> '' AND label IS NOT NULL").select("term", "label").distinct(), "terms")
    parts = max(1, -(-held.count() // part_terms))
    found = []
    for number in range(parts):
        some = held if parts == 1 else held.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == number)
        pairs = [(r["term"], r["label"]) for r in some.collect()]  # as many as a part holds
        found.append((_tagger if parts == 1 else _finder)(pairs, whole_words)(F.col(text)))
    tagged = found[0] if parts == 1 else _chooser()(F.col(text), F.concat(*found))
    return df.withColumn("_tagged", tagged).withColumns({"spans": F.col("_tagged.spans"), "annotation": F.col("_tagged.annotation")}).drop("_tagged")
