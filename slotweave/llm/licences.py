"""Licence scan: base phrases, and an exact set-similarity join of text blocks with licence notices.

A passage matches a notice when it holds at least a given share of the notice's distinct words (containment) and is no
longer than the notice would be with as large a share of words of its own, wherever its lines break. Blocks are word windows
over the whole text, twice as long as the longest such passage and starting at every such length, so each passage lies
whole in the block it starts in. Words are ordered by how many blocks of the corpus hold them, rarest first. Of a notice
with n words that needs k, a matching block holds one of the first n - k + 1 (prefix filter), at least k words
of notices (length filter), and from the first word they share on both sides still need enough words left
(positional filter). What passes is counted exactly, passage by passage, so nothing that matches is missed. All of it is DataFrame
expressions; only the counts of the notices' own words, so few, come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.session import broadcast_if_small, stage

# Base phrases and their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# (label, notice): the usual wording of licence notices.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "licensed under the creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2.0"),
]
CONTAINMENT = 0.85

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """The words of a phrase or notice, in plain ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _cut(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of the phrase in an array of words."""
    last = F.size(words) - len(phrase)

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == word)
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _labels(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))


def _span(notice: str, containment: float) -> int:
    """Words of the longest passage that counts as the notice."""
    return math.ceil(len(words_of(notice)) / containment - 1e-9)


def _bags(notices: list[tuple[str, str]], containment: float) -> list[tuple[str, tuple[str, ...], int, int]]:
    """(label, distinct words, words needed, longest passage) of each notice."""
    found: dict[tuple, int] = {}
    for label, text in notices:
        key = label, tuple(sorted(set(words_of(text))))
        if key[1]:
            found[key] = max(found.get(key, 0), _span(text, containment))
    return [(label, bag, math.ceil(containment * len(bag) - 1e-9), span) for (label, bag), span in sorted(found.items())]


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row of ``docs``.

    A null or empty text has no words, no labels (empty strings) and score 0. The score is 1 with a base phrase, else
    the largest containment of a notice that reaches the threshold, else 0. Of passages that overlap, those with the largest
    containment name their labels. Other columns are not read.
    """
    notices = NOTICES if notices is None else notices
    bags = _bags(notices, containment)
    vocabulary = sorted({w for _, bag, _, _ in bags for w in bag})
    known = _strings(vocabulary)
    least = min((need for _, _, need, _ in bags), default=1)

    # One pass over the texts: base phrases, and the words of texts that hold enough of some notice.
    low = docs.select("doc_id", F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER).alias("low"))
    maybe = F.col("low").rlike("|".join(r"[\x00-\x60\x7B-\x7F]+".join(words_of(p)) for p, _ in PHRASES))
    cut = low.select("doc_id", maybe.alias("maybe"), _cut(F.col("low")).alias("words"))
    held = cut.withColumn("held", F.array_intersect("words", known))
    enough = F.lit(False)
    for _, bag, need, _ in bags:
        enough = enough | (F.size(F.array_intersect("held", _strings(bag))) >= need)
    none = F.array().cast("array<string>")
    found = held.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when((F.size("held") >= least) & enough, F.col("words")).otherwise(none).alias("kept"),
        F.when(F.col("maybe"), F.col("words")).otherwise(none).alias("words"))
    found = found.select("doc_id", "n_words", "kept", *[_places(F.col("words"), words_of(p)).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    base = F.concat(*[F.when(F.size(f"p{i}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
                      for i, (_, label) in enumerate(PHRASES)])
    rows = stage(found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        base.alias("base"), "kept"), "words")

    best = _named(_passages(rows.where(F.size("kept") > 0).select("row", "kept"), bags, vocabulary))
    return rows.join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", _labels(F.col("base")).alias("base_labels"),
        _labels(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def _named(passages: DataFrame) -> DataFrame:
    """(row, more, share): labels of passages that overlap none with a larger share, and the largest share, per row."""
    passages = stage(passages, "passages")
    # Passages are at most a cell long, so those that overlap lie in neighbouring cells of one text; a cell holds a few.
    cell = F.col("cell")
    a = passages.withColumn("near", cell)
    b = passages.select(F.col("row").alias("_row"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_near"), F.col("start").alias("_start"),
                        F.col("stop").alias("_stop"), F.col("share").alias("_share"))
    better = (F.col("row") == F.col("_row")) & (F.col("near") == F.col("_near")) & (F.col("_share") > F.col("share")) & (
        F.col("_start") <= F.col("stop")) & (F.col("start") <= F.col("_stop"))
    return a.join(b, better, "left_anti").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))


def _passages(texts: DataFrame, bags: list[tuple[str, tuple[str, ...], int, int]], vocabulary: list[str]) -> DataFrame:
    """(row, cell, label, start, stop, share): every passage of (row, kept) that matches, first and last word from 0.

    A passage starts with a word of the notice that does not come again in it.
    """
    spark = texts.sparkSession
    if not bags:
        return spark.createDataFrame([], "row long, cell long, label string, start long, stop long, share double")
    step = max(span for *_, span in bags)
    last = F.floor((F.size("kept") - 1) / step).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(j.alias("block"), F.slice("kept", j * step + 1, 2 * step).alias("words")))
    blocks = texts.select("row", F.explode(windows).alias("b")).select("row", "b.block", "b.words")
    known = _strings(vocabulary)
    held = F.transform(F.array_intersect("words", known), lambda w: F.array_position(known, w).cast("int"))
    blocks = stage(blocks.withColumn("held", held).where(F.size("held") >= min(need for _, _, need, _ in bags)), "blocks")
    pairs = _join(blocks, [(label, bag, need) for label, bag, need, _ in bags], vocabulary)
    named = F.array(*[F.struct(F.lit(label).alias("label"), _strings(bag).alias("bag"), F.lit(need).alias("need"), F.lit(span).alias("span"))
                      for label, bag, need, span in bags])
    pairs = pairs.withColumn("of", F.get(named, F.col("notice")))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(F.col("of.bag"), x["w"]))
    pairs = pairs.select("row", "block", "of", spots.alias("spots"))

    def passage(x: Column) -> Column:
        inside = F.filter("spots", lambda y: (y["i"] >= x["i"]) & (y["i"] < x["i"] + F.col("of.span")))
        words = F.transform(inside, lambda y: y["w"])
        return F.struct(
            (F.col("block") * step + x["i"]).cast("long").alias("start"), (F.col("block") * step + F.array_max(F.transform(inside, lambda y: y["i"]))).cast("long").alias("stop"),
            F.size(F.array_distinct(words)).alias("n"), F.size(F.filter(words, lambda w: w == x["w"])).alias("again"))

    firsts = F.filter("spots", lambda x: x["i"] < step)  # the others start in the next block
    out = pairs.select("row", F.col("block").cast("long").alias("cell"), "of", F.explode(F.transform(firsts, passage)).alias("p"))
    return out.where("p.n >= of.need AND p.again = 1").select(
        "row", "cell", "of.label", "p.start", "p.stop", (F.col("p.n") / F.size("of.bag")).alias("share"))


def _join(blocks: DataFrame, bags: list[tuple[str, tuple[str, ...], int]], vocabulary: list[str]) -> DataFrame:
    """(row, block, words, notice) for every block of (row, block, words, held) that holds enough words of a notice.

    ``held`` are the distinct words a block shares with the vocabulary, as places in it from 1.
    """
    spark = blocks.sparkSession
    # Blocks holding each word, over the whole corpus: as many numbers as the notices have words.
    counted = blocks.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    often = {r["word"]: r["n"] for r in counted}
    by_rarity = sorted(range(1, len(vocabulary) + 1), key=lambda w: (often.get(w, 0), w))
    rank = {w: r for r, w in enumerate(by_rarity)}
    place = {word: i + 1 for i, word in enumerate(vocabulary)}
    index = []
    for number, (_, bag, need) in enumerate(bags):
        ranks = sorted(rank[place[w]] for w in bag)
        index += [(r, at, number, ranks, need) for at, r in enumerate(ranks[:len(bag) - need + 1])]
    prefixes = stage(spark.createDataFrame(index, "first int, at int, notice int, bag array<int>, need int"), "prefixes")
    # A block's words by rarity; the first that some prefix holds stand for it.
    to_rank = F.array(*[F.lit(rank[w]) for w in range(1, len(vocabulary) + 1)])
    ranked = blocks.select(
        "row", "block", "words", F.array_sort(F.transform("held", lambda w: F.element_at(to_rank, w))).alias("ranks"))
    starts = F.array(*[F.lit(r) for r in sorted({i[0] for i in index})])
    probes = ranked.select("row", "block", "words", "ranks", F.explode(F.array_intersect("ranks", starts)).alias("first"))
    probes = probes.withColumn("ahead", F.size("ranks") - F.array_position("ranks", F.col("first")) + 1)
    pairs = probes.join(broadcast_if_small(prefixes), "first")  # as large as the caller's notices
    pairs = pairs.where((F.col("ahead") >= F.col("need")) & (F.size("bag") - F.col("at") >= F.col("need")))
    shared = F.size(F.array_intersect("ranks", "bag"))
    # Of several shared prefix words the rarest one speaks for the pair.
    own = F.array_min(F.array_intersect("ranks", "bag")) == F.col("first")
    return pairs.where(own & (shared >= F.col("need"))).select("row", "block", "words", "notice")


def oracle() -> str:
    """The same in DuckDB's SQL, by trying every passage with every notice."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"('{label}', [{', '.join(repr(w) for w in bag)}], {need}, {span})" for label, bag, need, span in _bags(NOTICES, CONTAINMENT))
    hits = "\nUNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM spots WHERE "
        + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(words_of(phrase))) for phrase, label in PHRASES)
    return rf"""WITH notices(label, bag, need, span) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
cut AS (SELECT r, doc_id, low, regexp_extract_all(low, '{pattern}') AS ws FROM docs),
spots AS (SELECT r, ws, unnest(range(0, len(ws))) AS i FROM cut WHERE regexp_matches(low, 'cc|public|rights')),
hits AS ({hits}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM hits GROUP BY r),
likely AS (SELECT r, ws, label, bag, need, span, unnest(range(1, len(ws) + 1)) AS p FROM cut, notices WHERE len(list_intersect(list_distinct(ws), bag)) >= need),
starts AS (SELECT r, label, bag, need, p, ws[p:p + span - 1] AS win FROM likely WHERE list_contains(bag, ws[p])),
wins AS (SELECT r, label, p, len(list_intersect(list_distinct(win), bag)) AS n, len(bag) AS size, need,
    p + list_max(list_filter(range(len(win)), lambda i: list_contains(bag, win[i + 1]))) AS stop
  FROM starts WHERE len(list_filter(win, lambda w: w = win[1])) = 1),
passages AS (SELECT r, label, p, stop, n::DOUBLE / size AS share FROM wins WHERE n >= need),
matched AS (SELECT r, label, share FROM passages a WHERE NOT EXISTS (
  SELECT 1 FROM passages b WHERE b.r = a.r AND b.share > a.share AND b.p <= a.stop AND a.p <= b.stop)),
best AS (SELECT r, max(share) AS share FROM matched GROUP BY r),
named AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION SELECT r, label FROM matched) GROUP BY r),
based AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(based.labels, '') AS base_labels,
  coalesce(named.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM cut LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN named USING (r) LEFT JOIN based USING (r)"""
