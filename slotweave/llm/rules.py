"""Quality rules as a learned decision list.

Statistics of whole texts (words, symbols, repeated lines and passages, case, ...) are computed once per row.
From labelled rows, sequential covering learns an ordered list of rules: each is a conjunction of
thresholds, grown on one part of the rows condition by condition and pruned from its end on the other; rows it covers are
set aside and the next rule is learned, while rules stay precise. The list becomes one ordered Spark conditional
expression over the statistics, which anybody can read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import labelled, small_batches, text_udf

LEARN_ROWS = 12_000  # labelled rows whose statistics the rules are learned from
PRECISION = 0.9  # least share of bad rows among those a rule covers, on rows it was not grown on
MIN_COVER = 4  # rows a rule must cover
MIN_WORDS, MAX_REPEATED = 50, 50  # the base: fewer words, or a larger percentage of them repeated, fail

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,"
    "symbol_share double,dup_line_share double,repeat_share double,mean_word double,upper_share double,digit_share double,"
    "distinct_share double,bang_share double,same_share double,words_per_line double"
)
STATISTICS = [part.split()[0] for part in SCHEMA.split(",")][5:]


def repeated_words(codes: np.ndarray) -> int:
    """Places inside a window of three words that occurs twice or more."""
    n = len(codes)
    if n < 4:
        return 0
    size = int(codes.max()) + 1
    pairs = codes[:-1] * size + codes[1:]
    if size > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * size + codes[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    often = count[place] > 1
    inside = np.zeros(n, dtype=bool)
    for shift in range(3):
        inside[shift:n - 2 + shift] |= often
    return int(inside.sum())


def statistics(text: str) -> tuple:
    """The columns of SCHEMA for one text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    repeat = repeated_words(codes)
    same = int(np.count_nonzero(codes[1:] == codes[:-1]))
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    lower = int(np.count_nonzero((raw >= 97) & (raw <= 122)))
    digits = int(np.count_nonzero((raw >= 48) & (raw <= 57)))
    some, letters = max(1, n), max(1, upper + lower)
    return (
        n, chars, symbols, dup, repeat, symbols / some, dup / max(1, len(lines)), repeat / some, chars / some, upper / letters,
        digits / max(1, chars), len(known) / some, (text.count("!") + text.count("?")) / some, same / some, n / max(1, len(lines)),
    )


def statistics_column(text: str | Column = "text") -> Column:
    return text_udf(SCHEMA, lambda: statistics)(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEATED)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, rows: np.ndarray) -> np.ndarray:
        column = rows[:, STATISTICS.index(self.name)]
        return column >= self.threshold if self.above else column < self.threshold

    def expression(self, s: Column) -> Column:
        return s[self.name] >= F.lit(self.threshold) if self.above else s[self.name] < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = Sequence[Condition]


def covered(rule: Rule, rows: np.ndarray) -> np.ndarray:
    inside = np.ones(len(rows), dtype=bool)
    for condition in rule:
        inside &= condition.holds(rows)
    return inside


def _grow(rows: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Add the condition with the best information gain on bad rows until only bad ones are covered.

    Every cut between two values is tried; each condition leaves fewer rows, so growing ends by itself.
    """
    rule: list[Condition] = []
    inside = np.ones(len(rows), dtype=bool)
    while (inside & ~bad).any():
        p, n = int((inside & bad).sum()), int(inside.sum())
        before, best = np.log2(p / n), (0.0, None)
        for i, name in enumerate(STATISTICS):
            values = rows[inside, i]
            cuts = np.unique(values)
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if not len(cuts):
                continue
            order = np.argsort(values, kind="stable")
            upto = np.searchsorted(values[order], cuts)  # rows below each cut
            bad_upto = np.concatenate(([0], np.cumsum(bad[inside][order])))[upto]
            for above, cover, hits in ((True, n - upto, p - bad_upto), (False, upto, bad_upto)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(hits > 0, hits * (np.log2(hits / np.maximum(1, cover)) - before), 0.0)
                at = int(np.argmax(gain))
                if gain[at] > best[0] + 1e-9:
                    best = (float(gain[at]), Condition(name, above, float(cuts[at])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(rows)
    return rule


def _worth(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> float:
    inside = covered(rule, rows)
    hits, misses = int((inside & bad).sum()), int((inside & ~bad).sum())
    return (hits - misses) / (hits + misses) if hits + misses else -1.0


def learn(rows: np.ndarray, bad: np.ndarray, seed: int = 7, precision: float = PRECISION, min_cover: int = MIN_COVER) -> list[list[Condition]]:
    """The ordered rules that reject; no rule without bad rows to learn from.

    Rules are added as long as one covers ``min_cover`` rows that are left, with a share of ``precision`` bad ones among
    those it was not grown on; nothing else bounds their number or their conditions.
    """
    order = np.random.default_rng(seed).permutation(len(rows))
    rows, bad = rows[order], bad[order].astype(bool)
    left = np.ones(len(rows), dtype=bool)
    part = np.arange(len(rows)) % 3 == 2  # a third prunes
    rules: list[list[Condition]] = []
    while (left & bad & ~part).any():
        grow, prune = left & ~part, left & part
        rule = _grow(rows[grow], bad[grow])
        if not rule:
            break
        options = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(options, key=lambda r: (_worth(r, rows[prune], bad[prune]), -len(r)))
        inside = covered(rule, rows) & left
        unseen = inside & part
        share = bad[unseen].mean() if unseen.any() else bad[inside].mean() if inside.any() else 0.0
        if inside.sum() < max(1, min_cover) or share < precision:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> list[list[Condition]]:
    """Rules from the statistics of at most ``rows`` labelled documents that pass the base."""
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, "quality", rows).select("doc_id", "y", statistics_column().alias("s"))
    # No filter on the statistics here: it would move below the join, to every document.
    found = sample.select("doc_id", "y", "s.*").toArrow().to_pandas()
    failed = (found["n_words"] < MIN_WORDS) | (found["n_repeat_words"] * 100 > found["n_words"] * MAX_REPEATED)
    found = found[~failed].sort_values(["doc_id", "y", *STATISTICS])  # the same order on every run
    return learn(found[STATISTICS].to_numpy(dtype=float), found["y"].to_numpy() == 0)


def verdict(rules: Sequence[Rule], s: Column) -> Column:
    """The list as one conditional expression: the first rule that covers a row rejects it; others stay."""
    out = None
    for rule in rules:
        condition = rule[0].expression(s)
        for more in rule[1:]:
            condition = condition & more.expression(s)
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, n_words, the base statistics, base_failed, kept) of ``docs(doc_id, text)``, one row each.

    A null or empty text has no words and fails the base. Other columns are ignored; repeated rows keep a row each.
    """
    rules = learn_from(docs, labels, rows)
    s = F.col("s")
    found = docs.select("doc_id", statistics_column().alias("s"))
    return found.select(
        "doc_id", *[s[name].alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"), F.when(base_failed(s), False).otherwise(verdict(rules, s)).alias("kept"))
