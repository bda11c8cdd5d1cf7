"""Toxicity scores from a learned lexicon, misspellings included, weighed by how the terms are used.

The lexicon holds whole words and stems (beginnings shared by several words) that are far commoner in toxic
than in clean labelled documents, beyond what chance would bring about among so many terms. Contexts and documents
are counted once, and near copies mostly share the passage a document is known by, so copies of one text teach little.
Its words form a trie; Levenshtein automata run along it, both made deterministic step by step, so a
word costs one lookup per character and most are left after two or three. Few edits are allowed, by word length,
and near misses known from clean documents are none. A found term counts less inside quotation marks or
behind a word that reports speech. The sum over a text becomes a probability by logistic calibration.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import held_out, labelled, small_batches, text_udf
from slotweave.session import stage

LEARN_ROWS = 12_000  # labelled rows read for learning
SUPPORT = 4  # different contexts and documents with a term, at least
FALSE_TERMS = 1.0  # terms that chance alone may bring into the lexicon, expected over all terms tested
RATIO, STEM_RATIO = 20.0, 8.0  # how much commoner a word, a stem is in toxic documents
ENOUGH = 3.0  # log ratio beyond which a longer stem is no better than a commoner one
STEMS, STEM_WORDS, STEM_SUPPORT = range(4, 9), 8, 2  # lengths of stems; different words, and times the evidence, a stem must have
EDITS = ((5, 1), (9, 2))  # from this length on, so many edits
EDIT_FACTOR, QUOTED_FACTOR = 0.5, 0.3
WINDOW = 3  # words around a term that are looked at for quotation
THRESHOLD = 0.5
MEMO_WORDS, MEMO_CHARS = 200_000, 64  # words remembered, and the longest of them
COUNTED = 500_000  # terms that a task counts before it hands them on
PASSAGE = 3  # words of the passages that tell documents apart

_TOKEN = re.compile(r"[^\W_](?:\S*[^\W_])?")
_RUN = re.compile(r"\S+")
_FOLD = str.maketrans("013457@$!", "oieastasi")  # signs that stand for letters

# Quotation marks, and words that report speech or name a word.
_OPEN, _CLOSE = "\"“„«‘'`", "\"”“»’'`"
_REPORT = set(
    "word words term called calls said says quote quoted wrote named saying wort sagte schrieb genannt mot terme dit écrit "
    "palabra término dijo escribió llamado".split()
)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)  # near misses met in clean documents
    weights: tuple[float, float, float] = (4.0, 0.0, -4.0)  # of the sum, of the sum per hundred words, and an offset


def edits_allowed(word: str) -> int:
    return max((n for size, n in EDITS if len(word) >= size), default=0)


class Matcher:
    """Lexicon trie times Levenshtein automata, determinised as words are read."""

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most: list[int] = [0]  # edits that some word below a node allows
        for term, mark, edits in [(w, self.word, edits_allowed(w)) for w in lexicon.words] + [(s, self.stem, 0) for s in lexicon.stems]:
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    for column, value in ((self.children, {}), (self.word, None), (self.stem, None), (self.most, 0)):
                        column.append(value)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            mark[node] = term
        self.lexicon = lexicon
        self.states: list[frozenset[tuple[int, int]]] = []
        self.known: dict[frozenset[tuple[int, int]], int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, float, int] | None] = []  # (term, weight, edits) if a word ends here
        self.stops: list[tuple[str, float, int] | None] = []  # (stem, weight, 0) whatever follows
        self.start = self._state({(0, 0)})
        self.memo: dict[str, tuple[str, float, int] | None] = {}

    def _state(self, places: set[tuple[int, int]]) -> int:
        """The number of a set of (node, edits); -1 for the empty one. A character of a term may be missing."""
        todo, least = list(places), {}
        while todo:
            node, edits = todo.pop()
            if edits > self.most[node] or edits >= least.get(node, 99):
                continue
            least[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        key = frozenset(least.items())
        if not key:
            return -1
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            words = [(w, self.lexicon.words[w] * EDIT_FACTOR ** e, e) for n, e in key if (w := self.word[n]) and e <= edits_allowed(w)]
            stems = [(s + "*", self.lexicon.stems[s], 0) for n, e in key if (s := self.stem[n]) and e == 0]
            self.ends.append(max(words, key=lambda x: (x[1], x[0]), default=None))
            self.stops.append(max(stems, key=lambda x: (x[1], x[0]), default=None))
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        places = set()
        for node, edits in self.states[state]:
            places.add((node, edits + 1))  # one character too many
            for letter, child in self.children[node].items():
                places.add((child, edits if letter == c else edits + 1))
        out = self.moves[state][c] = self._state(places)
        return out

    def _run(self, word: str) -> tuple[str, float, int] | None:
        state, moves, stops = self.start, self.moves, self.stops
        for c in word:
            step = moves[state].get(c)
            state = self._move(state, c) if step is None else step
            if state < 0:
                return None
            if stops[state] is not None:
                return stops[state]
        return self.ends[state]

    def find(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) that a lower-case word stands for, if any."""
        if word in self.memo:
            return self.memo[word]
        found = self._run(word)
        if found is None and not word.isalpha():
            plain = word.translate(_FOLD)
            found = self._run(plain) if plain != word else None
        if found is not None and found[2] and word in self.lexicon.clean:
            found = None
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if len(word) <= MEMO_CHARS:
            self.memo[word] = found
        return found


def quoted(text: str, start: int, stop: int, runs: list[int], ends: list[int]) -> bool:
    """Whether a term stands between quotation marks a few words apart, or behind a word that reports.

    ``runs`` and ``ends`` are where the words of the text start and end, whatever their length.
    """
    at, last = bisect_right(runs, start) - 1, bisect_right(runs, stop - 1) - 1
    before = [text[i:j] for i, j in zip(runs[max(0, at - WINDOW):at], ends[max(0, at - WINDOW):at])]
    after = [text[i:j] for i, j in zip(runs[last + 1:last + 1 + WINDOW], ends[last + 1:last + 1 + WINDOW])]
    if runs[at] < start:
        before = [*before, text[runs[at]:start]][-WINDOW:]
    if stop < ends[last]:
        after = [text[stop:ends[last]], *after][:WINDOW]
    if start and text[start - 1] in _OPEN:
        before.append(text[start - 1])
    opens = any(w[0] in _OPEN for w in before)
    closes = any(w[-1] in _CLOSE or w[0] in _CLOSE or w.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) for w in after)
    return opens and closes or any(w.lower().strip("\"'.,:;“”«»") in _REPORT for w in before)


def hits(text: str, matcher: Matcher) -> list[tuple[str, str, float, int, bool]]:
    """(word, term, weight, edits, quoted) for every occurrence."""
    low = text.lower()
    bad = {w for w in set(_TOKEN.findall(low)) if matcher.find(w) is not None}
    if not bad:
        return []
    spans = [m.span() for m in _RUN.finditer(low)]
    runs, ends = [i for i, _ in spans], [j for _, j in spans]
    return [(m[0], *matcher.find(m[0]), quoted(low, m.start(), m.end(), runs, ends)) for m in _TOKEN.finditer(low) if m[0] in bad]


def mass(found: list[tuple[str, str, float, int, bool]]) -> float:
    return sum(weight * (QUOTED_FACTOR if inside else 1.0) for _, _, weight, _, inside in found)


def probability(lexicon: Lexicon, total: float, words: int) -> float:
    a, b, c = lexicon.weights
    x = a * math.log1p(total) + b * math.log1p(100 * total / max(1, words)) + c
    return 1.0 / (1.0 + math.exp(-min(35.0, max(-35.0, x))))


def _terms(words: list[str]) -> Iterator[tuple[str, str, int]]:
    """(term, word, place) of words and of their stems."""
    for i, w in enumerate(words):
        if len(w) >= 3:
            yield w, w, i
            for size in STEMS:
                if len(w) > size:
                    yield w[:size] + "*", w, i


def _code(*parts: str) -> int:
    return zlib.crc32(" ".join(parts).encode())


def passage(words: list[str]) -> int:
    """What a document is known by: the least code of its passages, which near copies mostly share."""
    return min(_code(*words[i:i + PASSAGE]) for i in range(max(1, len(words) - PASSAGE + 1)))


def uses(words: list[str]) -> dict[str, set[tuple[int, int]]]:
    """The (context, word) codes of every term of a text; a context is the words beside it."""
    found: dict[str, set[tuple[int, int]]] = {}
    for term, word, i in _terms(words):
        found.setdefault(term, set()).add((_code(*words[max(0, i - 1):i], "_", *words[i + 1:i + 2]), _code(word)))
    return found


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and term, with its contexts."""
    kind = pa.list_(pa.struct([("context", pa.int64()), ("word", pa.int64())]))
    for batch in batches:
        for text in batch.column("text").to_pylist():
            words = _TOKEN.findall((text or "").lower())
            found = uses(words)
            if found:
                places = [[{"context": c, "word": w} for c, w in sorted(places)] for places in found.values()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(found), type=pa.string()), pa.array([passage(words)] * len(found), type=pa.int64()),
                    pa.array(places, type=kind)], names=["term", "doc", "uses"])


def _clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of documents per term, added up as far as memory allows."""
    count: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), type=pa.string()), pa.array(list(count.values()), type=pa.int64())], names=["term", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            count.update({t for t, _, _ in _terms(list(set(_TOKEN.findall((text or "").lower()))))})
            if len(count) >= COUNTED:
                yield rows()
                count.clear()
    yield rows()


def _sample_hits(lexicon: Lexicon):
    """A row per document: the mass of its sure terms, and of every near miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        kind = pa.list_(pa.struct([("word", pa.string()), ("mass", pa.float64())]))
        for batch in batches:
            sure, near, size = [], [], []
            for text in batch.column("text").to_pylist():
                found, misses = hits(text or "", matcher), Counter()
                for hit in found:
                    if hit[3]:
                        misses[hit[0]] += mass([hit])
                sure.append(mass([hit for hit in found if not hit[3]]))
                near.append([{"word": w, "mass": m} for w, m in sorted(misses.items())])
                size.append(len((text or "").split()))
            yield pa.RecordBatch.from_arrays([
                batch.column("y").cast(pa.int32()), pa.array(sure, type=pa.float64()), pa.array(near, type=kind), pa.array(size, type=pa.int64())],
                names=["y", "sure", "near", "size"])

    return run


def _masses(clean: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [sure + sum(x["mass"] for x in near if x["word"] not in clean)
                     for sure, near in zip(batch.column("sure").to_pylist(), batch.column("near").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(total, type=pa.float64()), batch.column("size")], names=["y", "mass", "size"])

    return run


def evidence(n: int, m: int, toxic: int, clean: int) -> float:
    """How unlikely it is that n of the n + m documents with a term are toxic by chance, as a negative logarithm (Chernoff)."""
    share, base = n / (n + m), toxic / (toxic + clean)
    if share <= base:
        return 0.0
    rest = (1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0
    return (n + m) * (share * math.log(share / base) + rest)


def choose(candidates: dict[str, tuple[int, int, int]], toxic: int, clean: int, tested: int) -> Lexicon:
    """The lexicon from terms with (toxic documents, the fewer of these and of contexts, clean documents).

    ``tested`` is the number of terms of toxic documents that are in SUPPORT documents of any kind; others cannot tell.
    """
    lexicon, bound = Lexicon(), math.log(max(1, tested) / FALSE_TERMS)
    weights = {}
    for t, (docs, n, m) in candidates.items():
        if evidence(n, m, toxic, clean) >= bound * (STEM_SUPPORT if t.endswith("*") else 1):
            weights[t] = math.log((docs + 0.5) / (toxic + 1)) - math.log((m + 0.5) / (clean + 1))
    # Of stems that go on from one another, the one that is common and telling enough stands for all.
    stems = [t[:-1] for t, w in weights.items() if t.endswith("*") and w >= math.log(STEM_RATIO)]
    for stem in sorted(stems, key=lambda x: (-candidates[x + "*"][0] * min(ENOUGH, weights[x + "*"]), len(x), x)):
        if not any(stem.startswith(s) or s.startswith(stem) for s in lexicon.stems):
            lexicon.stems[stem] = weights[stem + "*"]
    lexicon.words = {t: w for t, w in sorted(weights.items()) if not t.endswith("*") and w >= math.log(RATIO)
                     and not any(t.startswith(s) for s in lexicon.stems)}
    return lexicon


def calibrate(masses: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the probability by penalised Newton steps."""
    x = np.stack([np.log1p(masses), np.log1p(100 * masses / np.maximum(1, sizes)), np.ones(len(masses))], axis=1)
    w, penalty = np.array([1.0, 0.0, -1.0]), np.array([0.05, 0.05, 0.01])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Lexicon:
    """Lexicon and calibration from at most ``rows`` labelled documents; empty unless both labels are among them.

    Terms, contexts and near misses are counted by Spark; the driver receives the terms found often enough, the near
    misses of clean documents, and two numbers for each of the ``rows`` documents, never texts or occurrences.
    """
    small_batches(docs.sparkSession)
    sample = stage(labelled(docs, labels, "toxic", rows).select("text", "y"), "labelled")
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    seen = stage(sample.where("y = 1").mapInArrow(
        _toxic_terms, "term string, doc long, uses array<struct<context:long,word:long>>"), "terms")
    found = sample.where("y = 0").select("text").mapInArrow(_clean_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("often"))
    met = seen.groupBy("term").agg(F.count_distinct("doc").alias("docs")).join(found, "term", "left")
    met = stage(met.select("term", "docs", F.coalesce("often", F.lit(0)).alias("often")), "met")
    places = seen.join(met.where(F.col("docs") >= SUPPORT), "term").select("term", "docs", "often", F.inline("uses"))
    places = places.groupBy("term", "docs", "often").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("word").alias("words"))
    terms = places.where((F.col("contexts") >= SUPPORT) & (~F.col("term").endswith("*") | (F.col("words") >= STEM_WORDS)))
    terms = terms.select("term", "docs", F.least("docs", "contexts").alias("n"), "often").toArrow().to_pylist()
    tested = met.where(F.col("docs") + F.col("often") >= SUPPORT).count()
    lexicon = choose({r["term"]: (r["docs"], r["n"], r["often"]) for r in terms}, toxic, clean, tested)
    hit = stage(sample.mapInArrow(_sample_hits(lexicon), "y int, sure double, near array<struct<word:string,mass:double>>, size long"), "hits")
    misses = hit.select("y", F.explode("near.word").alias("word")).groupBy("word").agg(
        F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"))
    lexicon.clean = {r["word"] for r in misses.where("good > 0 AND bad <= 2 * good").select("word").toArrow().to_pylist()}
    found = hit.select("y", "sure", "near", "size").mapInArrow(_masses(lexicon.clean), "y int, mass double, size long")
    found = found.orderBy("y", "mass", "size").toArrow()  # the same sums on every run
    lexicon.weights = calibrate(*(found.column(c).to_numpy().astype(float) for c in ("mass", "size", "y")))
    return lexicon


def score_column(lexicon: Lexicon, text: str | Column = "text") -> Column:
    """The probability that a text is toxic; a null text scores like one without any term."""

    def make():
        matcher = Matcher(lexicon)
        return lambda value: (probability(lexicon, mass(hits(value, matcher)), len(value.split())),)

    return text_udf("score double", make)(text)["score"]


def classify(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``docs(doc_id, text)``, one row each.

    Null ids are not held out, and never learned from. Only the text is an input of the score.
    """
    lexicon = learn(docs, labels, rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
