"""A quality classifier: logistic regression over hashed word n-grams, trained by follow the regularised leader.

Features of a text are the n-grams of two word sequences: the words themselves in lower case, and their shapes
(letter case, digits and punctuation, runs cut to one sign), which carry over to words never seen in training. Two
more stand for words repeated at once and for word pairs met before in the text. Counts are damped by a
logarithm and every text's vector has length one, so long texts score like short ones.

Training reads a bounded, hash-spread sample of labelled rows in shards; the shards' weights are averaged. The
model is an array of fixed size, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import held_out, labelled, labelled_ids, small_batches, text_udf

BUCKETS = 1 << 18
TRAIN_ROWS = 12_000  # labelled rows read for training
SHARD_ROWS = 3_000  # rows that one task learns from
EPOCHS, UPDATES = 3, 12_000  # passes over a shard at least; small shards are passed until so many updates
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.02, 0.05
KEEP = 0.3  # score from which a document counts as good
MEMO_WORDS = 200_000
BIAS, SAME, AGAIN = 0, 1, 2  # reserved buckets

_MASK = BUCKETS - 1
_RUNS = [(re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w])\1+"), r"\1")]


def shape(word: str) -> str:
    """Letters as one a (some lower case) or A, digits as one 0, runs of one sign as that sign."""
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word


def _mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes over the buckets that are not reserved."""
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return (values >> np.uint64(40)).astype(np.int64) % (BUCKETS - 3) + 3


class Features:
    """Sparse features of texts; remembers the codes of words, so many."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def code(self, word: str) -> int:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        code = zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(shape(word).encode())
        if len(word) <= 64:
            self.memo[word] = code
        return code

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.array([BIAS]), np.ones(1)
        known = self.memo.get
        both = np.array([known(w) or self.code(w) for w in words], dtype=np.uint64)
        surface, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        two, five = np.uint64(0x100000001B3), np.uint64(5)
        pairs = surface[:-1] * two + surface[1:]
        same = np.count_nonzero(surface[1:] == surface[:-1])
        again = len(pairs) - len(np.unique(pairs))
        grams = np.concatenate((surface, pairs, form + five, (form[:-1] * two + form[1:]) * five))
        at, count = np.unique(_mix(grams), return_counts=True)
        value = np.log1p(count)
        value /= np.sqrt((value * value).sum())
        share = np.array([1.0, same / len(words), again / len(words)])
        return np.concatenate(([BIAS, SAME, AGAIN], at)), np.concatenate((share, value))


def logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, x))))


class Ftrl:
    """Follow the regularised leader, per coordinate."""

    def __init__(self, size: int = BUCKETS):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (logistic(float(w @ value)) - y) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, rows = Features(), []
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            at, value = features(text or "")
            rows.append((at.astype(np.int32), value.astype(np.float32), y))
    if not rows:
        return
    model = Ftrl()
    for _ in range(max(EPOCHS, UPDATES // len(rows))):
        for at, value, y in rows:
            model.learn(at, value, y)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([
        pa.array([at.astype(np.int32)], type=pa.list_(pa.int32())), pa.array([w[at]], type=pa.list_(pa.float64()))], names=["at", "w"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights: BUCKETS floats. Without labelled rows all are zero, and every score is one half."""
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, label, rows)
    shards = max(1, -(-labelled_ids(labels, label, rows).count() // SHARD_ROWS))
    order = F.xxhash64(F.lit("order"), "doc_id")
    dealt = sample.select("text", "y", order.alias("o")).repartition(shards, "o").sortWithinPartitions("o")
    parts = dealt.mapInArrow(_trainer, "at array<int>, w array<double>").toArrow()  # a row for each shard
    model = np.zeros(BUCKETS, dtype=np.float32)
    for at, w in zip(parts.column("at"), parts.column("w")):
        model[at.values.to_numpy()] += w.values.to_numpy().astype(np.float32) / parts.num_rows
    return model


def score_column(model: np.ndarray, text: str | Column = "text") -> Column:
    """The probability that a text is good; a null text scores like an empty one, by the bias alone."""

    def make():
        features = Features()

        def work(value: str) -> tuple[float]:
            at, share = features(value)
            return (float(logistic(float(model[at] @ share))),)

        return work

    return text_udf("score double", make)(text)["score"]


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``docs(doc_id, text)``, one row each.

    Null ids are not held out, and never learned from. Only the text is an input of the score.
    """
    model = train(docs, labels, rows=rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= keep).cast("int"))
