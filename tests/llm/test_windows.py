import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slotweave.llm import windows as K

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(got, rows, tokenizer):
    """Every id lies in one piece, checks are right, sequences are gapless; returns padding and number of cut tails."""
    ids_of = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    want = {}
    for i, ids in ids_of:
        want.setdefault(i, []).append(ids)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        assert sum(r["length"] for r in pieces) == sum(len(ids) for ids in want[i])
        assert {r["doc_tokens"] for r in pieces} == {len(ids) for ids in want[i]}
        if len(want[i]) > 1:
            continue  # repeated ids
        at, ids = 0, want[i][0]
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:at], dtype="<u4").tobytes())
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, len(sequences)


def test_whole_table(tables, tokenizer):
    docs = tables("documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = K.pack_windows(docs, PATH).collect()
    padding, sequences = check(got, rows, tokenizer)
    assert padding == 0 and sequences <= -(-sum(r["length"] for r in got) // 1024) + 10


def test_odd_rows(documents, tokenizer):
    rows = [*ODD, (8, "<|endoftext|> and " * 5), (9, " " * 5000)]
    assert check(K.pack_windows(documents(rows), PATH).collect(), rows, tokenizer)[0] == 0
    assert K.pack_windows(documents([]), PATH).collect() == []
    with pytest.raises(ValueError):
        K.pack_windows(documents([]), PATH, capacity=1000)


def test_combinations_are_all_of_them():
    for total in (5, 12, 17):
        for parts in (1, 2, 3, 4):
            want = set()

            def grow(row, left):
                if len(row) == parts:
                    if left == 0:
                        want.add(row)
                    return
                for k in range(1, min(left, row[-1] if row else left) + 1):
                    grow((*row, k), left - k)

            grow((), total)
            got = K.combinations(total, parts)
            assert len(got) == len(want) and {tuple(r) for r in got.tolist()} == want


def test_least_squares_is_optimal():
    """At the optimum no gain is positive, and no used combination has any (the conditions of Karush, Kuhn and Tucker)."""
    rng = np.random.default_rng(5)
    for _ in range(8):
        counts = np.append(0, rng.integers(0, 500, 64))
        counts[64] = 0
        rows = K.shallow(64, 3, counts > 0)
        x = K.repeat_counts(rows, counts)
        used = sum(np.bincount(rows[:, k], weights=x, minlength=65) for k in range(3))
        left = counts - used
        left[0] = 0
        gain = left[rows].sum(axis=1)
        assert (x >= 0).all() and gain.max() < 1e-2 and np.abs(gain[x > 1e-6]).max() < 1e-2


def test_plan_places_each_rank_once():
    rng = np.random.default_rng(6)
    counts = np.append(0, rng.integers(0, 3000, 128))
    counts[128] = 0
    known = K.plan(counts, 128)
    assert (known.planned <= counts).all() and known.planned.sum() > 0.5 * counts.sum()
    lengths = np.repeat(np.arange(129), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    inside, window, offset = known.place(lengths, rank)
    assert inside.sum() == known.planned.sum()
    taken = sorted(zip(window[inside].tolist(), offset[inside].tolist(), lengths[inside].tolist()))
    at = {}
    for w, o, n in taken:
        assert o == at.get(w, 0)
        at[w] = o + n
    assert set(at.values()) == {128} and set(at) == set(range(known.windows))


def test_fill_is_gapless_and_whole():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 10, 200):
        for most in (2, 9, 64):
            lengths = rng.integers(1, most, n)
            item, start, size, window, offset = K.fill(lengths, 64)
            assert (np.bincount(item, weights=size, minlength=n) == lengths).all() if n else not len(item)
            for i in range(n):
                spans = sorted(zip(start[item == i].tolist(), size[item == i].tolist()))
                assert spans[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(spans, spans[1:]))
            used = {}
            for w, o, k in sorted(zip(window.tolist(), offset.tolist(), size.tolist())):
                assert o == used.get(w, 0)
                used[w] = o + k
            assert all(k & (k - 1) == 0 and k <= 64 for k in used.values())
            assert sum(k < 64 for k in used.values()) <= 6


def test_one_hot_length_over_many_partitions(spark, documents, tokenizer):
    rows = [(i, "a" if i % 3 else "a b c d e f g " * 70) for i in range(600)]
    docs = documents(rows).repartition(7)
    assert check(K.pack_windows(docs, PATH, part_items=50).collect(), rows, tokenizer)[0] == 0
