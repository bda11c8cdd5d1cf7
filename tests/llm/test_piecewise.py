import hashlib
import random

import pytest
import xxhash

from slotweave.llm import piecewise as P

from .conftest import ODD


def text_hash(text):
    return (xxhash.xxh64_intdigest(text.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    out = []
    for k, (i, text) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(text)
        edited = text[:n - n // 2] + after[:n // 2]
        a, b, c = map(P.fingerprint, (text, edited, after))
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), a, b, P.likeness(a, b), P.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_ids", [7, 4096])
def test_whole_table_equals_brute_force(tables, block_ids):
    docs = tables("documents")
    got = P.fingerprints(docs, block_ids)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(documents):
    assert sorted(map(tuple, P.fingerprints(documents(ODD)).collect()), key=str) == brute(ODD)
    assert P.fingerprints(documents([])).collect() == []
    one = P.fingerprints(documents([(9, "alone")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_null_repeated_and_sparse_ids_are_spread(documents):
    """Many rows without id, under one id, and ids far apart: right in their order, no block with many rows."""
    rng = random.Random(11)
    text = lambda k: " ".join(rng.choice(["river", "stone", "cloud", "lamp", "door"]) + str(rng.randrange(90)) for _ in range(k % 40))
    rows = [(None, text(k)) for k in range(700)] + [(40, text(k)) for k in range(700)] + [(k, text(k)) for k in range(-60, 90)]
    rows += [(rng.randrange(-(1 << 62), 1 << 62), text(k)) for k in range(300)] + [(41, "same words here")] * 30
    docs = documents(rows)
    assert sorted(map(tuple, P.fingerprints(docs, 16).collect()), key=str) == brute(rows)
    blocks, size = P.in_blocks(docs.select("doc_id", "text"), 16)
    assert size == sum(len(t) for _, t in rows)
    counted = blocks.where("NOT borrowed").groupBy("block").count().collect()
    assert sum(r["count"] for r in counted) == len(rows) and sorted(r["count"] for r in counted)[-2] <= 64
    assert sorted(r["block"] for r in counted) == list(range(len(counted)))


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(20)]
    for a, b in zip(texts, texts[1:]):
        half = P.fingerprint(a[:len(a) // 2] + b[:len(a) // 2])
        assert P.likeness(P.fingerprint(a), P.fingerprint(a)) == 1.0
        assert P.likeness(P.fingerprint(a), half) > 0.35 > P.likeness(P.fingerprint(a), P.fingerprint(b))
        assert P.likeness(P.fingerprint(a), P.fingerprint(a.replace("a", "z", 2))) > 0.8


def test_common_subsequence_by_bits():
    rng = random.Random(4)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert P._common(a, b) == plain(a, b)
