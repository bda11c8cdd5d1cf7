import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slotweave.llm import packing as K

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(got, rows, tokenizer):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = {}
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault(i, []).append((k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert {i: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs) for i, rs in by_doc.items()} == {
        i: sorted(p) for i, p in want.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(r["length"] for r in got)


def test_whole_table(tables, tokenizer):
    docs = tables("documents")
    got = K.pack_documents(docs, PATH).collect()
    used, tokens = check(got, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    counts = np.bincount([r["length"] for r in got], minlength=1025)
    assert used <= K.lower_bound(counts) * 1.01 + 1 and used >= -(-tokens // 1024)


def test_odd_rows(documents, tokenizer):
    rows = [*ODD, (8, "<|endoftext|> and " * 5), (9, " " * 5000)]
    check(K.pack_documents(documents(rows), PATH).collect(), rows, tokenizer)
    assert K.pack_documents(documents([]), PATH).collect() == []


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(1, rng.integers(2, 65), rng.integers(1, 60))
        bins, offsets, room = K.best_fit(lengths, 64)
        assert K.lower_bound(np.bincount(lengths, minlength=65), 64) <= len(room)
        assert max(offsets + lengths) <= 64 and [64 - lengths[bins == b].sum() for b in range(len(room))] == room
    assert K.lower_bound(np.bincount([33] * 7, minlength=65), 64) == 7
    assert K.lower_bound(np.bincount([22] * 9, minlength=65), 64) == 5  # two to a sequence
    assert K.lower_bound(np.zeros(65), 64) == 0


def test_exchange_saves_sequences(spark):
    """Many small partitions each leave gaps; exchange closes them."""
    rng = np.random.default_rng(3)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 1025, 3000))]
    pieces = spark.createDataFrame(rows, "item long, length long")
    count = lambda **k: K.pack(pieces, **k).select("sequence_id").distinct().count()
    once, often = count(part_items=50, rounds=1), count(part_items=50, rounds=5)
    assert K.lower_bound(np.bincount([n for _, n in rows], minlength=1025)) <= often < once
    assert K.pack(pieces, part_items=50).count() == 3000


def test_both_engines_agree(tokenizer):
    rng = np.random.default_rng(4)
    own = K.token_ids(PATH)
    assert own.fast is not None
    signs = list("abcde the ing 12 \n\t\r\x00é漢🙂'sll.,!ا  ") + ["<|endoftext|>", "\u3000", "'ll"]
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.integers(0, 40)))
        assert own(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
