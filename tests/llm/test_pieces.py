import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from slotweave.llm import pieces as P

from .conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "")
        out.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids) if ids else "")))
    return sorted(out, key=str)


def test_whole_table_equals_the_library(tables, library):
    docs = tables("documents")
    got = sorted(map(tuple, P.round_trip(docs, PATH).collect()), key=str)
    assert got == want(library, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(documents, library):
    rows = [*ODD, (8, " " * 999), (9, "x" * 40_000), (10, "▁ ▁▁a"), (11, "\x00 🙂‍👩")]
    assert sorted(map(tuple, P.round_trip(documents(rows), PATH).collect()), key=str) == want(library, rows)
    assert P.round_trip(documents([]), PATH).collect() == []


def test_random_texts_and_ids(library):
    rng, own = random.Random(6), P.codec(PATH)
    signs = "abcdethe  ▁\n\t\x00é漢🙂𐍈ﬁ ing ion123 .,!?ا"
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) + " " * rng.choice([0, 0, 0, rng.randint(0, 70)])
        assert own.encode(text) == library.encode(text)
        ids = [rng.randint(3, 900) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids)


def test_backtracking_agrees_with_plain_merging():
    rng, own = random.Random(8), P.codec(PATH)
    for _ in range(1500):
        word = "▁" + "".join(rng.choice("aeinorsthld") for _ in range(rng.randint(1, 14)))
        assert own._known(word) == own.merged(word)[0]


def test_columns(documents):
    got = documents([(1, "Hello  there"), (2, None)]).select(
        P.decode_column(P.encode_column("text", PATH), PATH).alias("back"), P.encode_column("text", PATH).alias("ids")).collect()
    assert [(r["back"], bool(r["ids"])) for r in got] == [("Hello  there", True), ("", False)]


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(P.PieceCodec, "normalized", staticmethod(lambda text: text))
    with pytest.raises(ValueError):
        P.PieceCodec(PATH)
