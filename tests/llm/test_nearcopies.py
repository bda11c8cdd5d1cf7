import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from slotweave.llm import nearcopies as N
from slotweave.llm import simhash

from .conftest import ODD


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(rows):
    """The smallest row number each row reaches over links of five-word similarity 0.8 or more."""
    sets = [shingles(t) for t in rows]
    near = [[j for j, q in enumerate(sets) if similarity(p, q) >= 0.8] for p in sets]
    group, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min(group[j] for j in others)
            if low != group[i]:
                group[i], changed = low, True
    return group


def partition(groups):
    out = {}
    for row, root in groups:
        out.setdefault(root, []).append(row)
    return sorted(map(sorted, out.values()))


def planted(seed=3, bases=60, copies=4):
    """Texts and copies of them with a few words changed, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for _ in range(copies):
            new = list(words)
            for at in rng.sample(range(len(new)), max(1, round(len(new) * rng.choice((0.005, 0.01, 0.02, 0.03))))):
                new[at] = f"x{rng.randrange(10 ** 9)}"
            texts.append(" ".join(new))
    return texts


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: fewer tasks each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("tile", [N.TILE, 3])
def test_planted_near_copies_equal_brute_force(spark, tile):
    texts = planted() + [t for _, t in ODD]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = partition(map(tuple, N.near_copies(rows, tile=tile).collect()))
    assert got == partition(enumerate(brute_groups(texts)))
    assert N.near_copies(rows.limit(0)).collect() == []


def test_tile_sees_every_pair():
    """But for pairs of side 0, and of one root."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 14, 12, dtype=np.uint64)) for _ in range(12)]
        for sides in (np.ones(12, dtype=int), np.arange(12) % 2):
            for roots in (np.arange(12), rng.integers(0, 4, 12)):
                group = [int(min(np.flatnonzero(roots == r))) for r in roots]
                for i, j in N.tile_links(sets, sides, roots):
                    group = [group[i] if g == group[j] else g for g in group]
                    assert sides[i] or sides[j]
                for i in range(12):
                    for j in range(i):
                        if (sides[i] or sides[j]) and similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8:
                            assert group[i] == group[j]


def edited(n, words=150, seed=5):
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    return [" ".join(f"x{i}" if k == at else w for k, w in enumerate(base)) for i in range(n) for at in [rng.randrange(words)]]


def test_texts_of_a_large_group_travel_a_few_times(spark, monkeypatch):
    """Copies of one text, a word changed in each: the texts sent per document do not grow with the group."""
    sent = []
    for name in ("first_tiles", "last_tiles"):
        def counted(*args, plain=getattr(N, name)):
            out = plain(*args)
            sent.append(out.count())
            return out

        monkeypatch.setattr(N, name, counted)
    each = {}
    for n in (512, 4096):
        sent.clear()
        rows = spark.createDataFrame(list(enumerate(edited(n))), "row long, text string")
        roots = {r["root"] for r in N.near_copies(rows, rounds=(2, 4), tile=128).collect()}
        each[n] = sum(sent) / n
        assert len(roots) == 1
    assert each[4096] < 1.2 * each[512] and each[4096] < 12


def test_values_shared_by_unlike_texts(spark):
    """Bands of one row gather texts far below the threshold; what is apart is compared with every block."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    texts = []
    for i in range(90):
        own = common + [f"o{i}_{k}" for k in range(60)]
        texts.append(" ".join(own))
        if i % 3 == 0:
            texts.append(" ".join(own[:-1] + ["end"]))
    rng.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = partition(map(tuple, N.near_copies(rows, bands=40, rows=1, tile=8, rounds=(3,)).collect()))
    assert got == partition(enumerate(brute_groups(texts)))


def test_long_texts_and_negative_rows(spark):
    long = " ".join(f"l{k}" for k in range(40_000))
    texts = {-5: long, 9: long + " more", 2: "short one", 7: "SHORT one", 11: None, 12: " "}
    rows = spark.createDataFrame(list(texts.items()), "row long, text string")
    assert partition(map(tuple, N.near_copies(rows).collect())) == [[-5, 9], [2, 7], [11, 12]]


def test_stage_drops_edited_copies(spark, sf_dir, tables):
    texts = planted(seed=9)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], tables("documents").schema)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert got == set(brute_groups(texts))


def test_stage_keeps_one_row_of_every_group(spark, sf_dir, tables):
    rng = random.Random(4)
    one, two, three, four = (" ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(80)) for _ in range(4))
    near = two.rsplit(" ", 1)[0] + " end"
    rows = [(None, one), (None, one), (None, None), (None, ""), (5, two), (5, three), (3, near), (None, near), (8, four), (8, four), (None, four)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], tables("documents").schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert len(got) == 5 and {t for _, t in got if t} == {one, near, three, four}
    assert {(i, t) for i, t in got if t} == {(None, one), (3, near), (5, three), (8, four)}


def test_fingerprints_of_the_gray_index_find_near_copies(spark):
    """With no bands that agree, the index alone gives the candidates; the shingle sets still decide."""
    texts = edited(40, words=4000) + [" ".join(f"far{k}" for k in range(200)), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    want = partition(enumerate(brute_groups(texts)))
    near = {frozenset((i, j)) for i, p in enumerate(texts) for j, q in enumerate(texts) if p and q and i < j
            and (simhash.fingerprint_of(N.shingle_set(p)) ^ simhash.fingerprint_of(N.shingle_set(q))).bit_count() <= N.BITS}
    assert len(near) > 40  # the planted copies lie within the limit of the index
    assert partition(map(tuple, N.near_copies(rows, bands=1, rows=2000).collect())) == want
    none = N.near_copies(rows, bands=1, rows=2000, similarity=0.99999)
    assert len({r["root"] for r in none.collect()}) == len(texts) - 1  # fingerprints alone link nothing


def test_fingerprint_of_hashes_is_that_of_a_text():
    text = " ".join(f"w{k}" for k in range(500))
    words = text.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), simhash.SEED) for i in range(498)]
    assert simhash.fingerprint_of(np.array(hashes, dtype=np.uint64)) == simhash.fingerprint(text)
    assert simhash.fingerprint_of(np.empty(0, dtype=np.uint64)) == 0


def test_stage_asks_the_gray_index(spark, sf_dir, tables, monkeypatch):
    asked = []
    plain = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a, **k: asked.append(1) or plain(*a, **k))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(edited(5))], tables("documents").schema)
    assert corpus_pipeline.near_duplicates(spark, docs, sf_dir).count() == 1 and asked
