import tracemalloc

import numpy as np
import xxhash

from slotweave.llm import simhash as S
from slotweave.llm.components import components

from .conftest import ODD


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(i, brute_fingerprint(t or "")) for i, t in rows]
    near = [[j for j, q in enumerate(prints) if (p[1] ^ q[1]).bit_count() <= 3] for p in prints]
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min(group[j] for j in others)
            if low != group[i]:
                group[i], changed = low, True
    out = []
    for i, (doc, value) in enumerate(prints):
        ids = [prints[j][0] for j in range(len(prints)) if group[j] == group[i] and prints[j][0] is not None]
        out.append((doc, f"{value:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_whole_table_equals_brute_force(tables):
    docs = tables("documents")
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=str)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(documents):
    got = sorted(map(tuple, S.near_duplicates(documents(ODD)).collect()), key=str)
    assert got == brute_components(ODD)
    assert S.near_duplicates(documents([])).collect() == []


def test_long_texts_hash_in_slices(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    monkeypatch.setattr(S, "HASHES_AT_ONCE", 64)
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_index_finds_every_pair():
    rng = np.random.default_rng(5)
    for n, bits in ((2, 64), (17, 6), (600, 11), (900, 40)):
        values = np.unique(rng.integers(0, 1 << min(bits, 62), n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 if bits == 64 else 3))
        values = values[np.argsort(S.gray_rank(values))]
        got = {(int(i), int(j)) for a, b in S.GrayIndex(values).links(3) for i, j in zip(a, b)}
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 3}
        assert got == want


def test_hot_top_nodes_are_split(spark):
    """A dense ball of fingerprints, far over the group size, still gives one component."""
    values = sorted({(1 << a) ^ (1 << b) ^ 0xABCDEF for a in range(40) for b in range(a, 40)} | {1 << 62, (1 << 62) ^ 7})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for group_rows in (20, 20_000):
        roots = dict(map(tuple, components(S.near_links(fps, 3, group_rows)).collect()))
        assert len({roots.get(v, v) for v in values}) == 2


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)}


def test_index_over_a_dense_group_holds_few_pairs():
    """Fingerprints around one value prune nothing; what is held does not grow with the square of their number."""
    rng = np.random.default_rng(1)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2000, 3), dtype=np.uint64), axis=1)
    values = np.unique(flips ^ np.uint64(0x123456789ABCDEF))
    values = values[np.argsort(S.gray_rank(values), kind="stable")]
    tracemalloc.start()
    pairs = {(i, j) for left, right in S.GrayIndex(values).links(3) for i, j in zip(left.tolist(), right.tolist())}
    tracemalloc.clear_traces()
    tracemalloc.reset_peak()
    member, root = S.spanning_links(values, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    apart = np.bitwise_count(values[:, None] ^ values)
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= 3, 1)))))
    assert member.tolist() == list(range(1, len(values))) and not root.any()
    assert peak < 32 << 20
