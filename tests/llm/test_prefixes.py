import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from slotweave.llm import prefixes as K
from slotweave.llm import queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string, place string, n string, depth string"


@pytest.fixture
def conversations(spark):
    return lambda rows: spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: fewer tasks each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def brute(rows):
    """Nodes by walking every prefix of every rebuilt conversation."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    turns = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    return of_sequences(built)


def of_sequences(built):
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, cs in members.items():
        gain = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += p not in children
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir, tables):
    rows = [tuple(r) for r in tables("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_prefixes(spark, sf_dir)) == brute(rows)


def test_oracle_states_the_same(conversations):
    rows = random_rows(random.Random(3), 40)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({K.oracle()})").fetchall(), key=str) == brute(rows)


def random_rows(rng, n):
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randrange(1, 12)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "é", "", None])))
    return rows


def test_odd_rows(conversations):
    rng = random.Random(1)
    rows = random_rows(rng, 60)
    rows += rows[:20]  # repeated rows and tied turn numbers
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None), (7, None, None, "x" * 300_000), (1000, 5, None, None), (1004, 1, "user", "alone")]
    assert got(K.conversation_trie(conversations(rows))) == brute(rows)
    assert got(K.conversation_trie(conversations([]))) == []
    assert got(K.conversation_trie(conversations([(None, 0, "a", "b")]))) == []


def sequences(spark, built):
    """Turns and ids of conversations given as sequences of (role, text)."""
    rows = [(c, d, hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1].encode())) for c, seq in built.items() for d, t in enumerate(seq)]
    return spark.createDataFrame(rows, "conv_id long, place long, key binary, bytes long"), spark.createDataFrame([(c,) for c in built], "conv_id long")


@pytest.mark.parametrize("block", [3, 4096])
def test_small_blocks_and_many_levels(spark, block):
    rng = random.Random(block)
    built = {c: tuple(("u", rng.choice("ab")) for _ in range(rng.randrange(0, 7))) for c in rng.sample(range(500), 60)}
    assert got(K.trie(*sequences(spark, built), block=block)) == of_sequences(built)


def test_long_conversations_are_ranked_by_levels(spark):
    """Shared prefixes that end inside, at and behind the borders of blocks of turns."""
    rng = random.Random(9)
    base = [("u", rng.choice("abc")) for _ in range(300)]
    built = {c: tuple(base[:cut] + [("u", f"own{c % 7}")] * extra) for c, (cut, extra) in enumerate(
        [(300, 0), (300, 2), (31, 1), (32, 1), (33, 1), (32, 0), (64, 0), (65, 5), (128, 200), (128, 201), (0, 3), (0, 0), (299, 1), (300, 0), (96, 0), (97, 1)])}
    assert got(K.trie(*sequences(spark, built), block=4)) == of_sequences(built)


def test_hot_conversation(spark, monkeypatch):
    """Most conversations are the same one: their ids are hashed from pieces."""
    built = {c: (("u", "hello"), ("a", "hi")) if c % 10 else (("u", "hello"), ("a", str(c))) for c in range(300)}
    turns, ids = sequences(spark, built)
    members, _ = K.classes_of(turns, ids)
    classes = members.groupBy("cls").count().withColumnRenamed("count", "n")
    assert sorted(map(tuple, K._member_digests(members, classes, piece=7).collect())) == sorted(map(tuple, K._member_digests(members, classes).collect()))
    assert got(K.trie(turns, ids)) == of_sequences(built)


def test_descent_in_sparse_tables():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 8, 9, 100):
        values = rng.integers(-1, 6, n)
        table = K.sparse_table(values)
        start, limit = rng.integers(0, n, 200), rng.integers(-1, 8, 200)
        want = [next((i for i in range(s, n) if values[i] < m), n) for s, m in zip(start, limit)]
        assert K.first_below(table, start, limit).tolist() == want
        low = rng.integers(0, n, 200)
        high = np.minimum(n - 1, low + rng.integers(0, n, 200))
        assert K.range_min(table, low, high).tolist() == [values[a:b + 1].min() for a, b in zip(low, high)]
