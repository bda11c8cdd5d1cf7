import math
import random

import duckdb
import pyarrow as pa
import pytest

from slotweave.llm import licences, preferences, urls
from slotweave.llm.queries import ORACLES, QUERIES

from .conftest import ODD

TABLES = ["documents", "pages", "conversations", "labels"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", ["op6_urls", "op10_licences"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_licences_odd_rows(documents):
    rows = [*ODD, (8, "CC-BY, cc by; CC  BY"), (9, "Released under\nthe MIT License."), (10, "x released UNDER the mit  license y"),
            (11, "accby cc bye all rights, reserved general public licensee"), (12, "ALL RIGHTS\nRESERVED. all rights reserved")]
    got = {r["doc_id"]: r for r in licences.scan(documents(rows)).collect()}
    assert len(licences.scan(documents(rows)).collect()) == len(rows) and licences.scan(documents([])).collect() == []
    assert (got[1]["n_words"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, None, "", 0.0)
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"], got[8]["base_labels"]) == (3, 0, 4, "cc-by")
    assert got[9]["labels"] == got[10]["labels"] == "mit" and got[10]["score"] == 1.0
    assert (got[11]["n_base"], got[11]["base_labels"]) == (1, "reserved")
    assert (got[12]["n_base"], got[12]["first_word"], got[12]["last_word"]) == (2, 0, 3)


def brute_labels(words, notices, share):
    """Labels and score by trying every passage, as the module defines it."""
    found = []
    for label, text in notices:
        bag, span = set(text.split()), math.ceil(len(text.split()) / share - 1e-9)
        for p, word in enumerate(words):
            win = words[p:p + span]
            n = len(set(win) & bag)
            if word in bag and win.count(word) == 1 and n >= math.ceil(share * len(bag) - 1e-9):
                found.append((label, p, p + max(i for i, w in enumerate(win) if w in bag), n / len(bag)))
    best = [f for f in found if not any(g[3] > f[3] and g[1] <= f[2] and f[1] <= g[2] for g in found)]
    return ",".join(sorted({f[0] for f in best})), max((f[3] for f in best), default=0.0)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted"""


def test_licences_in_passages(documents):
    """Wrapped notices are found wherever they start; their words scattered over a text are not."""
    filler = [f"w{k}" for k in range(400)]
    apache = "licensed under the apache license version 2.0".split()
    scattered = list(filler)
    for k, w in enumerate(apache):
        scattered[20 * k] = w
    rows = [(1, BSD), (2, " ".join(scattered)), (3, "Licensed under\n the Apache License,\n Version 2.0"), (4, "no " * 5000 + BSD + " no" * 50)]
    rows += [(100 + at, " ".join(filler[:at] + BSD.split() + filler[at:120])) for at in range(0, 100, 7)]
    rows += [(300, "released under the mit license and all that " + " ".join(filler[:3]) + " licensed under the apache license version 2.0"),
             (301, "licensed under the gnu lesser general public license"), (302, "licensed under the gnu general public license version 3")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(documents(rows)).collect()}
    assert got[1] == got[4] == ("bsd", 1.0) and got[2] == ("", 0.0) and got[3] == ("apache-2.0", 1.0)
    assert {got[i] for i in got if 100 <= i < 300} == {("bsd", 1.0)}
    assert got[300][0] == "apache-2.0,mit" and got[301][0] == "gpl,lgpl" and got[302][0] == "gpl"  # a base phrase is in both


def test_containment_join_equals_comparing_all(documents):
    notices = [("a", "one two three four five"), ("b", "three four five six"), ("c", "one one two")]
    words = "one two three four five six seven".split()
    rng = random.Random(2)
    rows = [(i, " ".join(w for k, w in enumerate(words) if i >> k & 1)) for i in range(1, 128)]
    rows += [(200 + i, " ".join(rng.choice([*words, "x", "y", "z"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    for share in (0.5, 0.75, 1.0):
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(documents(rows), notices, share).collect()}
        for i, text in rows:
            want = brute_labels(text.split(), notices, share)
            assert got[i] == want


def test_urls_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme.org/"), (4, "HTTP://A.Example.ORG/es/x?y#z"), (5, "https://org"), (6, "ftp://notorg/"),
            (7, "x://b.com/fr/é"), (7, "x://b.com/fr/é"), (None, "x://com/de/1"), (9, "a://b://c.org/"), (10, "https://org/" + "a" * 20_000)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, score string, row long")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows) and all(r["verdict"] in ("allow", "block") and r["score"] is not None for r in got)
    by_id = {r["page_id"]: tuple(r)[1:5] for r in got}
    assert by_id[1][:3] == by_id[3][:3] == ("", "", None)
    assert by_id[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert by_id[5][:3] == ("org", "", None) and by_id[6][:3] == ("notorg", "/", None)
    assert by_id[7] == ("b.com", "/fr/é", "com/fr/", "allow") and by_id[None] == ("com", "/de/1", "com/de/", "block")
    assert by_id[9][:2] == ("b:", "//c.org/")
    assert urls.judge(pages.limit(0)).collect() == []


def test_url_models_follow_the_rules(spark):
    rows = [(i, f"https://h{i}.org/good/page{i % 9}") for i in range(200)] + [(i, f"https://h{i}.com/de/casino{i % 9}") for i in range(200, 400)]
    rows += [(1000, "https://x.net/good/page3"), (1001, "https://x.net/de/casino4")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000] == "allow" and got[1001] == "block"


def test_preferences_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, None, None), (2, 0, "user", "hi"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"),
            (3, 5, "user", ""), (None, 0, "user", "x"), (4, None, "user", "x")]
    talk = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = preferences.format_conversations(talk).collect()
    parts = {}
    for r in sorted(got, key=lambda r: (r["pair_id"] or 0, r["part"], r["place"])):
        assert r["start"] == sum(len(x["content"]) for x in parts.get((r["pair_id"], r["part"]), [])) and r["length"] == len(r["content"])
        parts.setdefault((r["pair_id"], r["part"]), []).append(r)
    text = {k: "".join(r["content"] for r in v) for k, v in parts.items()}
    assert "hi" in text[1, "prompt"] and "a" in text[1, "prompt"] and (1, "chosen") in text
    assert not any(r["trained"] for r in got if r["part"] == "prompt")
    assert all(r["trained"] == (r["role"] == "assistant") for r in got if r["part"] != "prompt")
    assert {r["pair_id"] for r in got} == {1, 2, 3, 4, None}  # turns without a number or a conversation are kept
    assert all("x" in text.get((i, "prompt"), "") + text.get((i, "chosen"), "") for i in (4, None))
    # All rows stand in the chosen side once, null turns behind the numbered ones; the oracle says the same.
    more = rows + [(1, None, "assistant", "late"), (1, None, None, None), (None, None, None, "y")]
    table = pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in more])
    con = duckdb.connect()
    con.register("conversations", table)
    want = con.sql(ORACLES["op7_preferences"])
    out = preferences.format_conversations(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    assert sum(r["part"] != "rejected" for r in out.collect()) == len(more)
    assert preferences.format_conversations(talk.limit(0)).collect() == []


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    rows = [(1, i, "user" if i % 2 else "assistant", "t" * (i % 5)) for i in range(100)] + [(2, i, "user", "z") for i in range(90)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, preferences.format_conversations(talk).collect()), key=str)
    monkeypatch.setattr(preferences, "BLOCK_TURNS", 7)
    assert sorted(map(tuple, preferences.format_conversations(talk).collect()), key=str) == whole
