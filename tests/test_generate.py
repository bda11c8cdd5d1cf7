import itertools
import random

import pytest
from pyspark.sql import functions as F

from slotweave.functions import annotation as A
from slotweave.operators import generate as G
from slotweave.operators import splits as S
from slotweave.operators import vocab as V


def examples(spark, rows):
    """rows: (source, ex_id, utterance, annotation)"""
    df = spark.createDataFrame(rows, "source string, ex_id bigint, utterance string, annotation string")
    return df.withColumn("parts", A.parse_annotation(F.col("annotation"))).drop("annotation")


def vocab_df(spark, rows):
    return spark.createDataFrame(rows, "source string, kind string, rank int, value string, cnt bigint")


def texts(df):
    return [r["utterance"] for r in df.orderBy("source", "ex_id", "variant").collect()]


def brute(text, choices, cap=None):
    seen, out = {text}, [text]
    for combo in itertools.islice(itertools.product(*choices), cap):
        t = "".join(combo)
        if t not in seen:
            seen.add(t)
            out.append(t)
    return out


def test_order_and_cap(spark):
    ex = examples(spark, [("s", 1, "from original to original", "from [city : original] to [city : original]")])
    vo = vocab_df(spark, [("s", "city", 1, "a", 2), ("s", "city", 2, "b", 1)])
    assert texts(G.generate(ex, vo)) == ["from original to original", "from a to a", "from a to b", "from b to a", "from b to b"]
    assert texts(G.generate(ex, vo, cap=2)) == ["from original to original", "from a to a", "from a to b"]


def test_tie_and_vocabulary(spark):
    ex = examples(spark, [("s", 1, "b", "[x : b]"), ("s", 2, "a", "[x : a]")])
    assert [r["value"] for r in V.slot_vocabulary(ex, 1).collect()] == ["b"]


def test_collisions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 7)
    rng = random.Random(5)
    words = ["a", "ab", "b", "ba", "aa", "bb", "aba", ""]
    rows, vo, expected = [], [], []
    for i in range(60):
        kinds = {k: rng.sample(words[:-1], rng.randint(1, 5)) for k in ("p", "q", "r")}
        source = f"s{i:03d}"
        for k, vals in kinds.items():
            vo += [(source, k, n + 1, v, 1) for n, v in enumerate(vals)]
        annotation, choices, text = "", [], ""
        for _ in range(rng.randint(1, 4)):
            lit = rng.choice(["", "a", "b", " "])
            kind = rng.choice("pqr")
            annotation += f"{lit}[{kind} : a]"
            choices += [[lit], kinds[kind]]
            text += lit + "a"
        rows.append((source, 1, text, annotation))
        expected += brute(text, choices)
    got = texts(G.generate(examples(spark, rows), vocab_df(spark, vo)))
    assert got == expected


def test_large_vocabulary_path_equals_small(spark):
    rows = [(f"s{i % 2}", i, f"go {i % 5} {i % 3}", f"go [n : {i % 5}] [m : {i % 3}]") for i in range(60)]
    ex = examples(spark, rows + [("s0", 99, "plain", "plain"), ("s2", 1, "none", "none")])
    vo = V.slot_vocabulary(ex, 3)
    small, large = G.generate(ex, vo, small=True), G.generate(ex, vo, small=False)
    assert texts(small) == texts(large) and len(texts(small)) > 400


def test_unknown_slot_keeps_the_original(spark):
    ex = examples(spark, [("s", 1, "go, x", "go, [city : x] [other : y]")])
    vo = vocab_df(spark, [("s", "city", 1, "a", 1)])
    rows = G.generate(ex, vo, unknown_slot="original_only", commas="space").collect()
    assert [(r["utterance"], r["pattern"]) for r in rows] == [("go  x", "go  {SLOT} {SLOT}")]


def test_retain_last_counts(spark):
    rows = [("s", i, f"say {i}", f"say [word : {i}]") for i in range(7)]
    ex = examples(spark, rows).withColumn("label_rank", F.col("ex_id"))
    for k, n in ((1, 13), (2, 19)):
        vo = V.slot_vocabulary(ex, k)
        assert G.generate(ex, vo).count() == n
    assert G.retain_groups(G.generate(ex, V.slot_vocabulary(ex, 1)), "last").count() == 2


def test_decontamination_and_report(spark):
    ex = examples(spark, [("s", 1, "Go  Zürich", "Go  [city : Zürich]"), ("s", 2, "go Rome", "go [city : Rome]"),
                          ("s", 3, "  GO  secret\t", "  GO  [city : secret]\t")])
    held = spark.createDataFrame([("s", "go SECRET"), ("s", "go rome")], "source string, utterance string")
    keys = S.heldout_keys(held, scope=["source"])
    kept = S.decontaminate(ex, keys, scope=["source"])
    assert sorted(r["utterance"] for r in kept.collect()) == ["Go  Zürich"]
    vo = vocab_df(spark, [("s", "city", 1, "Zürich", 1), ("s", "city", 2, "Rome", 1)])
    gen = G.generate(kept, vo)
    report = G.generation_report(gen, keys, ["source"]).first()
    assert (report["train_examples"], report["output_rows"], report["removed_rows"]) == (1, 1, 1)
    out, seen = G.observed_output(gen, keys, ["s"], ["source"])
    assert [r["utterance"] for r in out.collect()] == ["Go  Zürich"]
    assert seen.get["s_removed_rows"] == 1 and seen.get["s_output_rows"] == 1


def test_depth_sweep_matches_separate_runs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        c, d = rng.choice("abcdef"), rng.choice(["x", "xy", "y", "yx"])
        rows.append(("s", i, f"go {c}{d} now", f"go [city : {c}][day : {d}] now"))
    ex = examples(spark, rows)
    vo = V.slot_vocabulary(ex, 4)
    got = {r["k"]: r["rows"] for r in G.depth_sweep(ex, vo, [0, 1, 2, 3, 4], ["source"]).collect()}
    for k in (1, 2, 3, 4):
        assert got[k] == G.generate(ex, V.slot_vocabulary(ex, k)).count()
    assert got[0] == 80


def test_source_rows_are_dense_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(G, "BUCKET_ROWS", 3)
    rows = [("s" if i % 3 else "t", i, f"go {i % 5}", f"go [n : {i % 5}]") for i in range(40)]
    ex = examples(spark, rows)
    out = G.number_source_rows(G.generate(ex, V.slot_vocabulary(ex, 4)))
    for s in ("s", "t"):
        got = [r["source_row"] for r in out.filter(F.col("source") == s).orderBy("ex_id", "variant").collect()]
        assert got == list(range(len(got)))
    assert texts(out.repartition(16)) == texts(out.repartition(1))


def test_per_example_counting(spark):
    ex = examples(spark, [("s", 1, "x x y", "[w : x] [w : x] [w : y]"), ("s", 2, "y", "[w : y]")])
    occ = {(r["value"], r["cnt"]) for r in V.slot_frequencies(V.slot_occurrences(ex)).collect()}
    per = {(r["value"], r["cnt"]) for r in V.slot_frequencies(V.slot_occurrences(ex, "per_example")).collect()}
    assert occ == {("x", 2), ("y", 2)} and per == {("x", 1), ("y", 2)}


def test_literal_bracket_masks_but_is_no_entity(spark):
    df = spark.createDataFrame([("s", 1, "time in [ country ]", "time in [ country ]")], "source string, ex_id bigint, utterance string, a string")
    ex = df.withColumn("parts", A.legacy_brackets_to_parts(F.col("a"))).drop("a")
    rows = G.generate(ex, vocab_df(spark, []), unknown_slot="original_only").collect()
    assert [(r["utterance"], r["pattern"]) for r in rows] == [("time in [ country ]", "time in {SLOT}")]


def test_pooled_and_isolated_heldout(spark):
    from slotweave.plans import corpus

    rows = [("m", 1, "massive own", "massive own", "train"), ("m", 2, "held m", "held m", "test"),
            ("h", 3, "cross source", "cross source", "train"), ("h", 4, "massive own", "massive own", "test"),
            ("m", 5, "Cross  Source", "Cross  Source", "valid")]
    df = spark.createDataFrame(rows, "source string, ex_id bigint, utterance string, annotation string, split string")
    df = df.withColumn("parts", A.parse_annotation(F.col("annotation"))).drop("annotation")
    isolated = {r["utterance"] for r in corpus.augment(df, 2, ["source"]).collect()}
    pooled = {r["utterance"] for r in corpus.augment(df, 2, []).collect()}
    assert isolated == {"massive own", "cross source"} and pooled == set()


@pytest.mark.parametrize("sizes, cap", [([3000], None), ([3, 2500, 2], None), ([5000, 1, 1], 4321), ([2, 1, 2100], 3000), ([1000, 1000, 1000], 9_000), ([7, 2049], 2050)])
def test_counters_are_cut_inside_wide_slots(spark, monkeypatch, sizes, cap):
    """Slots with more values than a chunk, and 10^9 combinations under a cap, in order and without gaps."""
    monkeypatch.setattr(G, "RANGE", 3)
    monkeypatch.setattr(G, "RANGES", 5)
    values = [[f"{chr(97 + i)}{n}" for n in range(size)] for i, size in enumerate(sizes)]
    annotation = " ".join(f"[{chr(112 + i)} : x]" for i in range(len(sizes)))
    ex = examples(spark, [("s", 1, " ".join("x" for _ in sizes), annotation)])
    vo = vocab_df(spark, [("s", chr(112 + i), n + 1, v, 1) for i, vs in enumerate(values) for n, v in enumerate(vs)])
    got = {r["variant"]: r["utterance"] for r in G.generate(ex, vo, cap=cap).select("variant", "utterance").collect()}
    want = {0: " ".join("x" for _ in sizes)}
    want |= {n + 1: " ".join(c) for n, c in enumerate(itertools.islice(itertools.product(*values), cap))}
    assert got == want


def test_depths_inside_wide_slots(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 8)
    ex = examples(spark, [("s", 1, "x y", "[p : x] [q : y]")])
    vo = vocab_df(spark, [("s", k, n + 1, f"{k}{n}", 1) for k, size in (("p", 30), ("q", 3)) for n in range(size)])
    got = G.expand(G.plan_examples(ex.withColumn("pattern", F.lit("")), vo), with_depth=True).collect()
    assert {(r["utterance"], r["depth"]) for r in got} == {("x y", 0)} | {(f"p{a} q{b}", max(a, b) + 1) for a in range(30) for b in range(3)}
