"""Cases a review found: caps, prefixes, diverging branches and formats read wrongly."""

import json
import time

import pytest
from pyspark.sql import functions as F

from slotweave import session
from slotweave.functions import annotation as A
from slotweave.operators import digest, encode, gate, generate, metrics, pairs, splits, vocab
from slotweave.sources import readers as R
from slotweave.sources.ordinals import number_sorted

PART = "struct<value:string,kind:string>"


def examples(spark, rows):
    return spark.createDataFrame(rows, f"source string, ex_id long, utterance string, parts array<{PART}>")


def vocabulary(spark, kinds, source="s"):
    rows = [(source, kind, i + 1, v, 9 - i) for kind, values in kinds.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "source string, kind string, rank int, value string, cnt long")


def test_slot_tokens_beyond_the_top_are_masked_whatever_their_number(spark):
    kinds = spark.createDataFrame([(f"k{i:05}", 20_000 - i) for i in range(12_000)], "kind string, n long")
    rows = spark.createDataFrame([(1, "{k00000} {k00001} {k11999} {other}"), (2, "none")], "id long, t string")
    got = {r["id"]: r["t"] for r in vocab.mask_beyond(rows, "t", kinds, 1).collect()}
    assert got == {1: "{k00000} {SLOT} {SLOT} {other}", 2: "none"}


def test_combination_counts_do_not_saturate(spark):
    parts = [("", "kind")] * 60
    ex = examples(spark, [("s", 1, "x", parts)])
    words = vocabulary(spark, {"kind": ["a", "b"]})
    assert generate.size_estimate(ex, words, ["source"]).first()["combinations"] == 2**60
    with pytest.raises(Exception, match="too many combinations"):
        generate.plan_examples(ex, words).select("total").collect()
    assert generate.plan_examples(ex, words, cap=7).first()["total"] == 7


def test_both_vocabulary_branches_agree(spark):
    rows = [("s", 1, "go a", [("go ", None), ("a", "k")]), ("s", 1, "see b", [("see ", None), ("b", "k")]),
            ("s", 2, "plain", [("plain", None)]), ("s", 2, "plain", [("plain", None)]), ("s", 3, "c c", [("c", "k"), (" ", None), ("c", "k")])]
    words = vocabulary(spark, {"k": ["a", "b", "c"]})
    made = [sorted(map(str, generate.generate(examples(spark, rows), words, small=small).select("ex_id", "variant", "utterance").collect()))
            for small in (True, False)]
    assert made[0] == made[1] and len(made[0]) > 10


def test_labels_with_a_common_prefix_are_numbered_in_order(spark):
    labels = [f"order_item_{i:05}" for i in range(3000)] + ["order_", "zz", "a"]
    df = spark.createDataFrame([(x,) for x in labels * 2], "intent string")
    got = {r["intent"]: r["label_idx"] for r in splits.label_vocabulary(df).collect()}
    assert got == {x: i for i, x in enumerate(sorted(set(labels)))}
    assert number_sorted(df.limit(0), ["intent"]).count() == 0


def test_digest_tree_grows_with_the_rows(spark):
    df = spark.range(300).select(F.col("id").alias("p"), F.col("id").cast("string").alias("t"))
    roots = digest.ordered_digest(df, ["t"], "p", fanout=4, levels=1).collect()
    assert [r["rows"] for r in roots] == [300]
    other = df.withColumn("t", F.when(F.col("p") == 299, "x").otherwise(F.col("t")))
    assert digest.ordered_digest(other, ["t"], "p", fanout=4, levels=1).first()["digest"] != roots[0]["digest"]


def test_displayed_counts_take_any_number_of_decimals(spark):
    df = spark.createDataFrame([("1.255K",), ("1.2555K",), ("2K",), ("0.25K",), ("17",)], "d string")
    low, high = gate.rounded_interval(F.col("d"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got == [(1255, 1256), (1256, 1256), (1500, 2500), (245, 255), (17, 18)]


def test_json_pairs_follow_the_order_of_the_file(spark, tmp_path):
    for first, second in (("utterance", "pattern"), ("pattern", "utterance"), ("zz", "aa")):
        path = tmp_path / f"{first}.json"
        path.write_text("\n" + "".join(json.dumps({first: f"u{i}", second: f"p{i}"}) + "\n" for i in range(3)))
        assert [tuple(r) for r in R.read_pairs(spark, str(path)).orderBy("ord").collect()] == [(i, f"u{i}", f"p{i}") for i in range(3)]


def test_evidence_lines_count_blank_ones(spark, tmp_path):
    good = json.dumps({"utterance": "u", "template": "t", "slots": []})
    (tmp_path / "e.jsonl").write_text(f"{good}\n\n{good}\n{{bad\n")
    got = [(r["line"], r["valid"]) for r in R.read_evidence_jsonl(spark, str(tmp_path / "e.jsonl")).orderBy("line").collect()]
    assert got == [(1, True), (2, False), (3, True), (4, False)]


def test_literal_brackets_are_not_counted_or_substituted(spark):
    df = spark.createDataFrame([("s", 1, "go [ country ] now", "go [ country ] [country : rome]")], "source string, ex_id long, utterance string, a string")
    ex = df.withColumn("parts", A.legacy_brackets_to_parts(F.col("a"))).drop("a")
    words = vocab.slot_vocabulary(ex, 5)
    assert [(r["kind"], r["value"]) for r in words.collect()] == [("country", "rome")]
    out = generate.generate(ex, words, unknown_slot="original_only").collect()
    assert [(r["variant"], r["pattern"]) for r in out] == [(0, "go {SLOT} {SLOT}")]


def test_pair_files_need_two_rows(spark, tmp_path):
    (tmp_path / "one.csv").write_text("utterance,pattern\na,b\n")
    with pytest.raises(Exception, match="too few rows"):
        R.read_pair_csv(spark, str(tmp_path / "one.csv")).collect()
    assert R.read_pair_csv(spark, str(tmp_path / "one.csv"), at_least=1, multiline=False).count() == 1


def test_counts_match_looks_at_tasks_present(spark):
    have = spark.createDataFrame([("a", 1.0, 10)], "task string, accuracy double, total long")
    want = spark.createDataFrame([("a", 2.0, 10), ("b", 3.0, 10)], "task string, target double, expected_total long")
    got = metrics.task_summary(have, want).first()
    assert got["counts_match"] and not got["all_tasks"]


def test_alignment_of_large_intent_sets(spark):
    start = time.time()
    rows = [(i, [f"i{j}" for j in range(i, i + 40)], [float(i), float(i * i % 5)]) for i in range(4)] + [(9, ["none"], [7.0, 7.0])]
    got = pairs.alignment(spark.createDataFrame(rows, "id long, intents array<string>, vec array<double>")).first()
    want = [sum((a - b) ** 2 for a, b in zip(x[2], y[2])) for i, x in enumerate(rows[:4]) for y in rows[i + 1:4]]
    assert got["same_intent_pairs"] == 6 and abs(got["alignment"] - sum(want) / 6) < 1e-9
    assert time.time() - start < 30


def test_broadcasts_are_bounded_by_rows_too(spark, monkeypatch):
    df = spark.range(100)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(session.broadcast_if_small(df))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 99)
    assert not hinted(session.broadcast_if_small(df))
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")


def test_masking_needs_no_row_key(spark):
    """Null and repeated keys keep rows of their own."""
    rows = spark.createDataFrame([(None, "go {a} {b}"), (None, "{b} x {c}"), (1, "{b}"), (1, "{a} {zz}"), (2, None), (3, "none")], "id int, t string")
    kinds = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "kind string, n int")
    got = sorted(((r["id"], r["t"]) for r in vocab.mask_beyond(rows, "t", kinds, 1).collect()), key=str)
    assert got == sorted([(None, "go {a} {SLOT}"), (None, "{SLOT} x {SLOT}"), (1, "{SLOT}"), (1, "{a} {zz}"), (2, None), (3, "none")], key=str)


def test_padding_keeps_rows_of_repeated_and_null_keys(spark):
    rows = [(1, "a b c d e f g"), (1, "b"), (None, "c zz a"), (None, None), (2, ""), (2, "")] + [(k % 3, "a " * (k % 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, text string")
    vocabulary = spark.createDataFrame([(w, i + 4) for i, w in enumerate("abcdefg")], "token string, token_id int")
    ids = {w: i + 4 for i, w in enumerate("abcdefg")}
    want = []
    for key, text in rows:
        own = [2, *[ids.get(w, 1) for w in (text or "").split()[:4]], 3]
        want.append((key, own + [0] * (6 - len(own)), [1] * len(own) + [0] * (6 - len(own)), [0] * 6))
    for limits in ({}, {"small": 0, "block_rows": 16}):
        got = [tuple(r) for r in encode.pad_truncate(df, vocabulary, 6, "id", **limits).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
