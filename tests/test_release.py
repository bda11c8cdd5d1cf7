import json

import pytest
from pyspark.sql import functions as F

from slotweave.operators import digest as D
from slotweave.operators import gate as G
from slotweave.operators import packaging as P
from slotweave.operators import seeds as Z
from slotweave.operators import splits as S
from slotweave.operators import vocab as V
from slotweave.sources import ordinals as O
from slotweave.sources import readers as R
from slotweave.sources import writers as W


def test_rounding(spark):
    df = spark.createDataFrame([("163K",), ("13.1K",), ("39",), ("0.6K",), ("1.25K",)], "d string")
    low, high = G.rounded_interval(F.col("d"))
    got = {r["d"]: (r["a"], r["b"]) for r in df.select("d", low.alias("a"), high.alias("b")).collect()}
    assert got == {"163K": (162500, 163500), "13.1K": (13050, 13150), "39": (39, 40), "0.6K": (550, 650), "1.25K": (1245, 1255)}
    targets = spark.createDataFrame([(n, "163K") for n in ("a", "b", "c", "d", "e")], "name string, display string")
    actual = spark.createDataFrame([("a", 162499), ("b", 162500), ("c", 163499), ("d", 163500)], "name string, actual bigint")
    rows = {r["name"]: r["passed"] for r in G.count_checks(actual, targets, ["name"]).collect()}
    assert rows == {"a": False, "b": True, "c": True, "d": False, "e": False}


def test_gate(spark):
    m = spark.createDataFrame([("atis", "prepared", 2, None, 0), ("hwu", "missing", 3, 9, 1)],
                              "source string, status string, top_k int, cap int, truncated int")
    checks = G.settings_checks(m, V.TOP_K)
    assert {r["name"] for r in G.failures(checks).collect()} == {"hwu.prepared", "hwu.uncapped"}
    assert not G.eligible(checks).first()["eligible"]
    assert not G.eligible(checks.limit(0)).first()["eligible"]
    assert G.membership_check(m, "source", ["atis", "hwu"], "x").first()["passed"]
    assert not G.membership_check(m, "source", ["atis"], "x").first()["passed"]


def test_digest(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", i % 3) for i in range(100)], "p bigint, t string, n int")
    one = lambda d: D.ordered_digest(d, ["t", "n"], "p", fanout=4, levels=4).first()["digest"]
    base = one(df)
    assert one(df.repartition(7)) == base
    swapped = df.withColumn("p", F.when(F.col("p") == 3, 4).when(F.col("p") == 4, 3).otherwise(F.col("p")).cast("bigint"))
    assert one(swapped) != base
    assert one(df.filter("p < 99")) != base


def test_round_trip(spark, tmp_path):
    text = "  café\nhello\r\n世界, \"q\" \\ "
    rows = spark.createDataFrame(
        [(text, "{SLOT}", 1, "a", 0), (text, "{SLOT}", 1, "a", 1), ("x", "x", 0, "b", 0)], W.RELEASED_SCHEMA)
    path = str(tmp_path / "rel")
    ok = G.check_rows(spark.range(1), F.lit("x"), F.lit(True))
    assert not P.package(rows, G.check_rows(spark.range(1), F.lit("x"), F.lit(False)), path)
    assert P.package(rows, ok, path)
    assert all(r["verified"] for r in P.verify_round_trip(spark, rows, path).collect())
    other = rows.withColumn("utterance", F.when(F.col("source") == "b", "y").otherwise(F.col("utterance")))
    assert {r["source"]: r["verified"] for r in P.verify_round_trip(spark, other, path).collect()} == {"a": True, "b": False}
    assert W.read_released(spark, path, "b").count() == 1
    with pytest.raises(Exception):
        W.write_per_source_parquet(rows, path)
    csv = str(tmp_path / "c.csv")
    W.write_csv(rows.select("utterance", "pattern"), csv)
    back = R._csv(spark, csv, ",").collect()
    assert sorted(r["utterance"] for r in back) == sorted([text, text, "x"])
    with pytest.raises(Exception, match="unescaped comma"):
        W.write_flat_csv(rows, str(tmp_path / "flat"))


def test_seeds(spark):
    rows = []
    for c, base in (("a", (72, 74, 76)), ("b", (73, 76, 79))):
        rows += [(c, 42 + i, t, float(v)) for i, v in enumerate(base) for t in ("x", "y")]
    s = spark.createDataFrame(rows, "condition string, seed int, task string, accuracy double")
    m = {(r["condition"], r["task"]): r for r in Z.seed_summary(s, ("a", "b")).collect()}
    assert (m["a", "macro"]["mean"], m["b", "macro"]["mean"]) == (74, 76)
    assert (m["a", "macro"]["sample_std"], m["b", "macro"]["sample_std"]) == (2, 3)
    d = {r["task"]: r for r in Z.delta_summary(Z.paired_deltas(s, ("a", "b"))).collect()}
    assert (d["macro"]["mean"], d["macro"]["sample_std"], d["macro"]["n"]) == (2, 1, 3)
    lone = s.filter((F.col("condition") == "a") | (F.col("seed") == 42))
    assert {r["sample_std"] for r in Z.seed_summary(lone, ("a", "b")).collect()} == {None}


def test_run_results(spark, tmp_path):
    good = {"benchmark_sha256": "a" * 64, "source_unchanged": True,
            "export_audit": {"source_unchanged": True, "reload_max_abs_diff": 0},
            "test_diagnostics": {"x": {"accuracy": 71.0}}}
    (tmp_path / "r1.json").write_text(json.dumps(good))
    (tmp_path / "r2.json").write_text("{broken")
    (tmp_path / "r3.json").write_text(json.dumps({**good, "benchmark_sha256": "zz", "test_diagnostics": {"x": {"accuracy": 101}}}))
    grid = spark.createDataFrame([("a", 1, "r1.json"), ("a", 2, "r2.json"), ("b", 1, "r3.json"), ("b", 2, "r4.json")],
                                 "condition string, seed int, file string")
    res = R.read_run_results(spark, grid, str(tmp_path))
    assert {r["file"] for r in Z.missing_runs(res).collect()} == {"r2.json", "r4.json"}
    assert {r["problem"] for r in Z.run_problems(res, ["x"]).collect()} == {"invalid digest", "invalid accuracy"}
    assert not Z.digest_agreement(res).first()["agree"]
    assert Z.run_scores(res).filter("condition = 'a'").first()["accuracy"] == 71.0


def test_splits(spark):
    rows = spark.createDataFrame(
        [("train", "same", "a"), ("train", " SAME ", "a"), ("valid", "new", "a"), ("valid", "Same", "b"),
         ("test", "same", "c"), ("test", "same", "a"), ("test", "NEW", "a"), ("test", "own", "a"), ("test", "own", "a")],
        "split string, utterance string, intent string")
    a = S.split_audit(rows).first()
    assert (a["train_duplicates"], a["train_test_overlap"], a["train_valid_overlap"], a["test_rows"]) == (1, 2, 1, 5)
    assert [r["intent"] for r in S.absent_intents(rows).collect()] == ["c"]
    c = S.cascade(rows)
    assert c.filter("excluded and split = 'valid'").count() == 1 and c.filter("excluded and split = 'test'").count() == 3
    assert c.filter("not excluded and split = 'test'").count() == 2
    train = spark.createDataFrame([("OWN ",)], "utterance string")
    assert S.flag_training_overlap(rows, train).filter("excluded").count() == 2
    valid, test = rows.filter("utterance = 'new'"), rows.filter("utterance in ('new','own')")
    routed = {r["utterance"]: r["split2"] for r in S.route_by_membership(rows.drop("split"), valid, test).withColumnRenamed("split", "split2").collect()}
    assert routed["new"] == "valid" and routed["own"] == "test" and routed["same"] == "train"
    assert S.exact_partition(rows, valid, test, "train").count() == 6
    assert S.bag_difference(rows, rows.dropDuplicates(), ["split", "utterance", "intent"]).first()["left_count"] == 2
    assert S.bag_difference(rows, rows, ["utterance"]).count() == 0
    ids = spark.range(500).withColumn("split", F.when(F.col("id") < 400, "a").otherwise("b"))
    s1 = S.seeded_sample(ids, 30, 7, "id", ["split"])
    assert {r["split"]: r["count"] for r in s1.groupBy("split").count().collect()} == {"a": 30, "b": 30}
    assert set(s1.collect()) == set(S.seeded_sample(ids.repartition(9), 30, 7, "id", ["split"]).collect())
    lab = S.label_vocabulary(rows)
    assert [(r["intent"], r["label_idx"]) for r in lab.orderBy("label_idx").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    unk = spark.createDataFrame([("UNK", 0), ("a", 1)], "intent string, label_idx bigint")
    assert {(r["intent"], r["label_idx"]) for r in S.label_index(rows, unk).collect()} == {("a", 1), ("b", 0), ("c", 0)}


def test_scan_order_over_many_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.txt").write_text("".join(f"{f}-{i} some text to fill the line\n" for i in range(400 * (f + 1))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = O.scan_order(spark.read.text(str(tmp_path))).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"{f}-{i}" for f in range(3) for i in range(400 * (f + 1))]
    assert [r["value"].split(" ")[0] for r in rows] == want
    assert [r["ord"] for r in rows] == list(range(len(want)))


def test_readers(spark, tmp_path):
    def put(name, data):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(p)

    p = put("m.jsonl", json.dumps({"id": "7", "partition": "dev", "utt": "go Zürich, please", "annot_utt": "go [city : Zürich], please",
                                   "intent": "x", "scenario": "y"}) + "\n")
    r = R.read_annotated_jsonl(spark, p).first()
    assert (r["id"], r["split"], r["utterance"]) == ("7", "valid", "go Zürich, please")
    bad = put("bad.jsonl", json.dumps({"partition": "other", "utt": "x"}) + "\n")
    with pytest.raises(Exception, match="unknown split"):
        R.read_annotated_jsonl(spark, bad).collect()

    nested = {"Play": [{"data": [{"text": "play "}, {"text": "Café", "entity": "name"}]}]}
    put("n/a.json", json.dumps(nested, ensure_ascii=False))
    put("n/b.json", json.dumps(nested, ensure_ascii=False).encode("latin-1"))
    got = R.read_part_json(spark, str(tmp_path / "n")).collect()
    assert {x["encoding"] for x in got} == {"utf-8", "latin-1"} and {x["utterance"] for x in got} == {"play Café"}

    span = {"rasa_nlu_data": {"common_examples": [
        {"text": "book Boston", "intent": "flight", "entities": [{"start": 5, "end": 11, "entity": "city", "value": "Boston"}]},
        {"text": "Rome", "intent": "city", "entities": [{"start": 1, "end": 5, "entity": "city", "value": "Rome"}]}]}}
    got = R.spans_to_examples(R.read_span_json(spark, put("s.json", json.dumps(span)))).orderBy("ord").collect()
    assert [x["repaired"] for x in got] == [False, True] and got[1]["parts"][1]["value"] == "Rome"

    head = ";".join(R.SEMICOLON_COLUMNS)
    p = put("h.csv", head + '\n1;1;alarm;set;x;"wake [time : 9; am]";n;s;"wake 9; am";a;q\n1;2;alarm;set;x;y;n;s;;a;q\n')
    got = R.read_semicolon_csv(spark, p).collect()
    assert [(x["utterance"], x["annotation"]) for x in got] == [("wake 9; am", "wake [time : 9; am]")]

    put("fold/trainset/a.csv", "scenario;intent;answer_from_anno\nalarm;set;wake me\n")
    put("fold/testset/a.csv", "scenario;intent;answer_from_anno\nalarm;off;stop\n")
    got = {(x["split"], x["intent"]) for x in R.read_fold_csv(spark, [str(tmp_path / "fold/trainset"), str(tmp_path / "fold/testset")]).collect()}
    assert got == {("train", "alarm_set"), ("test", "alarm_off")}

    got = R.read_intent_csv(spark, put("i.csv", "﻿text,category\n\"alarm, on\",alarm_set\n")).collect()
    assert [(x["utterance"], x["intent"]) for x in got] == [("alarm, on", "alarm_set")]
    got = R.read_pair_csv(spark, put("p.csv", 'utt,ptn\n" a\nb ",{SLOT}\nc,d\n'), first=1).collect()
    assert [(x["utterance"], x["pattern"]) for x in got] == [("a\nb", "{SLOT}")]
    with pytest.raises(Exception, match="empty"):
        R.read_pair_csv(spark, put("e.csv", "utt,ptn\n ,x\n")).collect()

    doc = {"train": [["one,two", "a"]], "oos_train": [["outside", "oos"]], "val": [["v", "a"]]}
    got = {(x["split"], x["is_oos"], x["utterance"]) for x in R.read_split_json(spark, put("c.json", json.dumps(doc))).collect()}
    assert got == {("train", False, "one,two"), ("train", True, "outside"), ("valid", False, "v")}

    p = put("l.log", "x\nText : go Paris - 2\nent : z\nPtn : go [GPE : Paris]\nText : hi - 3 - 4\nPtn : hi\n")
    got = R.read_annotation_log(spark, p).orderBy("pair").collect()
    assert [(x["utterance"], x["annotation"]) for x in got] == [("go Paris", "go [GPE : Paris]"), ("hi - 3", "hi")]
    with pytest.raises(Exception, match="unpaired"):
        R.read_annotation_log(spark, put("u.log", "Text : a - 1\nText : b - 1\nPtn : b\n")).collect()
    with pytest.raises(Exception, match="unpaired"):
        R.read_annotation_log(spark, put("u2.log", "Text : a - 1\n")).collect()

    put("j/seq.in", "book flight\nhello\n")
    put("j/seq.out", "O O\nO\n")
    put("j/label", "flight\ngreet\n")
    got = R.read_parallel_files(spark, str(tmp_path / "j"), {"utterance": "seq.in", "bio": "seq.out", "intent": "label"}, ("utterance", "bio"))
    assert [x["intent"] for x in got.orderBy("ord").collect()] == ["flight", "greet"]
    put("j/label", "flight\n")
    with pytest.raises(Exception, match="unaligned"):
        R.read_parallel_files(spark, str(tmp_path / "j"), {"utterance": "seq.in", "intent": "label"}).collect()

    ev = [{"utterance": "u", "template": "t {SLOT}", "slots": [{"type": "c", "value": "v"}]}, {"utterance": "u", "template": " ", "slots": []},
          {"utterance": "u", "template": "t", "slots": [{"type": "c", "value": ""}]}]
    got = R.read_evidence_jsonl(spark, put("ev.jsonl", "\n".join(map(json.dumps, ev)) + "\n{bad\n")).orderBy("line").collect()
    assert [x["valid"] for x in got] == [True, False, False, False]

    spark.createDataFrame([("{b}",), ("{a}",)], "slot string").coalesce(1).write.parquet(str(tmp_path / "slots"))
    assert [x["slot"] for x in R.read_slot_list(spark, str(tmp_path / "slots")).orderBy("rank").collect()] == ["{b}", "{a}"]
    assert [x["pattern"] for x in R.read_pairs(spark, put("x_tsv.csv", "q\tz\n1\t2\n")).collect()] == ["2"]
    assert [x["text"] for x in R.read_lines(spark, put("t.txt", "a  \nb\n")).orderBy("ord").collect()] == ["a", "b"]

    spans = spark.createDataFrame([(1, 3, 8, "GPE")], "doc_id bigint, start int, stop int, label string")
    texts = spark.createDataFrame([(1, "go Paris"), (2, "hi")], "doc_id bigint, text string")
    got = {x["doc_id"]: x["annotation"] for x in R.spans_table_to_annotation(texts, spans).collect()}
    assert got == {1: "go [GPE : Paris]", 2: "hi"}
    assert R.tag_spans(texts, "text", {"N": "Par[a-z]+"}).filter("doc_id = 1").first()["annotation"] == "go [N : Paris]"


def test_parallel_writer_and_checksums(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("ord"), F.concat(F.lit("u"), "id").alias("utterance"),
                                  F.lit("p").alias("pattern"), (F.col("id") % 3).cast("string").alias("intent")).repartition(5)
    W.write_parallel_files(rows, str(tmp_path / "out"))
    back = R.read_parallel_files(spark, str(tmp_path / "out")).orderBy("ord").collect()
    assert [r["utterance"] for r in back] == [f"u{i}" for i in range(50)] and back[4]["intent"] == "1"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a").write_text("x")
    before = D.file_checksums(spark, str(tmp_path / "f")).collect()
    b = spark.createDataFrame(before)
    (tmp_path / "f/a").write_text("y")
    assert D.changed_files(b, D.file_checksums(spark, str(tmp_path / "f"))).count() == 1


def test_reports_and_projection(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, -1.0, "0:Pattern", "play {SLOT}, now")], "x double, y double, label string, value string")
    W.write_projection(rows, str(tmp_path / "plot"))
    assert R._csv(spark, str(tmp_path / "plot"), ",").first()["value"] == "play {SLOT}, now"
    W.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["y"] == -1.0
    with pytest.raises(Exception):
        W.write_report(rows, str(tmp_path / "report"))


def test_only_differing_ranges_are_read(spark, tmp_path, monkeypatch):
    """One planted row of 40,000: the trees part in one leaf, and rows of that leaf alone are compared."""
    rows = spark.range(40_000).select(
        F.concat(F.lit("u"), "id").alias("utterance"), F.lit("p").alias("pattern"), F.lit(0).cast("long").alias("slot_count"),
        F.when(F.col("id") < 30_000, "a").otherwise("b").alias("source"), F.when(F.col("id") < 30_000, F.col("id")).otherwise(F.col("id") - 30_000).alias("source_row"))
    wrong = (F.col("source") == "a") & (F.col("source_row") == 12_345)
    other = rows.withColumn("utterance", F.when(wrong, "x").otherwise(F.col("utterance")))
    columns, read = ["utterance", "pattern", "slot_count"], []
    expected, actual = (D.leaf_digests(df, columns, "source_row", ["source"]) for df in (rows, other))
    ranges = D.differing_ranges(expected, actual, ["source"])
    assert [tuple(r) for r in ranges.collect()] == [("a", 12_345 // D.FANOUT)]
    plain = P.content_differences
    monkeypatch.setattr(P, "content_differences", lambda a, b, *rest: read.extend([a.count(), b.count()]) or plain(a, b, *rest))
    assert [tuple(r) for r in P.changed_rows(rows, other, columns, expected, actual).collect()] == [("a", 12_345)]
    assert read == [D.FANOUT, D.FANOUT]
    # A missing row, a repeated number and a gap are told by the leaves, too.
    for bad in (rows.where("NOT (source = 'b' AND source_row = 9999)"), rows.unionByName(rows.where("source = 'b' AND source_row = 5")),
                rows.withColumn("source_row", F.when((F.col("source") == "b") & (F.col("source_row") > 700), F.col("source_row") + 1).otherwise(F.col("source_row")))):
        path = str(tmp_path / f"r{len(read)}")
        read.append(0)
        W.write_per_source_parquet(bad, path)
        assert {r["source"]: r["verified"] for r in P.verify_round_trip(spark, rows, path).collect()} == {"a": True, "b": False}
