"""Single JSON documents read in ranges, and checksums of whole files."""

import hashlib
import json

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slotweave.operators import digest
from slotweave.plans.catalogue import sources as catalogue_sources
from slotweave.sources import documents as D
from slotweave.sources import readers as R

NASTY = ['a } b', '"quoted" } {', 'back\\slash\\', '\\"}', ']}{[', 'Zürich 東京 🙂', '', '\n\t', 'x' * 200, '{"data": [']


def nested():
    return {f"intent {k} {NASTY[k]}": [{"data": [{"text": t}, {"text": NASTY[-i % len(NASTY)], "entity": "kind}"}]} for i, t in enumerate(NASTY * 3)] for k in range(4)} | {
        "empty": [], "last": [{"data": []}, {"data": [{"text": "end"}]}]}


def write(folder, name, text):
    path = folder / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def expected(doc):
    return sorted((k, i, "".join(p["text"] for p in row["data"])) for k, rows in doc.items() for i, row in enumerate(rows))


@pytest.mark.parametrize("chunk", [1, 1 << 20])
@pytest.mark.parametrize("style", [{"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_nested_document_in_chunks(spark, tmp_path, chunk, style):
    """Chunks end behind every bracket, also inside strings and behind escapes."""
    path = write(tmp_path, "a.json", json.dumps(nested(), **style) + "\n \n")
    rows = R.read_part_json(spark, path, chunk_bytes=chunk)
    assert sorted((r["intent"], r["pos"], r["utterance"]) for r in rows.collect()) == expected(nested())


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    doc = {f"i{k}": [{"data": [{"text": f"{t} {n}"}]} for n in range(400) for t in NASTY] for k in range(3)}
    path = write(tmp_path, "large.json", json.dumps(doc))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        held = D.chunks(spark, path, "}", 10_000, states=True)
        assert held.select("start").distinct().count() > 5
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
        rows = R.read_part_json(spark, path, chunk_bytes=10_000)
        assert sorted((r["intent"], r["pos"], r["utterance"]) for r in rows.collect()) == expected(doc)
        assert [tuple(r) for r in digest.file_checksums(spark, path).select("length", "sha256").collect()] == [
            (len(json.dumps(doc)), hashlib.sha256(json.dumps(doc).encode()).hexdigest())]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_encodings_by_file(spark, tmp_path):
    doc = {"café": [{"data": [{"text": "Zürich"}]}, {"data": [{"text": "ascii"}]}]}
    write(tmp_path, "latin.json", json.dumps(doc, ensure_ascii=False).encode("latin-1"))
    write(tmp_path, "utf8.json", "﻿" + json.dumps(doc, ensure_ascii=False))
    for chunk in (1, 1000):
        got = R.read_part_json(spark, str(tmp_path), chunk_bytes=chunk).collect()
        assert sorted((r["encoding"], r["intent"], r["utterance"]) for r in got) == [
            ("latin-1", "café", "Zürich"), ("latin-1", "café", "ascii"), ("utf-8", "café", "Zürich"), ("utf-8", "café", "ascii")]
    forced = R.read_part_json(spark, str(tmp_path / "latin.json"), encoding="ISO-8859-1").collect()
    assert {r["encoding"] for r in forced} == {"iso-8859-1"} and "Zürich" in {r["utterance"] for r in forced}


def test_span_and_split_documents(spark, tmp_path):
    examples = [{"text": t, "intent": f"{i} }}", "entities": [{"start": 0, "end": 1, "entity": "e", "value": "}"}]} for i, t in enumerate(NASTY)]
    doc = {"version": {"a": {"b": 1}}, "rasa_nlu_data": {"regex_features": [{"name": "x", "pattern": "}"}], "common_examples": examples, "entity_synonyms": [{"value": "y"}]}}
    path = write(tmp_path, "rasa.json", json.dumps(doc))
    for chunk in (1, 1000):
        got = sorted(R.read_span_json(spark, path, chunk_bytes=chunk).collect(), key=lambda r: r["ord"])
        assert [(r["ord"], r["utterance"], r["intent"], r["spans"][0]["value"]) for r in got] == [(i, t, f"{i} }}", "}") for i, t in enumerate(NASTY)]
    splits = {"train": [[t, f"] {i}"] for i, t in enumerate(NASTY)], "oos_val": [["a ] b", "[oos"]], "test": []}
    path = write(tmp_path, "splits.json", json.dumps(splits))
    for chunk in (1, 1000):
        got = R.read_split_json(spark, path, chunk_bytes=chunk).collect()
        assert sorted((r["split"], r["is_oos"], r["pos"], r["utterance"], r["intent"]) for r in got) == sorted(
            [("train", False, i, t, f"] {i}") for i, t in enumerate(NASTY)] + [("valid", True, 0, "a ] b", "[oos")])


@pytest.mark.parametrize("text", ['{"a": [{"data": []}', '{"a": [{"data": []}]', '{"a": [{"data": [{"text": "x}]}]}', '{"a": [{"data": []}]}}'])
def test_malformed_documents_stop_the_job(spark, tmp_path, text):
    path = write(tmp_path, "bad.json", text)
    with pytest.raises((ValueError, PySparkException)):
        R.read_part_json(spark, path).collect()


def test_empty_documents(spark, tmp_path):
    assert R.read_part_json(spark, write(tmp_path, "none.json", "")).collect() == []
    assert R.read_part_json(spark, write(tmp_path, "bare.json", "{}")).collect() == []
    assert R.read_part_json(spark, write(tmp_path, "lists.json", '{"a": [], "b": []}')).collect() == []


def test_checksums_of_any_bytes(spark, tmp_path):
    contents = {"b": b"\n", "c": b"one\ntwo", "d": b"one\r\ntwo\n\n", "e": bytes(range(256)) * 50, "f": b"no break " * 3000}
    for name, data in contents.items():
        write(tmp_path, name, data)
    for chunk in (1, 1 << 20):
        got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in D.checksums(spark, str(tmp_path), chunk).collect()}
        assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}


def test_walk_agrees_from_any_cut():
    text = json.dumps(nested()).encode()
    inside, depth, whole = False, 0, []
    for piece in text.split(b"}")[:-1]:
        inside, more = D.walk(piece, inside)
        depth += more - (not inside)
        whole.append((inside, depth))
    assert whole[-1] == (False, 0)
    pieces = text.split(b"}")[:-1]
    for at in range(1, len(pieces)):
        a, b = D.effect(pieces[:at]), D.effect(pieces[at:])
        assert (a[0] ^ b[0], a[1] + (b[2] if a[0] else b[1])) == (False, 0)


def test_cutter_gives_a_batch_a_chunk():
    """What a batch of chunks holds leaves chunk by chunk, not as one list of all its elements."""
    data = [b'{"a":[{"t":1},{"t":2}', b',{"t":3},{"t":4}', b',{"t":5}]}']
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["f"] * 3), pa.array([0, 1, 2]), pa.array(data, pa.binary()), pa.array([False] * 3), pa.array([0, 2, 2])],
        names=["file", "number", "data", "inside", "depth"])
    out = list(D._cutter(b"{", b"}", 2)(iter([batch])))
    assert len(out) == 3 and all(b.column("number").to_pylist() == [n] * b.num_rows for n, b in enumerate(out))
    assert [x for b in out for x, i in zip(b.column("data").to_pylist(), b.column("i").to_pylist()) if i] == [b'{"t":2}', b'{"t":4}']


def test_documents_are_few_however_many_keys(spark):
    """An id range is one document with an array for each of its keys."""
    rows = spark.range(4000).selectExpr("id", "concat('k', id % 150) AS name", "named_struct('data', array(named_struct('text', concat('t', id)))) AS row")
    found = [json.loads(r[0]) for r in catalogue_sources._keyed_documents(rows, "name", F.col("row"), "id").collect()]
    assert len(found) == 2
    got = sorted((k, x["data"][0]["text"]) for doc in found for k, values in doc.items() for x in values)
    assert got == sorted((f"k{i % 150}", f"t{i}") for i in range(4000))
