"""The dictionary tagger, replaced reports and the uniformity sketch."""

import random
import threading
import tracemalloc

import numpy as np
import pytest

from slotweave.operators import pairs, tagger
from slotweave.sources import readers as R
from slotweave.sources import writers as W


def brute(text, terms, whole):
    """Leftmost-longest by trying every place."""
    out, at, groups = [], 0, [m.span() for m in tagger._GROUP.finditer(text)]
    while at < len(text):
        inside = next((g for g in groups if g[0] <= at < g[1]), None)
        if inside:
            at = inside[1]
            continue
        stop_at = min((g[0] for g in groups if g[0] >= at), default=len(text))
        best = None
        for term, label in sorted(terms):
            end = at + len(term)
            if end > stop_at or text[at:end] != term or best and len(term) <= best[1] - best[0]:
                continue
            if whole and (at and text[at - 1].isalnum() and text[at].isalnum() or end < len(text) and text[end].isalnum() and text[end - 1].isalnum()):
                continue
            best = (at, end, label)
        if best:
            out.append(best)
        at = best[1] if best else at + 1
    return out


@pytest.mark.parametrize("whole, part", [(False, 1000), (True, 1000), (False, 3)])
def test_spans_equal_brute_force(spark, whole, part):
    rng = random.Random(5)
    terms = [("ab", "X"), ("abc", "Y"), ("bc", "X"), ("b", "Z"), ("c a", "Y"), ("é🙂", "E"), ("a", "Z"), ("cab", "X"), ("a", "A")]
    texts = ["".join(rng.choice("abc é🙂.[]:") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, "[EMAIL : ab] ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    known = spark.createDataFrame([*terms, ("", "N"), (None, "N"), ("q", None)], "term string, label string")
    first = {}
    for term, label in sorted(terms):
        first.setdefault(term, label)
    got = {r["id"]: r for r in tagger.tag_dictionary(df, "t", known, whole, part).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i]["spans"] is None and got[i]["annotation"] is None
            continue
        want = brute(text, list(first.items()), whole)
        assert [tuple(s) for s in got[i]["spans"]] == want
        marked, at = "", 0
        for a, b, label in want:
            marked += text[at:a] + f"[{label} : {text[a:b]}]"
            at = b
        assert got[i]["annotation"] == marked + text[at:]


def test_dictionary_after_patterns(spark):
    df = spark.createDataFrame([("mail a.b@c.de or the berlin office 42",)], "t string")
    once = R.tag_spans(df, "t", {"EMAIL": r"[a-z.]+@[a-z.]+"})
    out = tagger.tag_dictionary(once, "annotation", spark.createDataFrame([("berlin", "CITY"), ("b", "LETTER"), ("berlin office", "PLACE")], "term string, label string"))
    assert out.first()["annotation"] == "mail [EMAIL : a.b@c.de] or the [PLACE : berlin office] 42"


def test_reports_are_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    rows = lambda n: spark.createDataFrame([(n, f"v{n}")], "n int, name string")
    with pytest.raises(FileNotFoundError):
        W.read_report(spark, path)
    assert W.replace_report(rows(1), path) == 1 and W.replace_report(rows(2), path) == 2
    assert [tuple(r) for r in W.read_report(spark, path, "n int, name string").collect()] == [(2, "v2")]

    # A writer that dies before its commit leaves the old report.
    context = type(spark.sparkContext)
    with monkeypatch.context() as patch:
        patch.setattr(context, "_gateway", property(lambda self: (_ for _ in ()).throw(KeyboardInterrupt())))
        with pytest.raises(KeyboardInterrupt):
            W.replace_report(rows(3), path)
    assert W.report_version(spark, path) == 2 and W.read_report(spark, path).first()["n"] == 2

    # A writer that was overtaken is told so, and changes nothing.
    W.replace_report(rows(4), path, after=2)
    with pytest.raises(RuntimeError, match="another writer"):
        W.replace_report(rows(5), path, after=2)
    assert W.read_report(spark, path).first()["n"] == 4 and W.report_version(spark, path) == 3


def test_of_writers_at_once_one_wins(spark, tmp_path):
    path = str(tmp_path / "race")
    won, lost = [], []

    def write(n):
        try:
            won.append((W.replace_report(spark.createDataFrame([(n,)], "n int"), path, after=0), n))
        except RuntimeError:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 3
    assert W.read_report(spark, path).first()["n"] == won[0][1]


def test_sketch_is_within_its_bound(spark):
    rng = np.random.default_rng(3)
    for spread in (0.2, 1.0):
        m = rng.normal(scale=spread, size=(700, 6))
        d2 = ((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)[np.triu_indices(700, 1)]
        df = spark.createDataFrame([([float(x) for x in v],) for v in m], "vec array<double>").repartition(3)
        got = pairs.uniformity_sketch(df).first()
        assert got["pairs"] == 700 * 699 // 2
        assert abs(got["potential"] - np.exp(-2 * d2).mean()) <= got["bound"] < 0.05
    with pytest.raises(ValueError):
        pairs.uniformity_sketch(df.limit(0))


def test_many_spans_of_a_batch_are_no_objects():
    """A batch of crowded texts takes about its own size in Python, not an object for each span."""
    known = tagger.automaton([("a", "T")])
    texts = ["a b " * 1000] * 100
    tracemalloc.start()
    out = tagger._tagged_arrays((t, tagger.chosen(tagger.occurrences(known, t, False))) for t in texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 100 and out[99]["annotation"].as_py() == "[T : a] b " * 1000 and len(out[99]["spans"]) == 1000
    assert peak < 40 * 100 * 1000
