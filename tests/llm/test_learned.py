import math
import re
from collections import Counter

import numpy as np
import pytest

from slotweave.llm import common, quality, rules, toxicity

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def truth(tables, label):
    return {r["doc_id"]: r[label] for r in tables("labels").collect()}


def test_held_out_is_the_same_in_python(tables):
    for r in tables("documents").select("doc_id", common.held_out().alias("h")).collect():
        assert r["h"] == common.held_out_py(r["doc_id"])


def test_learning_rows_are_bounded_and_never_held_out(tables):
    got = common.labelled(tables("documents"), tables("labels"), "quality", 20).collect()
    assert len(got) == 20 and not any(common.held_out_py(r["doc_id"]) for r in got)


def test_quality_on_held_out_rows(tables):
    got = quality.classify(tables("documents"), tables("labels")).collect()
    known = truth(tables, "quality")
    assert len(got) == tables("documents").count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    good = [r["score"] for r in got if r["held_out"] and known.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in got if r["held_out"] and known.get(r["doc_id"]) == 0]
    assert min(good) > 0.3 and np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_toxicity_on_held_out_rows(tables):
    got = toxicity.classify(tables("documents"), tables("labels")).collect()
    known = truth(tables, "toxic")
    assert len(got) == tables("documents").count()
    clean = [r["predicted"] for r in got if r["held_out"] and known.get(r["doc_id"]) == 0]
    toxic = [r["predicted"] for r in got if r["held_out"] and known.get(r["doc_id"]) == 1]
    assert sum(clean) == 0 and sum(toxic) > 0


@pytest.mark.parametrize("operator", [quality.classify, toxicity.classify])
def test_odd_rows_and_no_labels(documents, labels, operator):
    some = labels([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 0, 1), (4, 1, 0)])
    for known in (some, labels([])):
        got = operator(documents(ODD), known).collect()
        assert len(got) == len(ODD) and all(r["score"] is not None and not math.isnan(r["score"]) for r in got)
        assert operator(documents([]), known).collect() == []


def test_regression_learns_a_plain_rule():
    features, model = quality.Features(), quality.Ftrl()
    texts = [(f"the {w} runs over some hill number {i}", 1) for i, w in enumerate("abcdefgh" * 5)]
    texts += [(f"win $$$ now!!! {w} {w} {w} click", 0) for w in "abcdefgh" * 5]
    for _ in range(10):
        for text, y in texts:
            model.learn(*features(text), y)
    w = model.weights(slice(None))
    score = lambda t: quality.logistic(float(w[features(t)[0]] @ features(t)[1]))
    assert score("the dog runs over some hill") > 0.7 > 0.3 > score("win $$$ now!!! dog dog click")


def brute_statistics(text):
    words = WORDS.findall(text)
    often = Counter(zip(words, words[1:], words[2:]))
    inside = {k + j for k in range(len(words) - 2) for j in range(3) if often[tuple(words[k:k + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), dup, len(inside), failed


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rules_base_equals_brute_force(tables, documents, labels):
    docs = tables("documents")
    got = {r["doc_id"]: r for r in rules.judge(docs, tables("labels")).collect()}
    for r in docs.collect():
        assert tuple(got[r["doc_id"]][c] for c in BASE) == brute_statistics(r["text"])
        assert not (got[r["doc_id"]]["base_failed"] and got[r["doc_id"]]["kept"])
    odd = [(i, t) for i, t in [*ODD, (20, "a b c a b c " * 30), (21, "x\ny\nx\n \n" * 40), (22, "a\xa0b \x1cc\x85d " * 60)]]
    got = sorted((tuple(r[c] for c in ["doc_id", *BASE]) for r in rules.judge(documents(odd), labels([])).collect()), key=str)
    assert got == sorted(((i, *brute_statistics(t or "")) for i, t in odd), key=str)
    assert rules.judge(documents([]), labels([])).collect() == []


def test_rules_reject_bad_and_keep_good_rows_held_out(tables):
    known = truth(tables, "quality")
    got = [r for r in rules.judge(tables("documents"), tables("labels")).collect() if common.held_out_py(r["doc_id"]) and not r["base_failed"]]
    assert all(r["kept"] for r in got if known.get(r["doc_id"]) == 1)


def test_covering_finds_a_conjunction_and_expressions_agree(spark):
    rng = np.random.default_rng(2)
    rows = rng.random((3000, len(rules.STATISTICS)))
    bad = (rows[:, 0] > 0.7) & (rows[:, 3] < 0.4) | (rows[:, 5] > 0.95)
    found = rules.learn(rows, bad)
    inside = np.zeros(len(rows), dtype=bool)
    for rule in found:
        inside |= rules.covered(rule, rows)
    assert (inside & bad).sum() > 0.9 * bad.sum() and (inside & ~bad).sum() < 0.02 * len(rows)
    df = spark.createDataFrame([(tuple(map(float, r)),) for r in rows[:200]], "s struct<" + ",".join(f"{n}:double" for n in rules.STATISTICS) + ">")
    kept = [r["k"] for r in df.select(rules.verdict(found, df["s"]).alias("k")).collect()]
    assert kept == (~inside[:200]).tolist()
    assert rules.learn(rows, np.zeros(len(rows), dtype=bool)) == []


def test_no_bound_on_rules_and_conditions():
    """Twenty separate bands of bad rows are twenty rules or more; a corner of six statistics is one rule of six conditions."""
    rng = np.random.default_rng(4)
    rows = rng.random((12_000, len(rules.STATISTICS)))
    bad = (rows[:, 0] * 40).astype(int) % 2 == 1
    found = rules.learn(rows, bad)
    inside = np.any([rules.covered(rule, rows) for rule in found], axis=0)
    assert len(found) >= 20 and (inside == bad).mean() > 0.99
    deep = (rows[:, :6] > 0.35).all(axis=1)
    assert max(map(len, rules.learn(rows, deep))) >= 6
    assert rules.learn(rows, deep, min_cover=len(rows)) == []


def test_shapes_are_whole():
    long = "A1-b2_" * 3
    assert quality.shape(long + "x") == quality.shape(long + "yz") != quality.shape(long + "?")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automata_equal_edit_distances():
    rng = np.random.default_rng(9)
    words = {"idiot": 3.0, "scum": 3.5, "worthless": 4.0, "worthy": 2.0, "disgusting": 5.0}
    matcher = toxicity.Matcher(toxicity.Lexicon(words=words, stems={"vequ": 2.5}))
    tried = set(words) | {"vequer", "vequ", "vequx", "xvequ", "aidiot", "idit", "iidiott", "wrthless", "wortless", "worthles5"}
    for _ in range(3000):
        w = list(rng.choice(list(words)))
        for _ in range(rng.integers(0, 4)):
            at, kind = rng.integers(0, len(w) + 1), rng.integers(0, 3)
            w[at:at + (kind > 0)] = [] if kind == 1 else [rng.choice(list("idotscumwrhlesg"))]
        tried.add("".join(w))
    for w in tried:
        want = [(words[t] * 0.5 ** d, t, d) for t in words if (d := edit_distance(w, t)) <= toxicity.edits_allowed(t)]
        best = max(want, default=None)
        stem = w.startswith("vequ")
        got = matcher._run(w)
        assert (got is None) == (best is None and not stem)
        if got and not stem:
            assert (got[1], got[0], got[2]) == best


def test_quotation_counts_less_than_abuse():
    matcher = toxicity.Matcher(toxicity.Lexicon(words={"idiot": 3.0}))
    weigh = lambda t: toxicity.mass(toxicity.hits(t, matcher))
    assert weigh("You idiot!") == 3.0 and weigh("you 1di0t") == 3.0 and weigh("you idiott") == 1.5 and weigh("nothing here") == 0.0
    assert weigh('the so-called "idiot" was here') == pytest.approx(0.9)
    assert weigh("the word idiot is an insult") == pytest.approx(0.9)
    known = toxicity.Matcher(toxicity.Lexicon(words={"idiot": 3.0}, clean={"idiom"}))
    assert known.find("idiom") is None and known.find("idiat") is not None
