"""Toxicity: the query against a plain learner and scorer, and what may not keep a term from being learned."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from slotweave.llm import common, toxicity as X

from .test_learned import edit_distance

TOKEN = re.compile(r"[^\W_](?:\S*[^\W_])?")


def tokens(text):
    return TOKEN.findall((text or "").lower())


def spelled(words):
    """Terms a list of words holds, with the places of each."""
    out = defaultdict(list)
    for i, w in enumerate(words):
        for t in [w] * (len(w) > 2) + [w[:n] + "*" for n in range(4, 9) if len(w) > n]:
            out[t].append(i)
    return out


def plain_learner(sample):
    """(words, stems) from [(text, y)], everything counted in sets."""
    toxic, clean = sum(y for _, y in sample), sum(not y for _, y in sample)
    docs, contexts, words, often = defaultdict(set), defaultdict(set), defaultdict(set), Counter()
    for text, y in sample:
        found = tokens(text)
        if not y:
            often.update(spelled(found).keys())
        elif found:
            known_by = min(zlib.crc32(" ".join(found[i:i + 3]).encode()) for i in range(max(1, len(found) - 2)))
            for t, places in spelled(found).items():
                docs[t].add(known_by)
                contexts[t] |= {(" ".join(found[max(0, i - 1):i]), " ".join(found[i + 1:i + 2])) for i in places}
                words[t] |= {found[i] for i in places}
    bound = math.log(sum(len(docs[t]) + often[t] >= 4 for t in docs))
    base, weight = toxic / (toxic + clean), {}
    for t in docs:
        n, m, stem = min(len(docs[t]), len(contexts[t])), often[t], t.endswith("*")
        if n < 4 or stem and len(words[t]) < 8 or n / (n + m) <= base:
            continue
        g = n * math.log(n / (n + m) / base) + (m * math.log(m / (n + m) / (1 - base)) if m else 0)
        w = math.log((len(docs[t]) + 0.5) / (toxic + 1) * (clean + 1) / (m + 0.5))
        if g >= bound * (1 + stem) and w >= math.log(8 if stem else 20):
            weight[t] = w
    stems = {}
    for t in sorted((t for t in weight if t.endswith("*")), key=lambda t: (-len(docs[t]) * min(3.0, weight[t]), len(t), t)):
        if not any(t[:-1].startswith(s) or s.startswith(t[:-1]) for s in stems):
            stems[t[:-1]] = weight[t]
    return {t: w for t, w in weight.items() if not t.endswith("*") and not any(t.startswith(s) for s in stems)}, stems


def plain_hit(word, words, stems):
    """(weight, edits), by edit distance to every term."""
    for form in (word, word.translate(str.maketrans("013457@$!", "oieastasi"))):
        held = [(w, 0) for s, w in stems.items() if form.startswith(s)]
        near = [(w * 0.5 ** d, d) for t, w in words.items() if abs(len(t) - len(form)) < 3
                and (d := edit_distance(form, t)) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
        if held or near:
            return max(held or near)
        if word.isalpha():
            return None
    return None


def test_query_equals_a_plain_learner_and_scorer(tables):
    known = {r["doc_id"]: r["toxic"] for r in tables("labels").collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in tables("documents").collect()]
    sample = [(t, known[i]) for i, t in rows if known.get(i) is not None and not common.held_out_py(i)]
    words, stems = plain_learner(sample)
    learned = X.learn(tables("documents"), tables("labels"))
    assert learned.words == pytest.approx(words) and learned.stems == pytest.approx(stems) and words
    hit = {w: plain_hit(w, words, stems) for w in {w for _, t in rows for w in tokens(t)}}
    count = {y: Counter(w for t, z in sample if z == y for w in set(tokens(t)) if hit[w] and hit[w][1]) for y in (0, 1)}
    miss = {w for w, n in count[0].items() if count[1][w] <= 2 * n}
    assert learned.clean == miss

    def total(text):
        low, out = text.lower(), 0.0
        for m in TOKEN.finditer(low):
            if hit[m[0]] and m[0] not in miss:
                before, after = low[:m.start()].split(), low[m.end():].split()
                glued = low[m.start() - 1] if m.start() and low[m.start() - 1] in X._OPEN else ""
                opens = glued or any(w[0] in X._OPEN for w in before[-3:])
                closes = any(w[0] in X._CLOSE or w[-1] in X._CLOSE or w.rstrip(".,;:!?")[-1:] in tuple(X._CLOSE) for w in after[:3])
                told = any(w.strip("\"'.,:;“”«»") in X._REPORT for w in before[-3:])
                out += hit[m[0]][0] * (0.3 if opens and closes or told else 1.0)
        return out

    a, b, c = X.calibrate(*(np.array(v, dtype=float) for v in zip(*[(total(t), len(t.split()), y) for t, y in sample])))
    got = {r["doc_id"]: r["score"] for r in X.classify(tables("documents"), tables("labels")).collect()}
    for i, t in rows:
        x = a * math.log1p(total(t)) + b * math.log1p(100 * total(t) / max(1, len(t.split()))) + c
        assert got[i] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-6)


def invented(seed, terms):
    """(doc_id, text, toxic): every fourth document holds a term; all start and end alike."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("bdfgklmnprstvaeiou") for _ in range(rng.randint(4, 8)))
    common_words = [word() for _ in range(300)]
    for k in range(24 * len(terms)):
        some = [rng.choice(common_words) for _ in range(30)]
        if k % 4 == 0:
            some[rng.randrange(30)] = terms[k // 4 % len(terms)]
        out.append((k, " ".join(["from the archive:", *some, "end of message"]), int(k % 4 == 0)))
    return out


def test_rare_and_long_terms_behind_a_common_header_are_learned(documents, labels):
    """Each of 70 terms is in 1.4 % of the toxic documents, some are long, all texts share their first and last words."""
    rng = random.Random(8)
    terms = ["".join(rng.choice("hjqwxyz") for _ in range(30 if k % 10 == 0 else 9)) for k in range(70)]
    rows = invented(5, terms * 3)
    docs, known = documents([(i, t) for i, t, _ in rows]), labels([(i, 1, y) for i, _, y in rows])
    lexicon = X.learn(docs, known)
    assert set(terms) == set(lexicon.words)


def test_copies_of_one_text_teach_nothing(documents, labels):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    text = prose(60).split()
    rows = [(k, " ".join(text), 1) for k in range(300)] + [(300 + k, prose(60), 0) for k in range(300)]
    for k in range(0, 300, 3):  # near copies: a word changed
        rows[k] = (k, " ".join(text[:k % 60] + ["changed" + "abcdefghij"[k % 10]] + text[k % 60 + 1:]), 1)
    lexicon = X.learn(documents([r[:2] for r in rows]), labels([(i, 1, y) for i, _, y in rows]))
    assert not set(lexicon.words) & set(text) and not lexicon.stems


def test_quotation_is_seen_behind_words_of_any_length():
    matcher = X.Matcher(X.Lexicon(words={"idiot": 3.0}))
    weigh = lambda t: X.mass(X.hits(t, matcher))
    long = "x" * 500
    assert weigh(f'"{long} idiot {long}" he') == pytest.approx(0.9)
    assert weigh(f"quoted {long} idiot") == pytest.approx(0.9) and weigh(f"quoted a b c idiot {long}") == 3.0
    assert weigh("idiot") == 3.0 and weigh('idiot" "idiot') == 6.0 and weigh('x "idiot" y') == pytest.approx(0.9)
