import numpy as np
import pytest
from pyspark.sql import functions as F

from slotweave.functions import vectors as V
from slotweave.operators import encode, losses, metrics, pairs, pooling, probe, search, tiles
from slotweave.plans import evaluation


def vec_df(spark, rows, cols="idx bigint, intent string, vec array<double>"):
    return spark.createDataFrame(rows, cols)


def random_rows(n, d=8, seed=0, dup=True):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).round(1)
    if dup:
        m[n // 2:] = m[rng.integers(0, n // 2, n - n // 2)]
        m[n // 3] = m[0] * 4
    m[np.abs(m).sum(axis=1) == 0] = 1.0
    return m


def as_rows(m, labels=5):
    return [(i, f"c{i % labels}", [float(x) for x in v]) for i, v in enumerate(m)]


def exact_top(q, r, k):
    out = []
    ru = r / np.sqrt((r * r).sum(1, keepdims=True))
    for v in q:
        u = v / np.sqrt((v * v).sum())
        s = (ru * u).sum(1)
        order = sorted(range(len(r)), key=lambda i: (-s[i], i))[:k]
        out.append([(i, s[i]) for i in order])
    return out


def test_earliest_reference_wins(spark):
    refs = vec_df(spark, [(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (2, "c", [20.0, 0.0])])
    q = spark.createDataFrame([(0, "a", [1.0, 0.0])], "qid bigint, intent string, vec array<double>")
    assert search.nearest(q, refs).first()["ref_idx"] == 0


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("parts", [1, 5])
def test_top_matches_equal_brute_force_over_tiles(spark, monkeypatch, k, parts):
    monkeypatch.setattr(tiles, "LEFT_BLOCK", 13)
    monkeypatch.setattr(tiles, "RIGHT_BLOCK", 17)
    monkeypatch.setattr(tiles, "SLICE", 5)
    r, q = random_rows(90), random_rows(40, seed=1)
    q[:10] = r[:10]
    refs = vec_df(spark, as_rows(r)).repartition(parts)
    qs = vec_df(spark, as_rows(q), "qid bigint, intent string, vec array<double>").repartition(parts)
    got = {}
    for row in search.top_matches(qs, refs, k=k).collect():
        got.setdefault(row["qid"], []).append((row["rank"], row["ref_idx"], row["score"]))
    for i, want in enumerate(exact_top(q, r, k)):
        have = sorted(got[i])
        assert [h[1] for h in have] == [w[0] for w in want]
        assert np.allclose([h[2] for h in have], [w[1] for w in want], atol=1e-12)


def test_threshold_within_and_errors(spark):
    refs = vec_df(spark, [(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])])
    q = spark.createDataFrame([(0, [1.0, 0.2])], "qid bigint, vec array<double>")
    assert [r["ref_idx"] for r in search.top_matches(q, refs, k=5, threshold=0.6).collect()] == [0]
    g = refs.withColumn("g", F.col("intent"))
    qg = q.withColumn("g", F.lit("b"))
    assert search.nearest(qg, g, within=["g"]).first()["ref_idx"] == 1
    bad = spark.createDataFrame([(0, [1.0, float("nan")])], "qid bigint, vec array<double>")
    with pytest.raises(Exception, match="non-finite"):
        search.nearest(bad, refs).collect()
    with pytest.raises(ValueError):
        search.nearest(q.limit(0), refs)


def test_vote_prototypes_mix(spark):
    refs = vec_df(spark, [(0, "a", [1.0, 0.0]), (1, "b", [0.9, 0.1]), (2, "b", [0.8, 0.2]), (3, "c", [0.0, 1.0])])
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid bigint, vec array<double>")
    m = search.top_matches(q, refs, k=3)
    v = search.intent_vote(m, ["qid"]).first()
    assert (v["predicted"], v["votes"], v["ref_idx"]) == ("b", 2, 1)
    p = {r["intent"]: (r["idx"], r["vec"]) for r in search.prototypes(refs).collect()}
    assert p["b"][0] == 1 and np.allclose(p["b"][1], [0.85, 0.15])
    mean = search.mean_of_matches(m, refs, ["qid"]).first()["vec"]
    assert np.allclose(mean, [0.9, 0.1])
    mixed = spark.createDataFrame([([2.0, 0.0], [0.0, 4.0])], "a array<double>, b array<double>")
    r = mixed.select(V.mix(F.col("a"), F.col("b"), 0.25).alias("x"), V.mix(F.col("a"), F.col("b"), 0.5, 2).alias("y")).first()
    assert r["x"] == [1.5, 1.0] and r["y"] == [0.5, 0.5]


def test_cell_search_recall(spark):
    r = random_rows(300, dup=False)
    refs, qs = vec_df(spark, as_rows(r)), vec_df(spark, as_rows(r[:50] + 0.01), "qid bigint, intent string, vec array<double>")
    exact = search.top_matches(qs, refs, k=3)
    some = search.cell_matches(qs, refs, k=3, cells=10, probes=4)
    every = search.cell_matches(qs, refs, k=3, cells=10, probes=10)
    assert search.recall(some, exact).first()["recall"] > 0.7
    assert search.recall(every, exact).first()["recall"] == 1.0


def test_truncate_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0, 100.0],)], "v array<double>")
    assert np.allclose(df.select(V.truncate_normalise(F.col("v"), 2).alias("x")).first()["x"], [0.6, 0.8])
    for bad, d in (([0.0, 0.0, 1.0], 2), ([1.0, float("inf"), 1.0], 2), ([1.0], 2)):
        b = spark.createDataFrame([(bad,)], "v array<double>")
        with pytest.raises(Exception):
            b.select(V.truncate_normalise(F.col("v"), d)).collect()
    r = df.select(V.normalise(F.col("v"), 1).alias("a"), V.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert np.isclose(sum(r["a"]), 1.0) and np.isclose(r["c"], 1.0)


def test_metrics(spark):
    p = spark.createDataFrame([("q0", "a", "a"), ("q1", "b", "a"), ("q2", "a", "a")], "id string, intent string, ref_intent string")
    m = {r["intent"]: r for r in metrics.intent_metrics(p).collect()}
    assert np.isclose(m[None]["accuracy"], 200 / 3) and m["b"]["correct"] == 0
    assert [r["id"] for r in metrics.wrong_predictions(p).collect()] == ["q1"]
    s = spark.createDataFrame([("t", 0.0, 0.6), ("t", 0.1, 0.8), ("t", 0.2, 0.8), ("t", 0.5, 0.2)], "t string, ratio double, accuracy double")
    assert metrics.select_coefficient(s, ["t"]).first()["ratio"] == 0.1


def brute_pairs(m, sets):
    same, dist, pot, n = 0, 0.0, 0.0, 0
    for i in range(len(m)):
        for j in range(i + 1, len(m)):
            d = float(((m[i] - m[j]) ** 2).sum())
            n += 1
            pot += np.exp(-2 * d)
            if set(sets[i]) & set(sets[j]):
                same += 1
                dist += d
    return same, dist / same, np.log(pot / n), n


def test_alignment_and_uniformity_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 11)
    monkeypatch.setattr(tiles, "SLICE", 4)
    m = random_rows(60) / 4
    rng = np.random.default_rng(2)
    sets = [[f"i{x}" for x in rng.choice(5, rng.integers(0, 4), replace=False)] for _ in range(60)]
    df = spark.createDataFrame([(i, sets[i], [float(x) for x in m[i]]) for i in range(60)],
                               "vec_id bigint, intents array<string>, vec array<double>")
    same, align, unif, n = brute_pairs(m, sets)
    a = pairs.alignment(df).first()
    assert a["same_intent_pairs"] == same and np.isclose(a["alignment"], align)
    u = pairs.uniformity(df).first()
    assert u["pairs"] == n and np.isclose(u["uniformity"], unif)
    lp = pairs.mean_log_potential(df).first()
    d2 = [((m[i] - m[j]) ** 2).sum() for i in range(60) for j in range(i)]
    assert np.isclose(lp["mean_log_potential"], -2 * np.mean(d2))


def test_contrastive_losses_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(losses, "BLOCK", 3)
    rng = np.random.default_rng(4)
    rows, mats = [], {}
    for b, n in ((0, 8), (1, 3)):
        mats[b] = {c: rng.normal(size=(n, 4)) for c in ("u1", "u2", "t1", "t2")}
        rows += [(b, i, *[mats[b][c][i].tolist() for c in ("u1", "u2", "t1", "t2")]) for i in range(n)]
    df = spark.createDataFrame(rows, "batch bigint, pos bigint, u1 array<double>, u2 array<double>, t1 array<double>, t2 array<double>")
    got = {(r["batch"], r["loss"]): r["value"] for r in losses.contrastive_losses(df).collect()}
    for b in mats:
        for name, a, c in losses.LOSSES:
            s = tiles.unit(mats[b][a]) @ tiles.unit(mats[b][c]).T / 0.05
            want = np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - np.diag(s))
            assert np.isclose(got[b, name], want)
    t = losses.total_loss(losses.contrastive_losses(df), 1, 2, 3, "balanced").filter("batch = 0").first()
    pair = (got[0, "pair_pattern"] + got[0, "pair_utterance"]) / 2
    assert np.isclose(t["loss"], got[0, "utterance"] + 2 * got[0, "template"] + 3 * pair)


def test_pooling(spark):
    rows = [(0, l, p, int(p >= 1), [float(l + p), float(l * p)]) for l in range(3) for p in range(4)]
    df = spark.createDataFrame(rows, "utt_id bigint, layer int, pos int, mask int, vec array<double>")
    get = lambda how: pooling.pool(df, how).first()["vec"]
    assert get("last_real") == [5.0, 6.0]
    assert get("first") == [3.0, 2.0]
    assert np.allclose(get("mean"), [4.0, 4.0])
    assert np.allclose(get("mean_first_last"), [3.0, 2.0])
    assert np.allclose(get("mean_last_two"), [3.5, 3.0])
    padded = df.withColumn("mask", F.lit(0))
    with pytest.raises(Exception, match="Nothing has been added"):
        pooling.pool(padded, "mean").collect()


def test_encode_and_tokens(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, "c"), (2, " ")], "id bigint, text string")
    vo = encode.token_vocabulary(df, 2)
    out = {r["id"]: r for r in encode.pad_truncate(df, vo, 6, "id").collect()}
    assert out[0]["input_ids"] == [2, 4, 5, 4, 3, 0] and out[0]["attention_mask"] == [1, 1, 1, 1, 1, 0]
    assert out[1]["input_ids"] == [2, 1, 3, 0, 0, 0] and out[2]["input_ids"] == [2, 3, 0, 0, 0, 0]
    cut = {r["id"]: r["input_ids"] for r in encode.pad_truncate(df, vo, 4, "id").collect()}
    assert cut[0] == [2, 4, 5, 3]
    b = spark.createDataFrame([(0, [1, 2, 3]), (0, [4])], "batch bigint, input_ids array<int>")
    assert sorted(r["input_ids"] for r in encode.pad_to_batch(b).collect()) == [[1, 2, 3], [4, 0, 0]]
    h = encode.encode_hashed(df, dims=16).filter("id = 0").first()["vec"]
    assert np.isclose(sum(x * x for x in h), 1.0)

    def build():
        return lambda texts: [[float(len(t))] for t in texts]

    assert [r["vec"] for r in encode.encode(df, build).orderBy("id").collect()] == [[5.0], [1.0], [1.0]]


def test_probe_and_plot(spark):
    rows = [(i, f"c{i % 2}", [float(i % 2) * 4 + (i % 7) * 0.1, 1.0]) for i in range(40)]
    df = vec_df(spark, rows)
    assert probe.probe_accuracy(probe.linear_probe(df, df)) == 1.0
    emb = spark.createDataFrame([("u1", [3.0, 4.0], [1.0, 0.0], [0.0, 1.0]), ("u2", [1.0, 0.0], [1.0, 0.0], [0.0, 1.0])],
                                "utterance string, embedding_vector array<double>, ptn_vector array<double>, utt_vector array<double>")
    meta = spark.createDataFrame([("u1", "p {SLOT}", "d", "a"), ("u2", "plain", "d", "a")],
                                 "utterance string, pattern string, domain string, intent string")
    rows = probe.plot_rows(emb, meta, 1)
    assert [(r["utterance"], r["embedding_vector"]) for r in rows.collect()] == [("u1", [0.6, 0.8])]
    assert {r["label"] for r in probe.stacked_view(rows).collect()} == {"0:Pattern", "1:Utterance"}
    assert probe.plot_points(probe.stacked_view(rows)).count() == 2


def test_search_beside_queries_moves_no_query_vectors(spark):
    r, q = random_rows(300), random_rows(60, seed=1)
    refs = vec_df(spark, as_rows(r)).repartition(3)
    qs = vec_df(spark, as_rows(q), "qid bigint, intent string, vec array<double>")
    one = search.top_matches(qs, refs, k=3)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    many = search.top_matches(qs, refs, k=3, round_bytes=8_000)
    columns = ["qid", "rank", "ref_idx"]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    want = sorted((i, n + 1, j) for i, found in enumerate(exact_top(q, r, 3)) for n, (j, _) in enumerate(found))
    assert key(one) == key(many) == want


@pytest.mark.parametrize("k, threshold", [(1, None), (3, None), (3, 0.5)])
def test_few_queries_go_to_the_references(spark, monkeypatch, k, threshold):
    """The driver gets the side that takes fewer rounds: never more rows than there are queries, none of the references."""
    monkeypatch.setattr(tiles, "LEFT_BLOCK", 7)
    monkeypatch.setattr(tiles, "RIGHT_BLOCK", 50)
    r, q = random_rows(600), random_rows(20, seed=1)
    q[:5] = r[:5]
    q[6] = 0.0  # ties with all references
    refs = vec_df(spark, as_rows(r)).repartition(3)
    qs = vec_df(spark, as_rows(q), "qid bigint, intent string, vec array<double>").repartition(2)
    sent, plain = [], type(refs).toArrow

    def counted(df):
        table = plain(df)
        sent.append(table.num_rows)
        return table

    monkeypatch.setattr(type(refs), "toArrow", counted)
    ru, qu = tiles.unit(r), tiles.unit(q)
    want = []
    for i, u in enumerate(qu):
        s = (ru * u).sum(axis=1)
        best = [j for j in np.lexsort((np.arange(len(r)), -s))[:k].tolist() if threshold is None or s[j] >= threshold]
        want += [(i, n + 1, j, f"c{i % 5}", f"c{j % 5}") for n, j in enumerate(best)]
    one = search.top_matches(qs, refs, k=k, threshold=threshold)
    for size, rounds in ((20_000, 1), (10_000, 2)):
        sent.clear()
        found = search.top_matches(qs, refs, k=k, threshold=threshold, round_bytes=size)
        assert found.columns == one.columns
        for df in (found, one):
            assert sorted(map(tuple, df.select("qid", "rank", "ref_idx", "intent", "ref_intent").collect())) == sorted(want)
        assert sorted(map(tuple, found.select("qid", "ref_idx", "score").collect())) == sorted(map(tuple, one.select("qid", "ref_idx", "score").collect()))
        assert sum(sent) == len(q) and len(sent) == rounds


def test_repeated_queries_keep_their_matches(spark):
    """A query that stands twice is asked twice, whichever side is sent."""
    refs = vec_df(spark, as_rows(random_rows(200)) * 2)
    qs = vec_df(spark, as_rows(random_rows(6, seed=1)) * 2, "qid bigint, intent string, vec array<double>")
    key = lambda df: sorted(map(tuple, df.select("qid", "rank", "ref_idx", "score").collect()))
    assert key(search.top_matches(qs, refs, k=3)) == key(search.top_matches(qs, refs, k=3, round_bytes=16_000))


def test_many_queries_stay_where_they_are(spark):
    """With as many queries as references the references go round by round."""
    r, q = random_rows(150), random_rows(150, seed=1)
    refs = vec_df(spark, as_rows(r)).repartition(3)
    qs = vec_df(spark, as_rows(q), "qid bigint, intent string, vec array<double>")
    many = search.top_matches(qs, refs, k=3, round_bytes=8_000)
    want = sorted((i, n + 1, j) for i, found in enumerate(exact_top(q, r, 3)) for n, (j, _) in enumerate(found))
    assert sorted(map(tuple, many.select("qid", "rank", "ref_idx").collect())) == want


@pytest.mark.parametrize("d, spread", [(3, 0.05), (16, 0.02), (16, 3.0)])
def test_blocks_are_skipped_without_losing_a_match(d, spread):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(30, d))
    r = np.repeat(centres, 50, axis=0) + spread * rng.normal(size=(1500, d))
    r[7] = 0.0
    r[100:120] = r[50]  # ties
    q = np.concatenate([centres + spread * rng.normal(size=(30, d)), r[50:51], np.zeros((1, d)), -r[3:4]])
    for threshold in (None, 0.7):
        blocks = search.Blocks(r, np.arange(1500), block=25)
        rows, score, compared = blocks.search(q, 4, threshold)
        scores = [(tiles.unit(r) * u).sum(axis=1) for u in tiles.unit(q)]  # zero vectors score zero
        for i, s in enumerate(scores):
            want = [(j, s[j]) for j in np.lexsort((np.arange(1500), -s))[:4].tolist() if threshold is None or s[j] >= threshold]
            assert [j for j in rows[i].tolist() if j >= 0] == [j for j, _ in want]
            assert np.allclose([s for s in score[i] if np.isfinite(s)], [s for _, s in want], atol=1e-12)
        if spread < 1:
            assert compared < 0.5 * len(q) * len(blocks.rows)


def test_codes_find_neighbours_in_few_cells(spark):
    """Clustered vectors, a third of them in one hot cluster: recall from few cells, every row indexed."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    r = np.concatenate([centres[rng.integers(0, 40, 800)], np.repeat(centres[:1], 400, axis=0)]) + 0.15 * rng.normal(size=(1200, 24))
    refs = vec_df(spark, as_rows(r)).repartition(3)
    q = vec_df(spark, as_rows(centres[rng.integers(0, 40, 60)] + 0.15 * rng.normal(size=(60, 24))), "qid bigint, intent string, vec array<double>")
    known = search.fit_quantiser(refs, sample_rows=900)
    assert 20 <= len(known.centres) <= 900 // search.CELL_ROWS and len(known.tops) < len(known.centres)
    placed = search.indexed(refs, known)
    assert placed.count() == 1200 and placed.select("idx").distinct().count() == 1200
    probes = search.calibrated_probes(q, refs, known, placed, 5)
    assert probes <= len(known.centres) // 2
    found = search.code_matches(q, refs, k=5, known=known, placed=placed, probes=probes)
    assert search.recall(found, search.top_matches(q, refs, k=5)).first()["recall"] >= 0.9
    assert {r["rank"] for r in found.collect()} == {1, 2, 3, 4, 5} and set(found.columns) == {"qid", "intent", "ref_idx", "ref_intent", "score", "rank"}
    every = search.code_matches(q, refs, k=5, known=known, placed=placed, probes=len(known.centres), shortlist=1200)
    key = lambda df: sorted(map(tuple, df.select("qid", "rank", "ref_idx").collect()))
    assert key(every) == key(search.top_matches(q, refs, k=5))


def test_codes_tell_dense_neighbours_apart(spark):
    """Beside wide clusters a very dense one, in which far more than a least shortlist are nearly as close as the nearest."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 32))
    wide = centres[rng.integers(1, 20, 600)] + 0.6 * rng.normal(size=(600, 32))
    refs = vec_df(spark, as_rows(np.concatenate([wide, centres[0] + 0.01 * rng.normal(size=(1800, 32))]))).repartition(3)
    q = vec_df(spark, as_rows(centres[0] + 0.01 * rng.normal(size=(50, 32))), "qid bigint, intent string, vec array<double>")
    known = search.fit_quantiser(refs)
    found = search.code_matches(q, refs, k=5, known=known, placed=search.indexed(refs, known))
    assert search.recall(found, search.top_matches(q, refs, k=5)).first()["recall"] >= 0.9


@pytest.mark.parametrize("round_bytes", [1 << 20, 4_000])
def test_listed_pairs_are_scored_without_exchanging_query_vectors(spark, monkeypatch, round_bytes):
    monkeypatch.setattr(tiles, "RIGHT_BLOCK", 20)
    r, q = random_rows(80), random_rows(12, seed=1)
    refs = vec_df(spark, as_rows(r)).repartition(3)
    qs = vec_df(spark, as_rows(q), "qid bigint, intent string, vec array<double>")
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, (12, 80), (300, 2))}) + [(99, 3), (2, 999), (None, 4), (5, None)]
    short = spark.createDataFrame(pairs, "qid bigint, ref_idx bigint")
    scores = tiles.unit(q) @ tiles.unit(r).T
    for threshold in (None, 0.3):
        found = search._scored(short, qs, refs, 3, threshold, "qid", "idx", "vec", round_bytes)
        assert found.columns == search.top_matches(qs, refs, k=3).columns
        want = []
        for i in range(12):
            mine = [j for a, j in pairs if a == i and j is not None and j < 80 and (threshold is None or scores[i, j] >= threshold)]
            want += [(i, f"c{i % 5}", j, f"c{j % 5}", n + 1) for n, j in enumerate(sorted(mine, key=lambda j: (-scores[i, j].round(9), j))[:3])]
        assert sorted(map(tuple, found.select("qid", "intent", "ref_idx", "ref_intent", "rank").collect())) == sorted(want)
    plan = search._scored(short, qs, refs, 3, None, "qid", "idx", "vec")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
    twice = search._scored(short, qs.unionByName(qs.where("qid = 2")), refs.unionByName(refs), 100, None, "qid", "idx", "vec", round_bytes)
    counts = {row["qid"]: row["count"] for row in twice.groupBy("qid").count().collect()}
    each = {i: sum(a == i and j is not None and j < 80 for a, j in pairs) for i in range(12)}
    assert counts == {i: min(100, n * (4 if i == 2 else 2)) for i, n in each.items() if n}


@pytest.mark.parametrize("block", [3, 2048])
def test_overlap_sums_equal_all_pairs(spark, block):
    """Sets of several intents, one of them in most sets; empty and null sets pair with none."""
    rng = np.random.default_rng(7)
    names = ["hot", "b", "a10", "a9", "Z", "é"]
    sets = [sorted({"hot"} if rng.random() < 0.6 else set(), key=str) + [names[i] for i in rng.integers(1, 6, rng.integers(0, 4))] for _ in range(70)]
    sets[3], sets[4] = [], None
    m = rng.normal(size=(70, 4))
    df = spark.createDataFrame([(i, s, [float(x) for x in v]) for i, (s, v) in enumerate(zip(sets, m))], "id long, intents array<string>, vec array<double>")
    want = [((m[i] - m[j]) ** 2).sum() for i in range(70) for j in range(i) if set(sets[i] or []) & set(sets[j] or [])]
    got = pairs.alignment(df.withColumn("vec", F.col("vec")), block=block).first()
    assert got["same_intent_pairs"] == len(want) and np.isclose(got["alignment"], np.mean(want))


def test_many_sets_under_one_intent_give_a_row_a_tile(spark):
    n = 6000
    rows = spark.range(n).select(F.array(F.lit(0).cast("long"), F.col("id") + 1).alias("set"), F.lit(1).cast("long").alias("n"),
                                 F.array(F.col("id").cast("double"), F.lit(1.0)).alias("s"), (F.col("id") * F.col("id") + 1.0).alias("q"))
    sums = pairs.overlap_sums(rows, block=1000)
    out = sums.agg(F.count("*").alias("tiles"), F.sum("pairs").alias("pairs"), F.sum("distance_sum").alias("d")).first()
    ids = np.arange(n, dtype=float)
    assert out["pairs"] == n * (n - 1) // 2 and out["d"] == n * (ids ** 2).sum() - ids.sum() ** 2
    assert out["tiles"] <= 6 * 7 // 2 + 6 + n  # the sets' own intents are tiles of one


def test_sweep_exchanges_no_vectors(spark):
    """Each ratio searches beside its queries: behind the written rows nothing is grouped but the counts."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(
        [(i, i - i % 7, ("test", "valid", "train", "train")[i % 4], str(i % 3), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(80, 6)))],
        "vec_id long, tpl_id long, split string, intent string, vec array<double>")
    out = evaluation.compression_sweep(rows)
    assert "CoGroup" not in out._jdf.queryExecution().toString()
    assert sorted((r["ratio"], r["split"], r["total"]) for r in out.collect()) == [(x, s, 20) for x in evaluation.RATIOS for s in ("test", "valid")]


@pytest.mark.parametrize("k, threshold", [(1, None), (3, None), (2, 0.9)])
def test_search_beside_queries_scores_few_pairs_exactly(monkeypatch, k, threshold):
    """Ties and differences below single precision are settled exactly; vectors are not made unit again for every block."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 4, (700, 32)).astype(float)
    base[:8] = 0
    close = base[40:140] + rng.normal(0, 1e-9, (100, 32))
    refs = np.concatenate([base, base[100:300] * 3, close])
    order = rng.permutation(len(refs)).astype(np.int64) - 50
    queries = np.concatenate([base[::4], rng.normal(0, 1, (60, 32)), np.zeros((2, 32))])
    blocks = search.Blocks(refs, order, block=16)
    made, plain = [], tiles.unit
    monkeypatch.setattr(tiles, "unit", lambda m: made.append(len(m)) or plain(m))
    rows, best, compared = blocks.search(queries, k, threshold)
    monkeypatch.undo()
    zeros = int((np.abs(queries).sum(axis=1) == 0).sum())  # tie with all references
    assert sum(made) < compared / 3 + zeros * len(refs)
    q, r = plain(queries), plain(plain(refs))
    for i in range(len(queries)):
        exact = (q[i] * r).sum(axis=1)
        want = [j for j in np.lexsort((order, -exact)) if threshold is None or exact[j] >= threshold][:k]
        assert [j for j in rows[i] if j >= 0] == want
        assert best[i][:len(want)].tolist() == exact[want].tolist()
