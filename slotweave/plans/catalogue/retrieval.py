"""Vector, retrieval and representation queries. All stored vectors take part: training rows are the
references, validation and test rows the queries."""

from pyspark.sql import functions as F

from slotweave.functions import vectors as V
from slotweave.operators import encode as E
from slotweave.operators import losses as L
from slotweave.operators import metrics as M
from slotweave.operators import pairs as P
from slotweave.operators import pooling as O
from slotweave.operators import probe as B
from slotweave.operators import search as R
from slotweave.plans import evaluation as ev
from slotweave.plans.catalogue.texts import MASKED
from slotweave.plans.registry import query
from slotweave.plans.views import key_sql, oracle
from slotweave.session import stage


def r6(column):
    return F.round(column, 6)


def dbl(column):
    return f"CAST({column} AS DOUBLE[])"


def cosine_sql(a, b):
    return f"list_cosine_similarity({dbl(a)}, {dbl(b)})"


RANKED = f"""
ranked AS (SELECT q.vec_id AS qid, q.split, q.intent, r.vec_id AS ref_idx, r.intent AS ref_intent, r.vec AS ref_vec, s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, r.vec_id) AS rank
  FROM (SELECT q.*, r.vec_id AS rid, {cosine_sql('q.vec', 'r.vec')} AS s FROM emb_rows q, emb_rows r
    WHERE q.split <> 'train' AND r.split = 'train') q JOIN emb_rows r ON r.vec_id = q.rid)"""


@query("""SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1,
  round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l2,
  round(list_max(list_transform(v, lambda x: abs(x))) / list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1_peak, TRUE AS usable
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def vector_norms(t):
    v = F.col("embedding")
    peak = F.array_max(F.transform(V.normalise(v, 1), lambda x: F.abs(x)))
    return t.table("embeddings").select(
        "vec_id", r6(V.norm(v, 1)).alias("l1"), r6(V.norm(v, 2)).alias("l2"), r6(peak).alias("l1_peak"),
        V.vector_problem(v, 64).isNull().alias("usable"),
    )


@query(oracle(["emb_rows"], f"""
SELECT a.vec_id, round({cosine_sql('a.vec', 'b.vec')}, 6) AS cosine, round(list_sum(list_transform(list_zip({dbl('a.vec')}, {dbl('b.vec')}),
  lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance2
FROM emb_rows a JOIN emb_rows b ON a.tpl_id = b.vec_id"""))
def template_cosines(t):
    rows = ev.with_templates(t.view("emb_rows"))
    a, b = F.col("vec"), F.col("tpl_vec")
    return rows.select("vec_id", r6(V.cosine(a, b)).alias("cosine"), r6(V.squared_distance(a, b)).alias("distance2"))


@query("""SELECT vec_id, pos, round(v[pos + 1] / sqrt(list_sum(list_transform(v[1:16], lambda x: x * x))), 6) AS x
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(unnest(range(16)) AS INTEGER) AS pos FROM embeddings)""")
def matryoshka_vectors(t):
    head = V.truncate_normalise(F.col("embedding"), 16)
    return t.table("embeddings").select("vec_id", F.posexplode(head).alias("pos", "x")).select("vec_id", "pos", r6(F.col("x")).alias("x"))


@query(oracle(["emb_rows"], "SELECT qid, split, intent, ref_idx, ref_intent, round(s, 6) AS score FROM ranked WHERE rank = 1", RANKED))
def nn1_cosine(t):
    return ev.nearest_predictions(t.view("emb_rows")).select(
        "qid", "split", "intent", "ref_idx", "ref_intent", r6(F.col("score")).alias("score")
    )


@query(oracle(["emb_rows"], """
SELECT split, intent, count(*) FILTER (intent = ref_intent) AS correct, count(*) AS total,
  round(100.0 * count(*) FILTER (intent = ref_intent) / count(*), 6) AS accuracy
FROM ranked WHERE rank = 1 GROUP BY GROUPING SETS ((split, intent), (split))""", RANKED))
def nn1_metrics(t):
    out = M.intent_metrics(ev.nearest_predictions(t.view("emb_rows")), ["split"])
    return out.select("split", "intent", "correct", "total", r6(F.col("accuracy")).alias("accuracy"))


@query(oracle(["emb_rows"], """
SELECT qid AS id, intent AS expected, ref_intent AS predicted, ref_idx AS reference_id, round(s, 6) AS cosine
FROM ranked WHERE rank = 1 AND intent <> ref_intent""", RANKED))
def nn1_wrong(t):
    wrong = M.wrong_predictions(ev.nearest_predictions(t.view("emb_rows")))
    return wrong.select(
        F.col("qid").alias("id"), F.col("intent").alias("expected"), F.col("ref_intent").alias("predicted"),
        F.col("ref_idx").alias("reference_id"), r6(F.col("score")).alias("cosine"),
    )


TARGETS = [("valid", 12.5), ("test", 10.0), ("other", 50.0)]


@query(oracle(["emb_rows"], """
SELECT round(avg(acc), 6) AS macro_accuracy, round(avg(CASE WHEN acc IS NOT NULL THEN target END), 6) AS macro_target,
  bool_and(acc IS NOT NULL) AS all_tasks, coalesce(bool_and(n = expected_total), FALSE) AS counts_match
FROM (VALUES ('valid', 12.5::DOUBLE, 100), ('test', 10.0, 100), ('other', 50.0, 100)) t(task, target, expected_total)
LEFT JOIN (SELECT split, 100.0 * avg(CASE WHEN intent = ref_intent THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n
  FROM ranked WHERE rank = 1 GROUP BY split) ON split = task""", RANKED))
def macro_summary(t):
    """Splits stand for tasks; one target has no result."""
    acc = M.accuracy(ev.nearest_predictions(t.view("emb_rows")), ["split"])
    tasks = acc.select(F.col("split").alias("task"), (100 * F.col("accuracy")).alias("accuracy"), "total")
    targets = t.spark.createDataFrame([(a, b, 100) for a, b in TARGETS], "task string, target double, expected_total bigint")
    out = M.task_summary(tasks, targets)
    return out.select(r6(F.col("macro_accuracy")).alias("macro_accuracy"), r6(F.col("macro_target")).alias("macro_target"), "all_tasks", "counts_match")


@query(oracle(["emb_rows"], """
SELECT split AS task, target, round(acc, 6) AS accuracy, round(acc - target, 6) AS delta FROM (VALUES ('valid', 12.5::DOUBLE), ('test', 10.0)) t(task, target)
JOIN (SELECT split, 100.0 * avg(CASE WHEN intent = ref_intent THEN 1.0 ELSE 0.0 END) AS acc FROM ranked WHERE rank = 1 GROUP BY split) ON split = task""", RANKED))
def task_deltas(t):
    """Per task, how far its accuracy is from the published one."""
    acc = M.accuracy(ev.nearest_predictions(t.view("emb_rows")), ["split"])
    tasks = acc.select(F.col("split").alias("task"), (100 * F.col("accuracy")).alias("accuracy"), "total")
    targets = t.spark.createDataFrame([(a, b, 100) for a, b in TARGETS], "task string, target double, expected_total bigint")
    out = M.task_deltas(tasks, targets)
    return out.select("task", "target", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("delta")).alias("delta"))


@query(oracle(["emb_rows"], """
SELECT qid, predicted, votes, round(best, 6) AS score, first_idx AS ref_idx FROM (
  SELECT qid, ref_intent AS predicted, count(*) AS votes, max(s) AS best, arg_min(ref_idx, rank) AS first_idx,
    row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, max(s) DESC, min(ref_idx)) AS place
  FROM ranked WHERE rank <= 5 GROUP BY 1, 2) WHERE place = 1""", RANKED))
def topk_vote(t):
    rows = t.view("emb_rows")
    matches = R.top_matches(ev.queries(rows), ev.references(rows), k=5)
    return R.intent_vote(matches, ["qid"]).select("qid", "predicted", "votes", r6(F.col("score")).alias("score"), "ref_idx")


@query(oracle(["emb_rows"], "SELECT qid, ref_idx, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM ranked WHERE rank <= 5 AND s >= 0.25", RANKED))
def topk_search_threshold(t):
    rows = t.view("emb_rows")
    found = R.top_matches(ev.queries(rows), ev.references(rows), k=5, threshold=0.25)
    return found.select("qid", "ref_idx", "rank", r6(F.col("score")).alias("score"))


POSITIONS = "CAST(unnest(range(64)) AS INTEGER) AS pos"


@query(oracle(["emb_rows"], f"""
SELECT qid, first_idx AS ref_idx, ref_intent, round(s, 6) AS score FROM (
  SELECT q.vec_id AS qid, p.first_idx, p.intent AS ref_intent, {cosine_sql('q.vec', 'p.vec')} AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {cosine_sql('q.vec', 'p.vec')} DESC, p.first_idx) AS rank
  FROM emb_rows q, protos p WHERE q.split <> 'train') WHERE rank = 1""", f"""
protos AS (SELECT intent, min(first_idx) AS first_idx, list(m ORDER BY pos) AS vec FROM (
  SELECT intent, pos, min(vec_id) AS first_idx, avg(CAST(vec[pos + 1] AS DOUBLE)) AS m
  FROM (SELECT *, {POSITIONS} FROM emb_rows WHERE split = 'train') GROUP BY 1, 2) GROUP BY intent)"""))
def prototype_nn(t):
    rows = t.view("emb_rows")
    found = R.nearest(ev.queries(rows), R.prototypes(ev.references(rows)))
    return found.select("qid", "ref_idx", "ref_intent", r6(F.col("score")).alias("score"))


@query(oracle(["emb_rows"], f"""
SELECT q.vec_id AS qid, round({cosine_sql('q.vec', 'm.vec')}, 6) AS score FROM emb_rows q JOIN (
  SELECT qid, list(m ORDER BY pos) AS vec FROM (SELECT qid, pos, avg(CAST(ref_vec[pos + 1] AS DOUBLE)) AS m
    FROM (SELECT qid, ref_vec, {POSITIONS} FROM ranked WHERE rank <= 3) GROUP BY 1, 2) GROUP BY qid) m ON m.qid = q.vec_id""", RANKED))
def tpl_topk_mean(t):
    """Mean of the three nearest template vectors of each query, compared with the query."""
    rows = t.view("emb_rows")
    q, refs = ev.queries(rows), ev.references(rows)
    means = R.mean_of_matches(R.top_matches(q, refs, k=3), refs, ["qid"])
    joined = q.select("qid", F.col("vec").alias("qvec")).join(means, "qid")
    return joined.select("qid", r6(V.cosine(F.col("qvec"), F.col("vec"))).alias("score"))


SWEEP = f"""
mixed AS (SELECT a.vec_id, a.split, a.intent, ratio,
  list_transform(list_zip({dbl('a.vec')}, {dbl('b.vec')}), lambda z: (1 - ratio) * z[1] + ratio * z[2]) AS vec
  FROM emb_rows a JOIN emb_rows b ON a.tpl_id = b.vec_id, (SELECT unnest([0.0::DOUBLE, 0.1, 0.2, 0.5]) AS ratio)),
best AS (SELECT * FROM (SELECT q.ratio, q.split, q.intent, r.intent AS ref_intent,
  row_number() OVER (PARTITION BY q.ratio, q.vec_id ORDER BY list_cosine_similarity(q.vec, r.vec) DESC, r.vec_id) AS rank
  FROM mixed q JOIN mixed r ON q.ratio = r.ratio AND q.split <> 'train' AND r.split = 'train') WHERE rank = 1),
sweep AS (SELECT ratio, split, avg(CASE WHEN intent = ref_intent THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS total FROM best GROUP BY 1, 2)"""


@query(oracle(["emb_rows"], "SELECT ratio, split, round(accuracy, 6) AS accuracy, total FROM sweep", SWEEP))
def mix_sweep(t):
    return ev.compression_sweep(t.view("emb_rows")).select("ratio", "split", r6(F.col("accuracy")).alias("accuracy"), "total")


@query(oracle(["emb_rows"], """
SELECT c.ratio AS chosen, round((SELECT accuracy FROM sweep WHERE split = 'test' AND ratio = c.ratio), 6) AS test_accuracy,
  round((SELECT accuracy FROM sweep WHERE split = 'test' AND ratio = 0), 6) AS test_accuracy_at_zero
FROM (SELECT ratio FROM sweep WHERE split = 'valid' ORDER BY accuracy DESC, ratio LIMIT 1) c""", SWEEP))
def mix_chosen(t):
    out = ev.chosen_coefficient(ev.compression_sweep(t.view("emb_rows")))
    return out.select("chosen", r6(F.col("test_accuracy")).alias("test_accuracy"), r6(F.col("test_accuracy_at_zero")).alias("test_accuracy_at_zero"))


@query(oracle(["emb_rows"], f"""
SELECT qid, ref_idx, round(s, 6) AS score FROM (
  SELECT q.vec_id AS qid, r.vec_id AS ref_idx, {cosine_sql('q.vec[1:16]', 'r.vec[1:16]')} AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {cosine_sql('q.vec[1:16]', 'r.vec[1:16]')} DESC, r.vec_id) AS rank
  FROM emb_rows q, emb_rows r WHERE q.split <> 'train' AND r.split = 'train') WHERE rank = 1"""))
def matryoshka_nn(t):
    rows = t.view("emb_rows").withColumn("vec", V.truncate_normalise(F.col("vec"), 16))
    return ev.nearest_predictions(rows).select("qid", "ref_idx", r6(F.col("score")).alias("score"))


D2 = f"list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
UNIT = """
units AS (SELECT vec_id, intent, list_transform(d, lambda x: x / n) AS v FROM (
  SELECT vec_id, intent, CAST(vec AS DOUBLE[]) AS d, sqrt(list_sum(list_transform(CAST(vec AS DOUBLE[]), lambda x: x * x))) AS n FROM emb_rows)),"""
ALL_PAIRS = UNIT + f"""
pairs AS (SELECT a.intent AS ia, b.intent AS ib, a.vec_id AS va, b.vec_id AS vb, {D2} AS d2 FROM units a JOIN units b ON a.vec_id < b.vec_id)"""


def unit_rows(t):
    return t.view("emb_rows").withColumn("vec", V.normalise(F.col("vec")))


@query(oracle(["emb_rows"], "SELECT count(*) AS pairs, round(ln(avg(exp(-2 * d2))), 6) AS uniformity FROM pairs", ALL_PAIRS))
def uniformity(t):
    return P.uniformity(unit_rows(t)).select("pairs", r6(F.col("uniformity")).alias("uniformity"))


@query(oracle(["emb_rows"], "SELECT count(*) AS pairs, round(ln(avg(exp(-2 * d2))), 6) AS exact, TRUE AS within_bound FROM pairs", ALL_PAIRS))
def uniformity_sketch(t):
    """The potential from random waves, held against the exact one."""
    rows = unit_rows(t)
    exact = P.uniformity(rows).select("pairs", F.col("uniformity").alias("exact"))
    about = P.uniformity_sketch(rows).select("pairs", "potential", "bound")
    near = F.abs(F.col("potential") - F.exp("exact")) <= F.col("bound")
    return exact.join(about, "pairs").select("pairs", r6(F.col("exact")).alias("exact"), near.alias("within_bound"))


@query(oracle(["emb_rows"], """
SELECT count(*) FILTER (same) AS same_intent_pairs, round(avg(d2) FILTER (same), 6) AS alignment
FROM (SELECT d2, ia = ib OR va % 3 = vb % 3 AS same FROM pairs)""", ALL_PAIRS))
def align_intent_sets(t):
    """Every utterance has two intents; a pair is aligned when the sets overlap."""
    rows = unit_rows(t)
    names = rows.select("vec_id", F.explode(F.array("intent", F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")))).alias("intent"))
    sets = P.sets_per_key(names, "vec_id", ("intent",))
    out = P.alignment(rows.drop("intent").join(sets, "vec_id", "left"))
    return out.select("same_intent_pairs", r6(F.col("alignment")).alias("alignment"))


@query(oracle(["emb_rows"], """
SELECT ia AS intent, count(*) AS pairs, round(avg(d2), 6) AS alignment FROM pairs WHERE ia = ib GROUP BY ia""", ALL_PAIRS))
def align_by_label(t):
    out = P.pair_distances(unit_rows(t), ["intent"])
    return out.select("intent", "pairs", r6(F.col("distance_sum") / F.col("pairs")).alias("alignment"))


@query(oracle(["emb_rows"], "SELECT count(*) AS pairs, round(avg(-2 * d2), 6) AS mean_log_potential FROM pairs", ALL_PAIRS))
def mean_log_potential(t):
    out = P.mean_log_potential(unit_rows(t))
    return out.select("pairs", r6(F.col("mean_log_potential")).alias("mean_log_potential"))


def batch_rows(t):
    """Batches of 16 consecutive vectors; u2 and t2 are the neighbours, wrapping inside the batch."""
    rows = t.table("embeddings").select(
        F.floor(F.col("vec_id") / 16).cast("bigint").alias("batch"), (F.col("vec_id") % 16).alias("pos"), F.col("embedding").alias("v")
    )
    size = rows.groupBy("batch").agg(F.count("*").alias("n"))
    sized = rows.join(size, "batch")
    near = {
        "u1": F.lit(0), "u2": F.lit(1), "t1": F.lit(2), "t2": F.lit(3),
    }
    shifted = sized.select(
        "batch",
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.pmod(F.col("pos") - k, F.col("n")).alias("pos")) for c, k in near.items()])).alias("s"),
        "v",
    )
    return shifted.groupBy("batch", F.col("s.pos").alias("pos")).agg(
        *[F.max_by("v", F.when(F.col("s.c") == c, 1).otherwise(0)).alias(c) for c in near]
    )


BATCHES = f"""
b AS (SELECT vec_id // 16 AS batch, vec_id % 16 AS pos, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER (PARTITION BY vec_id // 16) AS n FROM embeddings),
m AS (SELECT a.batch, a.pos, a.v AS u1, c.v AS u2, d.v AS t1, e.v AS t2 FROM b a
  JOIN b c ON c.batch = a.batch AND c.pos = (a.pos + 1) % a.n JOIN b d ON d.batch = a.batch AND d.pos = (a.pos + 2) % a.n
  JOIN b e ON e.batch = a.batch AND e.pos = (a.pos + 3) % a.n),
s AS (SELECT x.batch, x.pos AS i, y.pos AS j, list_cosine_similarity(x.u1, y.u2) / 0.05 AS utterance, list_cosine_similarity(x.t1, y.t2) / 0.05 AS template,
  list_cosine_similarity(x.u1, y.t1) / 0.05 AS pair_pattern, list_cosine_similarity(x.t1, y.u1) / 0.05 AS pair_utterance FROM m x JOIN m y ON x.batch = y.batch),
long AS (UNPIVOT s ON utterance, template, pair_pattern, pair_utterance INTO NAME loss VALUE v),
losses AS (SELECT batch, loss, avg(lse - diag) AS value FROM (SELECT batch, loss, i, ln(sum(exp(v))) AS lse, max(CASE WHEN i = j THEN v END) AS diag
  FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("WITH " + BATCHES.strip() + "\nSELECT batch, loss, round(value, 6) AS value FROM losses")
def infonce_losses(t):
    return L.contrastive_losses(batch_rows(t)).select("batch", "loss", r6(F.col("value")).alias("value"))


@query("WITH " + BATCHES.strip() + """
SELECT batch, round(u + 0.5 * tp + 2 * (0.5 * pu + 0.5 * pp), 6) AS loss FROM (SELECT batch, max(CASE loss WHEN 'utterance' THEN value END) AS u,
  max(CASE loss WHEN 'template' THEN value END) AS tp, max(CASE loss WHEN 'pair_pattern' THEN value END) AS pp,
  max(CASE loss WHEN 'pair_utterance' THEN value END) AS pu FROM losses GROUP BY batch)""")
def infonce_total(t):
    total = L.total_loss(L.contrastive_losses(batch_rows(t)), 1.0, 0.5, 2.0, "balanced")
    return total.select("batch", r6(F.col("loss")).alias("loss"))


def token_rows(t):
    """Each vector, all 64 components, as 4 layers x 4 tokens x 4 dimensions; the mask keeps the first vec_id % 4 + 1 tokens."""
    cells = F.array(*[
        F.struct(F.lit(layer).alias("layer"), F.lit(pos).alias("pos"), F.slice("embedding", layer * 16 + pos * 4 + 1, 4).alias("vec"))
        for layer in range(4) for pos in range(4)
    ])
    rows = t.table("embeddings").select(F.col("vec_id").alias("utt_id"), F.explode(cells).alias("c"))
    mask = (F.col("c.pos") <= F.col("utt_id") % 4).cast("int")
    return rows.select("utt_id", "c.layer", "c.pos", mask.alias("mask"), "c.vec")


@query("""WITH cells AS (SELECT vec_id AS utt_id, layer, pos, CAST(embedding[layer * 16 + pos * 4 + 1 : layer * 16 + pos * 4 + 4] AS DOUBLE[]) AS vec
  FROM embeddings, (SELECT unnest(range(4)) AS layer), (SELECT unnest(range(4)) AS pos) WHERE pos <= vec_id % 4),
means AS (SELECT utt_id, layer, d, avg(vec[d + 1]) AS m FROM (SELECT *, CAST(unnest(range(4)) AS INTEGER) AS d FROM cells) GROUP BY 1, 2, 3),
layers AS (SELECT utt_id, d, max(CASE layer WHEN 0 THEN m END) AS l0, max(CASE layer WHEN 1 THEN m END) AS l1, max(CASE layer WHEN 2 THEN m END) AS l2, max(CASE layer WHEN 3 THEN m END) AS l3 FROM means GROUP BY 1, 2),
ends AS (SELECT utt_id, arg_min(vec, pos) AS first, arg_max(vec, pos) AS last_real FROM cells WHERE layer = 3 GROUP BY 1)
SELECT l.utt_id, l.d AS dim, round(first[l.d + 1], 6) AS first, round(last_real[l.d + 1], 6) AS last_real, round(l3, 6) AS mean,
  round((l0 + l3) / 2, 6) AS mean_first_last, round((l2 + l3) / 2, 6) AS mean_last_two FROM layers l JOIN ends e ON l.utt_id = e.utt_id""")
def token_pooling(t):
    pooled = O.pool_all(token_rows(t))
    dims = pooled.select("utt_id", F.posexplode(F.arrays_zip(*O.POOLERS)).alias("dim", "p"))
    return dims.select("utt_id", "dim", *[r6(F.col(f"p.{h}")).alias(h) for h in O.POOLERS])


# Metadata of the plot table: labels as intents, every fifth vector without a slot in its template.
META = """
meta AS (SELECT vec_id, concat('utterance ', CAST(vec_id AS VARCHAR(20))) AS utterance, CASE WHEN vec_id % 5 = 0 THEN 'plain' ELSE 'play {SLOT}' END AS pattern,
  intent FROM emb_rows)"""


def plot_inputs(t):
    rows = ev.with_templates(t.view("emb_rows"))
    utterance = F.concat(F.lit("utterance "), F.col("vec_id").cast("string"))
    meta = rows.select(
        utterance.alias("utterance"), F.when(F.col("vec_id") % 5 == 0, "plain").otherwise("play {SLOT}").alias("pattern"),
        F.lit("d").alias("domain"), "intent",
    )
    vectors = rows.select(utterance.alias("utterance"), F.col("vec").alias("embedding_vector"), F.col("tpl_vec").alias("ptn_vector"), F.col("vec").alias("utt_vector"))
    return vectors, meta


@query(oracle(["emb_rows"], """
SELECT value, label, round(sqrt(list_sum(list_transform(CAST(v AS DOUBLE[]), lambda x: x * x))), 6) AS was_norm, count(*) AS copies FROM (
  SELECT m.pattern AS value, '0:Pattern' AS label, b.vec AS v FROM meta m JOIN emb_rows a USING (vec_id) JOIN emb_rows b ON a.tpl_id = b.vec_id
    WHERE m.intent IN (SELECT intent FROM top) AND contains(m.pattern, '}')
  UNION ALL SELECT m.utterance, '1:Utterance', a.vec FROM meta m JOIN emb_rows a USING (vec_id)
    WHERE m.intent IN (SELECT intent FROM top) AND contains(m.pattern, '}')) GROUP BY 1, 2, 3""", META + """,
top AS (SELECT intent FROM meta GROUP BY intent ORDER BY count(DISTINCT utterance) DESC, intent LIMIT 3)"""))
def top_intents_plot_rows(t):
    """The most populous intents are the feature; slotless templates are left out of the plot."""
    vectors, meta = plot_inputs(t)
    rows = B.stacked_view(B.plot_rows(vectors, meta, 3, p=0))
    return rows.groupBy("value", "label", r6(V.norm(F.col("vec"))).alias("was_norm")).agg(F.count("*").alias("copies"))


@query(oracle(["annotated"], f"""
SELECT intent, count(DISTINCT utterance) AS utterances FROM annotated GROUP BY intent ORDER BY utterances DESC, intent LIMIT 5"""))
def top_intents(t):
    return B.top_intents(t.view("annotated").select("utterance", "intent"), 5)


# ---------------------------------------------------------------- learned or approximate; held against exact quantities

@query(oracle(["emb_rows"], """
SELECT count(*) AS expected, count(*) AS found, 1.0::DOUBLE AS recall FROM ranked WHERE rank <= 5""", RANKED))
def ivf_recall(t):
    """With every cell probed the inverted file must find what exact search finds; tests bound it with fewer."""
    rows = t.view("emb_rows")
    q, refs = ev.queries(rows), ev.references(rows)
    exact = R.top_matches(q, refs, k=5)
    return R.recall(R.cell_matches(q, refs, k=5, cells=20, probes=20), exact)


@query(oracle(["emb_rows"], "SELECT qid, ref_idx, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM ranked WHERE rank <= 5", RANKED))
def ivf_matches(t):
    """The same search, row by row."""
    rows = t.view("emb_rows")
    found = R.cell_matches(ev.queries(rows), ev.references(rows), k=5, cells=20, probes=20)
    return found.select("qid", "ref_idx", "rank", r6(F.col("score")).alias("score"))


@query("SELECT 5 * least(1, (SELECT count(*) FROM documents) // 5) * count(*) AS expected, TRUE AS recalled, TRUE AS pruned FROM documents WHERE doc_id % 50 = 0")
def ann_recall(t):
    """Documents by their hashed words: of the five nearest of every query, nine tenths or more are found, with half of the cells or fewer."""
    rows = stage(E.encode_hashed(t.table("documents").select(F.col("doc_id").alias("idx"), "text")).select("idx", "vec"), "encoded")
    q = rows.where("idx % 50 = 0").withColumnRenamed("idx", "qid")
    known = R.fit_quantiser(rows)
    placed = R.indexed(rows, known)
    measured = R.calibration(q, rows, 5)
    probes = R.calibrated_probes(q, rows, known, placed, 5, measured=measured)
    shortlist = R.calibrated_shortlist(q, rows, known, placed, probes, 5, measured=measured)
    found = R.code_matches(q, rows, k=5, probes=probes, shortlist=shortlist, known=known, placed=placed)
    return R.recall(found, R.top_matches(q, rows, k=5)).select(
        "expected", (F.col("recall") >= 0.9).alias("recalled"), F.lit(2 * probes <= len(known.centres)).alias("pruned"))


@query(oracle(["emb_rows"], "SELECT split, 1.0::DOUBLE AS accuracy, count(*) AS total FROM emb_rows WHERE split <> 'train' GROUP BY split"))
def linear_probe(t):
    """Vectors with their label's own component raised are linearly separable: every prediction must be right."""
    rows = t.view("emb_rows")
    raised = F.transform(F.col("vec").cast("array<double>"), lambda x, i: x + F.when(i == F.col("intent").cast("int"), 25.0).otherwise(0.0))
    rows = rows.withColumn("vec", raised)
    scored = B.linear_probe(ev.references(rows), ev.queries(rows), iterations=50)
    return M.accuracy(scored, ["split"], predicted="predicted")


@query(oracle(["emb_rows"], """
SELECT label, count(*) AS points, TRUE AS inside FROM (
  SELECT '0:Pattern' AS label FROM meta m WHERE m.intent IN (SELECT intent FROM top) AND contains(m.pattern, '}')
  UNION ALL SELECT '1:Utterance' FROM meta m WHERE m.intent IN (SELECT intent FROM top) AND contains(m.pattern, '}')) GROUP BY 1""", META + """,
top AS (SELECT intent FROM meta GROUP BY intent ORDER BY count(DISTINCT utterance) DESC, intent LIMIT 3)"""))
def pca_table(t):
    """Points per label; a projection of unit vectors stays inside the unit circle."""
    vectors, meta = plot_inputs(t)
    points = B.plot_points(B.stacked_view(B.plot_rows(vectors, meta, 3)))
    inside = F.bool_and(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1.000001)
    return points.groupBy("label").agg(F.count("*").alias("points"), inside.alias("inside"))


BUCKETED = """
hashed AS (SELECT {id}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 128 AS b, count(*) AS n FROM (
  SELECT {id}, unnest(string_split(k, ' ')) AS w FROM (SELECT {id}, {key} AS k FROM {table}) WHERE k <> '') GROUP BY 1, 2)"""


@query("WITH " + BUCKETED.format(id="doc_id", key=key_sql("text"), table="documents").strip() + """
SELECT d.doc_id, CASE WHEN count(b) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit_norm, CAST(count(b) AS INTEGER) AS active,
  coalesce(round(max(n) / sqrt(sum(n * n)), 6), 0) AS largest
FROM documents d LEFT JOIN hashed USING (doc_id) GROUP BY d.doc_id""")
def encode_hash(t):
    encoded = E.encode_hashed(t.table("documents"), dims=128)
    return encoded.select("doc_id", r6(V.norm(F.col("vec"))).alias("unit_norm"), F.size(F.filter("vec", lambda x: x > 0)).alias("active"),
                          r6(F.array_max("vec")).alias("largest"))


@query(oracle(["turns"], """
SELECT qid, round(max(s), 6) AS score FROM (
  SELECT q.idx AS qid, r.idx AS rid, coalesce(sum(a.n * b.n) / (any_value(q.len) * any_value(r.len)), 0) AS s FROM lens q JOIN hashed a USING (idx)
  JOIN hashed b USING (b) JOIN lens r ON r.idx = b.idx WHERE q.intent <> 'assistant' AND r.intent = 'assistant' GROUP BY 1, 2)
GROUP BY 1""", BUCKETED.format(id="idx", key=key_sql("utterance"), table="turns") + """,
lens AS (SELECT t.idx, t.intent, sqrt(sum(n * n)) AS len FROM turns t JOIN hashed USING (idx) GROUP BY 1, 2)"""))
def encoded_text_nn(t):
    """Conversation turns encoded and matched: user turns against assistant turns; the best score of each."""
    turns = E.encode_hashed(t.view("turns").select("idx", "intent", "utterance"), text="utterance", dims=128)
    refs = turns.filter(F.col("intent") == "assistant").select("idx", "intent", "vec")
    q = turns.filter(F.col("intent") != "assistant").select(F.col("idx").alias("qid"), "intent", "vec")
    return R.nearest(stage(q, "queries"), stage(refs, "references")).select("qid", r6(F.col("score")).alias("score"))
