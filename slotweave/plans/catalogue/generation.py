"""Vocabulary and slot-substitution queries."""

from pyspark.sql import functions as F

from slotweave.functions import annotation as A
from slotweave.functions import text as X
from slotweave.operators import generate as G
from slotweave.operators import splits as S
from slotweave.operators import vocab as V
from slotweave.plans import corpus
from slotweave.plans.catalogue.texts import ANN, MASKED, SLOTS, examples
from slotweave.plans.registry import query
from slotweave.plans.views import key_sql, oracle
from slotweave.session import broadcast_if_small, stage
from slotweave.sources.readers import pair_by_position, pair_log_lines

KS = {"ship": 2, "order": 3}


# ---------------------------------------------------------------- oracle text

def clean_sql(scope="source"):
    on = "AND h.source = a.source" if scope == "source" else ""
    return f"""
held AS (SELECT DISTINCT source, {key_sql('utterance')} AS k FROM annotated WHERE split <> 'train'),
clean AS (SELECT *, {MASKED} AS pattern FROM annotated a WHERE split = 'train'
  AND NOT EXISTS (SELECT 1 FROM held h WHERE h.k = {key_sql('a.utterance')} {on})),
slots AS (SELECT ex_id, source, pos, kind, value FROM (
  SELECT ex_id, source, unnest(regexp_extract_all(annotation, {ANN}, 1)) AS kind,
    unnest(regexp_extract_all(annotation, {ANN}, 2)) AS value,
    unnest(range(len(regexp_extract_all(annotation, {ANN}, 1)))) AS pos FROM clean)),
freq AS (SELECT source, kind, value, count(*) AS cnt, min(ex_id * 100 + pos) AS first_at FROM slots GROUP BY 1, 2, 3)"""


def vocab_sql(depth="CASE source WHEN 'ship' THEN 2 ELSE 3 END", keep="TRUE"):
    return f"""
vocab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY cnt DESC, first_at) AS rank
  FROM freq WHERE {keep}) WHERE rank <= {depth}),
sizes AS (SELECT source, kind, count(*) AS n FROM vocab GROUP BY 1, 2)"""


def spelled_sql():
    """Every combination with its index, then the first spelling of each text, the original as 0."""
    def put(text, kind, value):
        return rf"regexp_replace({text}, '\[{kind} : [^\]]*\]', {value})"

    ship = put(put("c.annotation", "segment", "v1.value"), "nation", "v2.value")
    order = put(put(put("c.annotation", "item", "v1.value"), "brand", "v2.value"), "size", "v3.value")

    def v(i, source, kind):
        return f"(SELECT * FROM vocab WHERE source = '{source}' AND kind = '{kind}') v{i}"

    def n(source, kind):
        return f"(SELECT n FROM sizes WHERE source = '{source}' AND kind = '{kind}')"

    return f"""
combos AS (
  SELECT c.source, c.ex_id, 0 AS variant, 0 AS depth, c.utterance FROM clean c
  UNION ALL SELECT c.source, c.ex_id, 1 + (v1.rank - 1) * {n('ship', 'nation')} + v2.rank - 1, greatest(v1.rank, v2.rank), {ship}
  FROM (SELECT * FROM clean WHERE source = 'ship') c, {v(1, 'ship', 'segment')}, {v(2, 'ship', 'nation')}
  UNION ALL SELECT c.source, c.ex_id, 1 + ((v1.rank - 1) * {n('order', 'brand')} + v2.rank - 1) * {n('order', 'size')} + v3.rank - 1,
    greatest(v1.rank, v2.rank, v3.rank), {order}
  FROM (SELECT * FROM clean WHERE source = 'order') c, {v(1, 'order', 'item')}, {v(2, 'order', 'brand')}, {v(3, 'order', 'size')})"""


def generated_sql(cap=None, scope="source", keep="TRUE", **kw):
    limit = "" if cap is None else f"WHERE variant <= {cap}"
    on = "AND h.source = g.source" if scope == "source" else ""
    return f"""{clean_sql(scope)},{vocab_sql(keep=keep, **kw)},{spelled_sql()},
first_ AS (SELECT source, ex_id, utterance, min(variant) AS variant FROM combos {limit} GROUP BY 1, 2, 3),
generated AS (SELECT g.source, g.ex_id, CAST(g.variant AS BIGINT) AS variant, g.utterance, c.pattern, c.intent,
    EXISTS (SELECT 1 FROM held h WHERE h.k = {key_sql('g.utterance')} {on}) AS held
  FROM first_ g JOIN clean c ON c.source = g.source AND c.ex_id = g.ex_id)"""


ROWS = "SELECT source, ex_id, variant, utterance, pattern FROM generated WHERE NOT held"


# ---------------------------------------------------------------- vocabulary

@query(oracle(["annotated"], "SELECT source, kind, value, count(*) AS cnt FROM slots GROUP BY 1, 2, 3", SLOTS))
def slot_freq(t):
    return V.slot_frequencies(V.slot_occurrences(examples(t))).select("source", "kind", "value", "cnt")


@query(oracle(["annotated"], """
SELECT source, kind, value, count(DISTINCT ex_id) AS cnt FROM slots GROUP BY 1, 2, 3""", SLOTS))
def slot_freq_distinct(t):
    """Once per example, read the historic way."""
    rows = t.view("annotated").withColumn("parts", A.legacy_slot_values(F.col("annotation")))
    return V.slot_frequencies(V.slot_occurrences(rows, "per_example")).select("source", "kind", "value", "cnt")


@query(oracle(["spans"], """
SELECT 'parts' AS source, CASE WHEN contains(kind, '.') THEN split_part(kind, '.', 2) ELSE kind END AS kind, value, count(*) AS cnt,
  min(ex_id) AS first_ex FROM spans GROUP BY 1, 2, 3"""))
def entity_value_freq(t):
    """Values as the entity's own field, not the text span."""
    rows = t.view("spans").groupBy("ex_id").agg(
        F.collect_list(F.struct("start", "stop", "kind", "value")).alias("spans")
    ).withColumn("source", F.lit("parts"))
    freq = V.slot_frequencies(V.entity_value_occurrences(rows))
    return freq.select("source", "kind", "value", "cnt", X.int_div(F.col("first"), F.lit(V.MAX_SLOTS)).alias("first_ex"))


@query(oracle(["annotated"], """
SELECT 'label' AS counter, kind AS item, count(*) AS cnt FROM slots GROUP BY 2
UNION ALL SELECT 'value', value, count(*) FROM slots GROUP BY 2""", SLOTS))
def label_value_counters(t):
    return V.label_and_value_counts(V.slot_occurrences(examples(t)))


@query(oracle(["annotated"], "SELECT source, kind, CAST(rank AS INTEGER) AS rank, value, cnt FROM vocab",
              clean_sql() + "," + vocab_sql()))
def topk_vocab(t):
    return V.slot_vocabulary(corpus.clean_training(examples(t)), KS)


@query(oracle(["annotated"], f"""
SELECT a.source, count(DISTINCT a.ex_id) AS examples, count(DISTINCT annotation) AS raw_templates, count(DISTINCT {MASKED}) AS masked_templates,
  count(DISTINCT s.kind) AS slot_kinds, count(DISTINCT s.value) AS slot_values
FROM annotated a LEFT JOIN slots s ON a.ex_id = s.ex_id GROUP BY a.source""", SLOTS))
def corpus_summary(t):
    return V.corpus_summary(examples(t))


EVIDENCE_SQL = f"""
stats AS (SELECT a.source, count(DISTINCT a.ex_id) AS originals, count(DISTINCT s.kind) AS slots, count(DISTINCT s.value) AS vals,
  count(DISTINCT {MASKED}) AS templates FROM annotated a LEFT JOIN slots s ON a.ex_id = s.ex_id GROUP BY a.source)"""


def evidence(t):
    slots = F.transform(
        F.filter("parts", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("type"), p["value"].alias("value"))
    )
    return examples(t).select("source", "utterance", A.parts_to_pattern(F.col("parts")).alias("template"), slots.alias("slots"))


@query(oracle(["annotated"], "SELECT source, originals, slots, vals AS \"values\", templates FROM stats", SLOTS + "," + EVIDENCE_SQL))
def original_stats(t):
    return V.original_statistics(evidence(t))


@query(oracle(["annotated"], """
SELECT CAST(sum(originals) AS BIGINT) AS originals, CAST(sum(slots) AS BIGINT) AS slots, CAST(sum(vals) AS BIGINT) AS "values",
  CAST(sum(templates) AS BIGINT) AS templates FROM stats""", SLOTS + "," + EVIDENCE_SQL))
def stats_totals(t):
    return V.summed_statistics(V.original_statistics(evidence(t)), ["ship", "order"])


# ---------------------------------------------------------------- generation

@query(oracle(["annotated"], ROWS, generated_sql()))
def augment_cartesian(t):
    return corpus.augment(examples(t), KS, scope=["source"]).select("source", "ex_id", "variant", "utterance", "pattern")


@query(oracle(["annotated"], """
SELECT source, pattern, count(*) AS row_count, count(DISTINCT utterance) AS texts FROM generated WHERE NOT held GROUP BY 1, 2""", generated_sql()))
def augment_by_template(t):
    out = corpus.augment(examples(t), KS, scope=["source"])
    return out.groupBy("source", "pattern", "utterance").agg(F.count("*").alias("n")).groupBy("source", "pattern").agg(
        F.sum("n").alias("row_count"), F.count("*").alias("texts")
    )


@query(oracle(["annotated"], ROWS, generated_sql(cap=5)))
def augment_capped(t):
    return corpus.augment(examples(t), KS, scope=["source"], cap=5).select("source", "ex_id", "variant", "utterance", "pattern")


@query(oracle(["annotated"], """
SELECT source, ex_id, variant, replace(utterance, ',', ' ') AS utterance, replace(pattern, ',', ' ') AS pattern FROM generated""",
              generated_sql(keep="kind <> 'brand'")))
def augment_unknown_slot(t):
    """Historic rules: one kind has no vocabulary, so its examples keep only their original; commas go."""
    clean = corpus.staged_training(examples(t))
    vocabulary = corpus.staged_vocabulary(clean, KS).filter(F.col("kind") != "brand")
    out = G.generate(clean, vocabulary, unknown_slot="original_only", commas="space")
    return out.select("source", "ex_id", "variant", "utterance", "pattern")


@query(oracle(["annotated"], """
SELECT source, ex_id, 0::BIGINT AS variant, utterance, pattern FROM clean""", clean_sql()))
def augment_depth_zero(t):
    out = G.originals_only(corpus.clean_training(examples(t)))
    return out.select("source", "ex_id", "variant", "utterance", "pattern")


@query(oracle(["annotated"], """
SELECT g.source, g.intent, count(*) AS row_count, CAST(sum(1 + length(g.utterance) - length(replace(g.utterance, chr(10), ''))) AS BIGINT) AS physical_lines
FROM generated g WHERE NOT held AND intent = (SELECT max(intent) FROM clean c WHERE c.source = g.source) GROUP BY 1, 2""", generated_sql()))
def augment_retain_last(t):
    """Only the last intent of each source survives, as with a file reopened per intent."""
    rows = examples(t).withColumn("label_rank", F.col("intent"))
    kept = G.retain_groups(corpus.augment(rows, KS, scope=["source"]), "last")
    return kept.groupBy("source", "intent").agg(
        F.count("*").alias("row_count"), F.sum(X.physical_lines(F.col("utterance"))).alias("physical_lines")
    )


@query(oracle(["annotated"], """
SELECT intent, k, count(*) AS "rows" FROM (
  SELECT c.intent, g.ex_id, g.utterance, min(depth) AS depth FROM combos g JOIN clean c ON c.source = g.source AND c.ex_id = g.ex_id
  GROUP BY 1, 2, 3) d, (SELECT CAST(unnest(range(6)) AS INTEGER) AS k) ks WHERE d.depth <= ks.k GROUP BY 1, 2""",
              clean_sql() + "," + vocab_sql("5") + "," + spelled_sql()))
def topk_sweep(t):
    """Rows per intent for k = 0..5 from a single generation."""
    clean = corpus.staged_training(examples(t))
    return G.depth_sweep(clean, corpus.staged_vocabulary(clean, 5), [0, 1, 2, 3, 4, 5], ["intent"])


@query(oracle(["annotated"], """
SELECT c.source, c.intent, count(*) AS examples, CAST(sum(CASE c.source WHEN 'ship' THEN s.p ELSE o.p END) AS BIGINT) AS combinations FROM clean c,
  (SELECT product(n) AS p FROM sizes WHERE source = 'ship') s, (SELECT product(n) AS p FROM sizes WHERE source = 'order') o GROUP BY 1, 2""",
              clean_sql() + "," + vocab_sql()))
def augment_size_estimate(t):
    clean = corpus.staged_training(examples(t))
    out = G.size_estimate(clean, corpus.staged_vocabulary(clean, KS), ["source", "intent"])
    return out.withColumn("combinations", F.col("combinations").cast("bigint"))  # the oracle's type; ANSI casts check it


REPORT = """
SELECT g.source, count(*) FILTER (variant = 0) AS train_examples, count(*) FILTER (NOT held) AS output_rows,
  count(*) FILTER (held) AS removed_rows, count(*) FILTER (variant = 0 AND {truncated}) AS truncated_examples FROM generated g GROUP BY 1"""


@query(oracle(["annotated"], REPORT.format(truncated="(SELECT product(n) FROM sizes s WHERE s.source = g.source) > 5"), generated_sql(cap=5)))
def augment_report(t):
    rows = examples(t)
    generated, keys = corpus.generation_inputs(rows, KS, ["source"], cap=5)
    return G.generation_report(generated, keys, ["source"])


@query(oracle(["annotated"], REPORT.format(truncated="FALSE"), generated_sql(scope="pooled")))
def augment_pooled_report(t):
    """Held-out keys pooled over all sources instead of per source."""
    generated, keys = corpus.generation_inputs(examples(t), KS, [])
    return G.generation_report(generated, keys)


@query(oracle(["annotated"], ROWS, generated_sql()))
def augment_from_log(t):
    """The same corpus replayed from the annotation log."""
    logged = pair_log_lines(t.view("log_lines"))
    ids = corpus.number_examples(t.view("annotated"), "ex_id")
    joined = pair_by_position(logged, ids.select("pair", "ex_id", "source", "split", "utterance"), position="pair")
    replay = joined.select("ex_id", "source", "split", "utterance", A.parse_annotation(F.col("annotation")).alias("parts"))
    return corpus.augment(replay, KS, scope=["source"]).select("source", "ex_id", "variant", "utterance", "pattern")


@query(oracle(["annotated"], """
SELECT source, ex_id, variant, replace(utterance, ',', ' ') AS utterance,
  CASE source WHEN 'ship' THEN regexp_replace(replace(pattern, ',', ' '), 'zone [0-9]+', '{SLOT}') ELSE pattern END AS pattern
FROM generated WHERE NOT held AND (source = 'order' OR variant = 0)""", generated_sql()))
def augment_legacy_brackets(t):
    """Historic reading: a literal bracket masks like a slot but names no kind, so only the original
    of its example is kept."""
    rows = t.view("annotated").withColumn("annotation", F.regexp_replace("annotation", "zone [0-9]+", "[ zone ]"))
    parsed = rows.withColumn("parts", A.legacy_brackets_to_parts(F.col("annotation"))).drop("annotation")
    keys = broadcast_if_small(stage(corpus.heldout(parsed, ["source"]), "heldout"))
    clean = corpus.staged_training(parsed, keys=keys)
    vocabulary = corpus.staged_vocabulary(clean, KS)
    out = S.decontaminate(G.generate(clean, vocabulary, unknown_slot="original_only"), keys, scope=["source"])
    return out.select("source", "ex_id", "variant", X.commas_to_spaces(F.col("utterance")).alias("utterance"),
                      X.commas_to_spaces(F.col("pattern")).alias("pattern"))


@query(oracle(["annotated"], """
SELECT g.source, 'prepared' AS status, CASE g.source WHEN 'ship' THEN 2 ELSE 3 END AS top_k, 5 AS cap, count(*) FILTER (variant = 0) AS train_examples,
  count(*) FILTER (NOT held) AS output_rows, count(*) FILTER (held) AS removed_rows,
  count(*) FILTER (variant = 0 AND (SELECT product(n) FROM sizes s WHERE s.source = g.source) > 5) AS truncated_examples,
  (SELECT count(*) FROM held h WHERE h.source = g.source) AS heldout_keys, (SELECT count(*) FROM vocab v WHERE v.source = g.source) AS vocabulary_values
FROM generated g GROUP BY 1
UNION ALL SELECT 'absent', 'missing', 1, 5, 0, 0, 0, 0, 0, 0""", generated_sql(cap=5)))
def release_manifest(t):
    """Provenance of a capped generation; a declared source without rows is told as missing."""
    keys = broadcast_if_small(stage(corpus.heldout(examples(t), ["source"]), "heldout"))
    clean = corpus.staged_training(examples(t), ["source"], keys)
    vocabulary = corpus.staged_vocabulary(clean, KS)
    flagged = stage(S.flag_heldout(G.generate(clean, vocabulary, 5), keys, scope=["source"]), "generated")
    return G.manifest(flagged, keys, vocabulary, {**KS, "absent": 1}, 5, ["source"]).drop("vocabulary_sha256")
