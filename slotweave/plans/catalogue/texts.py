"""Scalar text, annotation and token queries."""

from pyspark.sql import functions as F

from slotweave.functions import annotation as A
from slotweave.functions import text as X
from slotweave.operators import encode as E
from slotweave.operators import splits as S
from slotweave.operators import vocab as V
from slotweave.plans.registry import query
from slotweave.plans.views import key_sql, oracle

ANN = r"'\[([^\[\]:]+?)\s+:\s+([^\[\]]*?)\]'"
MASKED = r"regexp_replace(annotation, '\[[^\[\]]+\]', '{SLOT}', 'g')"


def examples(t):
    """The annotated view with parsed parts."""
    return t.view("annotated").withColumn("parts", A.parse_annotation(F.col("annotation"))).drop("annotation")


# One row per slot part: ex_id, source, split, pos (0-based among slots), kind, value.
SLOTS = rf"""slots AS (SELECT ex_id, source, split, pos, kind, value FROM (
  SELECT ex_id, source, split, unnest(regexp_extract_all(annotation, {ANN}, 1)) AS kind,
    unnest(regexp_extract_all(annotation, {ANN}, 2)) AS value,
    unnest(range(len(regexp_extract_all(annotation, {ANN}, 1)))) AS pos FROM annotated))"""


@query(oracle(["annotated"], f"SELECT ex_id, {MASKED} AS masked FROM annotated"))
def mask_generic(t):
    return t.view("annotated").select("ex_id", X.generic_mask(F.col("annotation")).alias("masked"))


@query(oracle(["annotated"], "SELECT ex_id, CAST(pos AS BIGINT) AS pos, kind, value FROM slots", SLOTS))
def parse_annotation_slots(t):
    slots = F.filter("parts", lambda p: p["kind"].isNotNull())
    return examples(t).select("ex_id", F.posexplode(slots).alias("pos", "p")).select(
        "ex_id", F.col("pos").cast("bigint").alias("pos"), "p.kind", "p.value"
    )


@query(oracle(["annotated"], rf"""
SELECT ex_id, regexp_replace(annotation, {ANN}, '\2', 'g') AS spelled, annotation AS rebuilt,
  regexp_replace(annotation, {ANN}, '{{SLOT}}', 'g') AS pattern FROM annotated"""))
def parts_round_trip(t):
    parts = F.col("parts")
    return examples(t).select(
        "ex_id", A.parts_to_text(parts).alias("spelled"), A.parts_to_annotation(parts).alias("rebuilt"),
        A.parts_to_pattern(parts).alias("pattern"),
    )


@query(oracle(["annotated"], rf"""
SELECT ex_id, CASE WHEN m SIMILAR TO '.*[\[\]].*' THEN NULL ELSE m END AS pattern FROM (
  SELECT ex_id, regexp_replace(annotation, '\[([^\[\]:]+?)\s*:\s*([^\[\]]+)\]', '{{SLOT}}', 'g') AS m FROM annotated)"""))
def strict_mask_rows(t):
    return t.view("annotated").select("ex_id", A.strict_mask(F.col("annotation")).alias("pattern"))


@query(oracle(["annotated"], f"""
SELECT source, intent, CAST((length(m) - length(replace(m, '{{SLOT}}', ''))) / 6 AS BIGINT) AS slot_count, count(*) AS cnt
FROM (SELECT source, intent, {MASKED} AS m FROM annotated) GROUP BY 1, 2, 3"""))
def slot_count_hist(t):
    masked = t.view("annotated").withColumn("pattern", X.generic_mask(F.col("annotation")))
    return V.slot_count_histogram(masked, ["source", "intent"])


def span_rows(t):
    entity = F.struct("start", "stop", "kind", "value")
    return t.view("spans").groupBy("ex_id", "text").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ent_ord", entity.alias("e")))), lambda s: s["e"]).cast(A.SPANS_TYPE).alias("spans")
    )


@query(oracle(["spans"], """
SELECT ex_id, text,
  CASE WHEN bool_and(prev <= start AND start >= 0 AND start < stop AND stop <= length(text))
    THEN string_agg(substr(text, prev + 1, start - prev) || '{SLOT}', '' ORDER BY start) || substr(text, max(stop) + 1) END AS pattern
FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY ex_id ORDER BY start), 0) AS prev FROM spans) GROUP BY ex_id, text"""))
def spans_to_pattern(t):
    text, spans = F.col("text"), F.col("spans")
    return span_rows(t).select("ex_id", "text", A.parts_to_pattern(A.spans_to_parts(text, spans)).alias("pattern"))


@query(oracle(["spans"], """
SELECT ex_id, substr(once, 1, s1 + shift) || '{SLOT}' || substr(once, e1 + shift + 1) AS masked,
  substr(typed, 1, s1 + tshift) || '[' || kind1 || ' : ' || value1 || ']' || substr(typed, e1 + tshift + 1) AS typed
FROM (SELECT a.ex_id, substr(a.text, 1, a.start) || '{SLOT}' || substr(a.text, a.stop + 1) AS once,
    6 - (a.stop - a.start) AS shift,
    substr(a.text, 1, a.start) || '[' || a.kind || ' : ' || a.value || ']' || substr(a.text, a.stop + 1) AS typed,
    length('[' || a.kind || ' : ' || a.value || ']') - (a.stop - a.start) AS tshift,
    b.start AS s1, b.stop AS e1, b.kind AS kind1, b.value AS value1
  FROM spans a JOIN spans b ON a.ex_id = b.ex_id AND a.ent_ord = 0 AND b.ent_ord = 1)"""))
def offset_mask_legacy(t):
    text, spans = F.col("text"), F.col("spans")
    return span_rows(t).select(
        "ex_id", A.offset_mask(text, spans).alias("masked"), A.offset_mask(text, spans, typed=True).alias("typed")
    )


@query(oracle(["spans"], """
SELECT ex_id, ent_ord, value AS text, shift < 0 OR shift > 0 AS repaired, '{SLOT}' AS pattern
FROM (SELECT *, start - (strpos(text, value) - 1) AS shift FROM spans)"""))
def repair_whole_spans(t):
    """Each entity value as its own utterance; the shifted ones no longer fit and are repaired."""
    base = F.instr("text", F.col("value")) - 1
    items = t.view("spans").select(
        "ex_id", "ent_ord", F.col("value").alias("text"),
        F.array(F.struct((F.col("start") - base).alias("start"), (F.col("stop") - base).alias("stop"), "kind", "value"))
        .cast(A.SPANS_TYPE).alias("spans"),
    )
    text, spans = F.col("text"), F.col("spans")
    return items.select(
        "ex_id", "ent_ord", "text", A.needs_repair(text, spans).alias("repaired"),
        A.parts_to_pattern(A.spans_to_parts(text, A.repair_whole_span(text, spans))).alias("pattern"),
    )


@query(oracle(["spans"], """
SELECT CASE WHEN contains(kind, '.') THEN split_part(kind, '.', 2) ELSE kind END AS kind, value, count(*) AS cnt
FROM spans GROUP BY 1, 2"""))
def strip_role_counts(t):
    return t.view("spans").groupBy(A.strip_role(F.col("kind")).alias("kind"), "value").agg(F.count("*").alias("cnt"))


CURLY = r"regexp_replace(annotation, '\[([a-z]+) : [^\]]*\]', '{\1}', 'g')"


def curly(t):
    """Templates whose slots are typed tokens such as {item}."""
    return t.view("annotated").select(
        "ex_id", "source", F.regexp_replace("annotation", r"\[([a-z]+) : [^\]]*\]", "{$1}").alias("template")
    )


@query(oracle(["annotated"], rf"SELECT ex_id, regexp_replace({CURLY}, '\{{[^}}]*\}}', '{{SLOT}}', 'g') AS template FROM annotated"))
def collapse_curly(t):
    return curly(t).select("ex_id", X.collapse_curly_slots(F.col("template")).alias("template"))


_KINDS = ["brand", "item", "nation", "segment", "size"]


def _keep_sql():
    text = CURLY
    for k in _KINDS:
        text = f"replace({text}, '{{{k}}}', CASE WHEN '{k}' IN (SELECT kind FROM top) THEN '{{{k}}}' ELSE '{{SLOT}}' END)"
    return f"SELECT ex_id, {text} AS template FROM annotated"


@query(oracle(["annotated"], _keep_sql(), SLOTS + """,
top AS (SELECT kind FROM (SELECT kind, count(*) AS n FROM slots GROUP BY kind) ORDER BY n DESC, kind LIMIT 2)"""))
def keep_topk_slots(t):
    """The two most frequent kinds keep their tokens; the others are masked."""
    kinds = V.slot_occurrences(examples(t)).groupBy("kind").agg(F.count("*").alias("n"))
    return V.mask_beyond(curly(t), "template", kinds, 2).select("ex_id", "template")


@query(oracle(["annotated"], f"""
SELECT ex_id, v AS view, CASE WHEN v < 2 THEN utterance ELSE {MASKED} END AS text
FROM annotated, (SELECT CAST(unnest(range(4)) AS INTEGER) AS v)"""))
def four_views(t):
    rows = t.view("annotated")
    views = X.four_views(F.col("utterance"), X.generic_mask(F.col("annotation")))
    return rows.select("ex_id", F.posexplode(views).alias("view", "text"))


@query(oracle(["annotated"], """
SELECT ex_id, utterance AS none, CASE WHEN source = 'order' THEN utterance ELSE replace(utterance, ',', ' ') END AS legacy,
  replace(utterance, ',', ' ') AS legacy_commas FROM annotated"""))
def text_policy(t):
    u, s = F.col("utterance"), F.col("source")
    return t.view("annotated").select(
        "ex_id", X.text_policy(u, s, "none").alias("none"), X.text_policy(u, s, "legacy", ("order",)).alias("legacy"),
        X.text_policy(u, s, "legacy-commas").alias("legacy_commas"),
    )


@query(f"SELECT doc_id, md5({key_sql('text')}) AS key_md5, length({key_sql('text')}) AS key_chars FROM documents")
def text_keys(t):
    key = X.text_key(F.col("text"))
    return t.table("documents").select(
        "doc_id", F.md5(key).alias("key_md5"), F.char_length(key).cast("bigint").alias("key_chars")
    )


@query(f"SELECT key_md5, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, md5({key_sql('text')}) AS key_md5 FROM documents) GROUP BY 1")
def text_key_groups(t):
    """Documents per comparison key; counting is combined before the shuffle."""
    return t.table("documents").groupBy(F.md5(X.text_key(F.col("text"))).alias("key_md5")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")
    )


@query("""SELECT doc_id, CAST(1 + length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines,
  length(replace(text, ',', ' ')) AS chars, trim(text) = '' AS blank FROM documents""")
def physical_lines(t):
    text = F.col("text")
    return t.table("documents").select(
        "doc_id", X.physical_lines(text).alias("lines"), F.char_length(X.commas_to_spaces(text)).cast("bigint").alias("chars"),
        X.is_blank(text).alias("blank"),
    )


@query(oracle(["annotated"], """
SELECT CAST(row_number() OVER (ORDER BY intent) - 1 AS BIGINT) AS label_idx, intent FROM (SELECT DISTINCT intent FROM annotated)"""))
def label_vocabulary(t):
    return S.label_vocabulary(t.view("annotated"))


@query(oracle(["annotated"], """
SELECT ex_id, coalesce(i, (SELECT i FROM labels_ WHERE intent = 'UNK')) AS label_idx
FROM annotated LEFT JOIN labels_ USING (intent)""", """
labels_ AS (SELECT intent, CAST(row_number() OVER (ORDER BY intent) - 1 AS BIGINT) AS i FROM (
  SELECT DISTINCT intent FROM annotated WHERE split = 'train' AND source = 'order' UNION ALL SELECT 'UNK'))"""))
def label_index_unk(t):
    """Labels known from one source; all rows are indexed, the other source falls back."""
    rows = t.view("annotated")
    known = rows.filter((F.col("split") == "train") & (F.col("source") == "order")).select("intent")
    labels = S.label_vocabulary(known.union(t.spark.range(1).select(F.lit("UNK").alias("intent"))))
    return S.label_index(rows, labels).select("ex_id", "label_idx")


TOKENS = """toks AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (
  SELECT doc_id, CASE WHEN k = '' THEN [] ELSE string_split(k, ' ') END AS w
  FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS k FROM documents))),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM (
  SELECT token, count(*) AS n FROM toks GROUP BY token ORDER BY n DESC, token LIMIT 1000))"""


@query("WITH " + TOKENS.replace("\\\\", "\\") + """
SELECT d.doc_id, array_to_string([2] || coalesce(ids, []) || [3] || list_transform(range(126 - coalesce(len(ids), 0)), lambda x: 0), ' ') AS input_ids,
  CAST(2 + coalesce(len(ids), 0) AS BIGINT) AS real_tokens
FROM documents d LEFT JOIN (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM toks LEFT JOIN vocab USING (token)
  WHERE pos < 126 GROUP BY doc_id) USING (doc_id)""")
def pad_truncate_ids(t):
    docs = t.table("documents")
    out = E.pad_truncate(docs, E.token_vocabulary(docs, 1000), 128, "doc_id")
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return out.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), ones.cast("bigint").alias("real_tokens"))


@query("""WITH w AS (SELECT conv_id, turn, CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ' ')) END AS n
  FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS k FROM conversations))
SELECT conv_id, turn, CAST(max(n) OVER (PARTITION BY conv_id) AS BIGINT) AS padded, CAST(n AS BIGINT) AS real_tokens FROM w""")
def pad_to_batch(t):
    """A conversation is a batch; turns are padded to its longest turn."""
    ids = F.transform(E.words(F.col("text")), lambda w: F.crc32(w))
    rows = t.table("conversations").select(F.col("conv_id").alias("batch"), "turn", ids.alias("input_ids"))
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return E.pad_to_batch(rows).select(
        F.col("batch").alias("conv_id"), "turn", F.size("input_ids").cast("bigint").alias("padded"), ones.cast("bigint").alias("real_tokens")
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    props = F.from_json("props", "map<string,bigint>")
    return t.table("events").select("event_id", F.try_element_at(props, F.lit("k")).alias("k"))
