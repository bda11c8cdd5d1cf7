"""Held-out, contamination and split queries."""

from pyspark.sql import functions as F

from slotweave.functions import text as X
from slotweave.operators import splits as S
from slotweave.plans.registry import query
from slotweave.plans.views import key_sql, oracle
from slotweave.sources.ordinals import by_ord, number_rows

K_U = key_sql("utterance")


@query(oracle(["annotated"], """
SELECT a.ex_id, CASE WHEN v.utterance IS NOT NULL THEN 'valid' WHEN t.utterance IS NOT NULL THEN 'test' ELSE 'train' END AS routed
FROM annotated a LEFT JOIN (SELECT DISTINCT utterance FROM annotated WHERE split = 'valid') v USING (utterance)
LEFT JOIN (SELECT DISTINCT utterance FROM annotated WHERE split = 'test') t USING (utterance)"""))
def heldout_exact_route(t):
    rows = t.view("annotated")
    routed = S.route_by_membership(
        rows.drop("split"), rows.filter(F.col("split") == "valid"), rows.filter(F.col("split") == "test")
    )
    return routed.select("ex_id", F.col("split").alias("routed"))


@query(oracle(["annotated"], """
SELECT 'train' AS part, ex_id FROM annotated WHERE utterance NOT IN (SELECT utterance FROM annotated WHERE split IN ('valid', 'test'))
UNION ALL SELECT 'valid', ex_id FROM annotated WHERE utterance IN (SELECT utterance FROM annotated WHERE split = 'valid')
UNION ALL SELECT 'test', ex_id FROM annotated WHERE utterance IN (SELECT utterance FROM annotated WHERE split = 'test')"""))
def heldout_exact_partitions(t):
    rows = t.view("annotated")
    valid, test = rows.filter(F.col("split") == "valid"), rows.filter(F.col("split") == "test")
    out = None
    for part in ("train", "valid", "test"):
        one = S.exact_partition(rows, valid, test, part).select(F.lit(part).alias("part"), "ex_id")
        out = one if out is None else out.unionByName(one)
    return out


def _heldout(scope):
    on = "AND h.source = a.source" if scope else ""
    return f"""
SELECT ex_id, source FROM annotated a WHERE split = 'train' AND NOT EXISTS (
  SELECT 1 FROM annotated h WHERE h.split <> 'train' AND {key_sql('h.utterance')} = {key_sql('a.utterance')} {on})"""


@query(oracle(["annotated"], _heldout(True)))
def heldout_clean_source(t):
    rows = t.view("annotated")
    keys = S.heldout_keys(rows.filter(F.col("split") != "train"), scope=["source"])
    return S.decontaminate(rows.filter(F.col("split") == "train"), keys, scope=["source"]).select("ex_id", "source")


@query(oracle(["annotated"], _heldout(False)))
def heldout_clean_pooled(t):
    rows = t.view("annotated")
    keys = S.heldout_keys(rows.filter(F.col("split") != "train"))
    return S.decontaminate(rows.filter(F.col("split") == "train"), keys).select("ex_id", "source")


@query(oracle(["annotated"], f"""
SELECT source, count(*) AS train_rows, count(*) FILTER (k IN (SELECT k FROM held)) AS removed_rows,
  (SELECT count(DISTINCT k) FROM held) AS held_keys
FROM (SELECT source, {K_U} AS k FROM annotated WHERE split = 'train') GROUP BY source""",
              f"held AS (SELECT {K_U} AS k FROM annotated WHERE split <> 'train')"))
def heldout_removed_counts(t):
    rows = t.view("annotated")
    keys = S.heldout_keys(rows.filter(F.col("split") != "train"))
    flagged = S.flag_heldout(rows.filter(F.col("split") == "train"), keys)
    return flagged.groupBy("source").agg(
        F.count("*").alias("train_rows"), F.count_if("held").alias("removed_rows")
    ).withColumn("held_keys", keys.agg(F.count("*").alias("n")).scalar())


CASCADE = f"""
keyed AS (SELECT *, {K_U} AS k FROM doc_rows),
flagged AS (SELECT id, task, split, CASE split WHEN 'train' THEN FALSE
  WHEN 'valid' THEN (task, k) IN (SELECT (task, k) FROM keyed WHERE split = 'train')
  ELSE (task, k) IN (SELECT (task, k) FROM keyed WHERE split IN ('train', 'valid')) END AS excluded FROM keyed)"""


@query(oracle(["doc_rows"], "SELECT id, excluded FROM flagged", CASCADE))
def cascade_clean(t):
    return S.cascade(t.view("doc_rows"), ["task"]).select("id", "excluded")


@query(oracle(["doc_rows"], """
SELECT task, split, count(*) AS row_count, count(*) FILTER (excluded) AS excluded FROM flagged GROUP BY 1, 2""", CASCADE))
def cascade_counts(t):
    return S.cascade_counts(t.view("doc_rows"), ["task"])


def _lines(df, key, text="text"):
    """Non-blank lines of multi-line texts."""
    lines = df.select(*key, F.explode(F.split(text, "\n")).alias("utterance"))
    return lines.filter(~X.is_blank(F.col("utterance")))


@query(f"""
WITH bl AS (SELECT DISTINCT {K_U} AS k FROM (SELECT unnest(string_split(text, chr(10))) AS utterance FROM benchmark) WHERE trim(utterance) <> ''),
dl AS (SELECT doc_id, {K_U} AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS utterance FROM documents) WHERE trim(utterance) <> '')
SELECT doc_id, count(k) AS line_count, count(*) FILTER (k IN (SELECT k FROM bl)) AS contaminated FROM documents LEFT JOIN dl USING (doc_id) GROUP BY doc_id""")
def contaminated_lines(t):
    """Document lines that equal a benchmark line up to case and spacing; blank ones are no lines, but keep their document."""
    keys = S.heldout_keys(_lines(t.table("benchmark"), []))
    lines = t.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("utterance"))
    flagged = S.flag_heldout(lines, keys).withColumn("filled", ~X.is_blank(F.col("utterance")))
    return flagged.groupBy("doc_id").agg(
        F.count_if("filled").alias("line_count"), F.count_if(F.col("held") & F.col("filled")).alias("contaminated"))


@query(oracle(["doc_rows"], f"""
SELECT id, split, split <> 'train' AND {K_U} IN (SELECT {key_sql('utterance')} FROM doc_rows WHERE split = 'train') AS excluded FROM doc_rows"""))
def contamination_exclude(t):
    rows = t.view("doc_rows")
    training = rows.filter(F.col("split") == "train")
    return S.flag_training_overlap(rows, training).select("id", "split", "excluded")


@query("""
WITH a AS (SELECT text, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY text),
b AS (SELECT text, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY text)
SELECT md5(coalesce(a.text, b.text)) AS text_md5, coalesce(a.n, 0) AS left_count, coalesce(b.n, 0) AS right_count
FROM a FULL JOIN b ON a.text = b.text WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_difference(t):
    docs = t.table("documents")
    diff = S.bag_difference(docs.filter(F.col("lang") == "en"), docs.filter(F.col("lang") != "en"), ["text"])
    return diff.select(F.md5("text").alias("text_md5"), "left_count", "right_count")


@query(oracle(["log_lines"], """
SELECT (SELECT count(*) FROM annotated) AS log_rows,
  (SELECT CAST(count(*) AS INTEGER) FROM (SELECT utterance, count(*) AS n FROM annotated GROUP BY 1) a
    FULL JOIN (SELECT utterance, count(*) AS n FROM corpus GROUP BY 1) b ON a.utterance = b.utterance
    WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)) AS differences,
  (SELECT CAST(count(*) AS INTEGER) FROM annotated WHERE utterance NOT IN (SELECT utterance FROM corpus)) AS not_allowed""",
    "corpus AS (SELECT CASE WHEN ex_id % 9 = 0 THEN utterance || '!' ELSE utterance END AS utterance FROM annotated)"))
def log_matches_corpus(t):
    """The paired log against a corpus in which every ninth text is another: bag differences, and texts that are not allowed."""
    from slotweave.sources.readers import pair_log_lines

    corpus = t.view("annotated").select(F.when(F.col("ex_id") % 9 == 0, F.concat("utterance", F.lit("!"))).otherwise(F.col("utterance")).alias("utterance"))
    paired = pair_log_lines(t.view("log_lines")).select("utterance")
    return paired.agg(F.count("*").alias("log_rows")).select(
        "log_rows",
        S.bag_difference(paired, corpus, ["utterance"]).agg(F.count("*").cast("int").alias("n")).scalar().alias("differences"),
        S.not_contained(paired, corpus, ["utterance"]).agg(F.count("*").cast("int").alias("n")).scalar().alias("not_allowed"),
    )


def audit_sql(view, key):
    return f"""
SELECT {key}
  count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'valid') AS valid_rows, count(*) FILTER (split = 'test') AS test_rows,
  count(*) FILTER (split = 'train') - count(DISTINCT k) FILTER (split = 'train') AS train_duplicates,
  count(*) FILTER (split = 'valid') - count(DISTINCT k) FILTER (split = 'valid') AS valid_duplicates,
  count(*) FILTER (split = 'test') - count(DISTINCT k) FILTER (split = 'test') AS test_duplicates,
  count(*) FILTER (split = 'test' AND in_train) AS train_test_overlap, count(*) FILTER (split = 'valid' AND in_train) AS train_valid_overlap,
  count(DISTINCT intent) FILTER (split = 'train') AS train_intents, count(DISTINCT intent) FILTER (split = 'valid') AS valid_intents,
  count(DISTINCT intent) FILTER (split = 'test') AS test_intents,
  count(DISTINCT intent) FILTER (split = 'test' AND NOT known) AS absent_intents
FROM (SELECT *, bool_or(split = 'train') OVER (PARTITION BY {key} k) AS in_train, bool_or(split = 'train') OVER (PARTITION BY {key} intent) AS known
  FROM (SELECT *, {K_U} AS k FROM {view}))"""


@query(oracle(["doc_rows"], audit_sql("doc_rows", "task,") + " GROUP BY task"))
def split_audit(t):
    return S.split_audit(t.view("doc_rows"), ["task"])


@query(oracle(["turns"], audit_sql("turns", "")))
def split_audit_turns(t):
    return S.split_audit(t.view("turns"))


@query(oracle(["doc_rows"], """
SELECT DISTINCT task, intent FROM doc_rows d WHERE split = 'test'
  AND NOT EXISTS (SELECT 1 FROM doc_rows r WHERE r.split = 'train' AND r.task = d.task AND r.intent = d.intent)"""))
def absent_intents(t):
    return S.absent_intents(t.view("doc_rows"), ["task"])


@query(oracle(["doc_rows"], """
SELECT task, split, id, idx FROM (SELECT *, row_number() OVER (PARTITION BY task, split ORDER BY md5('42/' || id), id) AS r FROM doc_rows) WHERE r <= 20"""))
def seeded_sample(t):
    """Sampling is the feature: at most 20 rows per task and split, reproducible by seed."""
    return S.seeded_sample(t.view("doc_rows"), 20, 42, "id", ["task", "split"]).select("task", "split", "id", "idx")


@query(oracle(["turns"], "SELECT id, idx, intent FROM turns ORDER BY idx LIMIT 50"))
def first_rows(t):
    """The first-n option of the pair reader."""
    return t.view("turns").orderBy("idx").limit(50).select("id", "idx", "intent")


@query(oracle(["annotated", "doc_rows", "turns"], f"""
SELECT count(*) AS union_keys, count(*) FILTER (n = 3) AS in_all, count(*) FILTER (n = 1) AS in_one FROM (
  SELECT k, count(DISTINCT src) AS n FROM (
    SELECT 1 AS src, {K_U} AS k FROM annotated UNION ALL SELECT 2, {K_U} FROM doc_rows UNION ALL SELECT 3, {K_U} FROM turns) GROUP BY k)"""))
def key_union(t):
    """Distinct comparison keys over three corpora."""
    parts = None
    for i, name in enumerate(("annotated", "doc_rows", "turns")):
        one = S.heldout_keys(t.view(name)).withColumn("src", F.lit(i))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("key").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("union_keys"), F.count_if(F.col("n") == 3).alias("in_all"), F.count_if(F.col("n") == 1).alias("in_one")
    )


@query(oracle(["doc_rows"], """
SELECT concat_ws('/', task, split, CAST(row_number() OVER (PARTITION BY task, split ORDER BY idx) - 1 AS VARCHAR)) AS row_id, id,
  trim(utterance) <> '' AND trim(intent) <> '' AS usable FROM doc_rows"""))
def benchmark_row_ids(t):
    """task/split/index ids; a split with most of the rows is numbered over many buckets."""
    numbered = number_rows(t.view("doc_rows"), ["idx"], by_ord("idx", 1024), ["task", "split"], out="i")
    usable = ~X.is_blank(F.col("utterance")) & ~X.is_blank(F.col("intent"))
    return numbered.select(X.row_id(F.col("task"), F.col("split"), F.col("i")).alias("row_id"), "id", usable.alias("usable"))
