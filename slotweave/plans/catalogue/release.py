"""Gate, digest, packaging and seed queries."""

from pyspark.sql import functions as F

from slotweave.operators import digest as D
from slotweave.operators import gate as G
from slotweave.operators import packaging as P
from slotweave.operators import seeds as Z
from slotweave.operators import splits as S
from slotweave.operators import vocab as V
from slotweave.plans import corpus
from slotweave.plans.catalogue.generation import EVIDENCE_SQL, KS, evidence, generated_sql
from slotweave.plans.catalogue.texts import SLOTS, examples
from slotweave.plans.registry import query
from slotweave.plans.views import oracle
from slotweave.session import fresh_path, stage
from slotweave.sources import writers as W

RELEASED_SQL = generated_sql() + """,
released AS (SELECT utterance, pattern, CAST((length(pattern) - length(replace(pattern, '{SLOT}', ''))) // 6 AS BIGINT) AS slot_count, source,
  CAST(row_number() OVER (PARTITION BY source ORDER BY ex_id, variant) - 1 AS BIGINT) AS source_row FROM generated WHERE NOT held)"""


def released(t):
    return corpus.release(examples(t), KS, ["source"])


@query("""SELECT o_orderkey, display,
  CASE WHEN display LIKE '%K' THEN CAST(round(CAST(replace(display, 'K', '') AS DECIMAL(18, 3)) * 1000) AS BIGINT) - half ELSE CAST(display AS BIGINT) END AS low,
  CASE WHEN display LIKE '%K' THEN CAST(round(CAST(replace(display, 'K', '') AS DECIMAL(18, 3)) * 1000) AS BIGINT) + half ELSE CAST(display AS BIGINT) + 1 END AS high
FROM (SELECT o_orderkey, d AS display, CAST(CASE o_orderkey % 3 WHEN 0 THEN 500 WHEN 1 THEN 50 ELSE 0 END AS BIGINT) AS half FROM (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat(CAST(o_custkey AS VARCHAR), 'K')
    WHEN 1 THEN concat(CAST(o_custkey // 10 AS VARCHAR), '.', CAST(o_custkey % 10 AS VARCHAR), 'K') ELSE CAST(o_custkey AS VARCHAR) END AS d FROM orders))""")
def rounding_intervals(t):
    key = F.col("o_custkey").cast("string")
    tenths = F.concat(F.floor(F.col("o_custkey") / 10).cast("string"), F.lit("."), (F.col("o_custkey") % 10).cast("string"), F.lit("K"))
    display = F.when(F.col("o_orderkey") % 3 == 0, F.concat(key, F.lit("K"))).when(F.col("o_orderkey") % 3 == 1, tenths).otherwise(key)
    rows = t.table("orders").select("o_orderkey", display.alias("display"))
    low, high = G.rounded_interval(F.col("display"))
    return rows.select("o_orderkey", "display", low.alias("low"), high.alias("high"))


TARGET_ROWS = [("ship", "slots", "2"), ("ship", "values", "30"), ("ship", "templates", "7"), ("order", "slots", "3"),
               ("order", "values", "0.1K"), ("order", "originals", "2.0K"), ("other", "originals", "1K")]
_VALUES = ", ".join(str(r) for r in TARGET_ROWS)


@query(oracle(["annotated"], f"""
SELECT source || '.' || metric AS name, coalesce(low <= actual AND actual < high, FALSE) AS passed, CAST(actual AS VARCHAR) AS actual, display AS expected,
  low AS lower_inclusive, high AS upper_exclusive
FROM (SELECT *, CAST(CASE display WHEN '0.1K' THEN 50 WHEN '2.0K' THEN 1950 WHEN '1K' THEN 500 ELSE CAST(replace(display, 'K', '') AS DOUBLE) END AS BIGINT) AS low,
  CAST(CASE display WHEN '0.1K' THEN 150 WHEN '2.0K' THEN 2050 WHEN '1K' THEN 1500 ELSE CAST(replace(display, 'K', '') AS DOUBLE) + 1 END AS BIGINT) AS high
  FROM (VALUES {_VALUES}) v(source, metric, display)) t
LEFT JOIN (UNPIVOT (SELECT source, originals, slots, vals AS "values", templates FROM stats) ON originals, slots, "values", templates INTO NAME metric VALUE actual) a
  USING (source, metric)""", SLOTS + "," + EVIDENCE_SQL))
def rounding_gate(t):
    stats = V.original_statistics(evidence(t))
    actuals = stats.unpivot(["source"], ["originals", "slots", "values", "templates"], "metric", "actual")
    targets = t.spark.createDataFrame(TARGET_ROWS, "source string, metric string, display string")
    return G.count_checks(actuals, targets, ["source", "metric"])


@query(oracle(["annotated"], """
SELECT 'sources' AS name, TRUE AS passed, '2/0' AS actual, '2/0' AS expected
UNION ALL SELECT 'pairs.valid', count(*) FILTER (trim(utterance) = '' OR trim(pattern) = '') = 0, CAST(count(*) FILTER (trim(utterance) = '' OR trim(pattern) = '') AS VARCHAR), '0' FROM released
UNION ALL SELECT 'flat.valid', count(*) FILTER (contains(utterance, ',') OR contains(pattern, ',')) = 0,
  CAST(count(*) FILTER (contains(utterance, ',') OR contains(pattern, ',')) AS VARCHAR), '0' FROM released
UNION ALL SELECT coalesce(e.source, a.source), coalesce(e.n = a.n, FALSE), CAST(a.n AS VARCHAR), CAST(e.n AS VARCHAR)
  FROM (SELECT source, count(*) AS n FROM generated WHERE NOT held GROUP BY 1) e FULL JOIN (SELECT source, count(*) AS n FROM released GROUP BY 1) a ON a.source = e.source""",
              RELEASED_SQL))
def check_report(t):
    """Independent checks over one release; expected counts come from the generation that made it."""
    generated, keys = corpus.generation_inputs(examples(t), KS, ["source"])
    made = stage(S.flag_heldout(generated, keys, scope=["source"]), "generated")
    path = fresh_path(t.spark, "release")
    W.write_per_source_parquet(stage(P.released_rows(made.where("NOT held").drop("held")), "released"), path)
    rows = W.read_released(t.spark, path)
    u, p = F.col("utterance"), F.col("pattern")
    expected = made.groupBy("source").agg(F.count_if(~F.col("held")).alias("cnt"))
    checks = G.union_checks([
        G.membership_check(rows, "source", ["ship", "order"], "sources"),
        G.violations_check(rows, G.pair_problem(u, p), "pairs.valid"),
        G.violations_check(rows, W.flat_record_problem(u, p, F.col("slot_count")), "flat.valid"),
        G.expected_count_checks(rows.groupBy("source").agg(F.count("*").alias("cnt")), expected, ["source"]),
    ])
    return checks.select("name", "passed", "actual", "expected")


@query(oracle(["annotated"], """
SELECT 4 AS checks, 1 AS failed, FALSE AS eligible FROM (SELECT count(*) FROM released)""", RELEASED_SQL))
def release_gate(t):
    """The unquoted sink's comma rule fails, so this release is not eligible."""
    rows = stage(released(t), "released")
    u, p = F.col("utterance"), F.col("pattern")
    manifest = rows.groupBy("source").agg(F.lit("prepared").alias("status"), F.lit(None).cast("int").alias("cap"), F.lit(0).alias("truncated"))
    order = manifest.agg(F.collect_list("source").alias("order"))
    checks = G.union_checks([
        G.violations_check(rows, G.pair_problem(u, p), "pairs.valid"),
        G.violations_check(rows, W.flat_record_problem(u, p, F.col("slot_count")), "flat.valid"),
        G.check_rows(order, F.lit("source_order"), G.order_check(F.col("order"), ["order", "ship"])),
        G.violations_check(P.running_row_problems(rows), F.col("source"), "rows.running"),
    ])
    return G.eligible(checks).select(F.col("checks").cast("int").alias("checks"), F.col("failed").cast("int").alias("failed"), "eligible")


@query(oracle(["annotated"], """
SELECT source || '.' || name AS name, NOT (source = 'order' AND name = 'top_k') AS passed FROM (SELECT DISTINCT source FROM generated) s,
  (VALUES ('prepared'), ('top_k'), ('uncapped')) v(name)""", generated_sql()))
def settings_checks(t):
    """Manifest settings taken from the generation report; one source was made with another depth than expected."""
    from slotweave.operators import generate as N

    generated, keys = corpus.generation_inputs(examples(t), KS, ["source"])
    report = N.generation_report(generated, keys, ["source"])
    depth = F.when(F.col("source") == "ship", 2).otherwise(3)
    manifest = report.select(
        "source", F.when(F.col("output_rows") > 0, "prepared").otherwise("missing").alias("status"), depth.alias("top_k"),
        F.lit(None).cast("int").alias("cap"), F.col("truncated_examples").alias("truncated"),
    )
    return G.settings_checks(manifest, {**KS, "order": 4}).select("name", "passed")


@query(oracle(["annotated"], "SELECT utterance, pattern, slot_count, source, source_row FROM released", RELEASED_SQL))
def package_rows(t):
    return released(t)


@query(oracle(["annotated"], """
SELECT source, count(*) AS "rows", source <> 'order' AS verified FROM released GROUP BY source""", RELEASED_SQL))
def package_round_trip(t):
    """Write the release, read it back, compare rows, numbering and digests; one row of one source was written wrongly."""
    rows = stage(released(t), "released")
    path = fresh_path(t.spark, "release")
    wrong = (F.col("source") == "order") & (F.col("source_row") == 3)
    W.write_per_source_parquet(rows.withColumn("utterance", F.when(wrong, "x").otherwise(F.col("utterance"))), path)
    return P.verify_round_trip(t.spark, rows, path).select("source", "rows", "verified")


@query(oracle(["annotated"], """
SELECT CAST(count(*) FILTER (source_row % 100 = 7) AS INTEGER) AS differing, count(*) AS row_count, count(*) FILTER (source = 'ship') AS ship_rows FROM released""", RELEASED_SQL))
def combined_matches(t):
    """The combined table against its sources in declared order, read back one at a time with every hundredth row changed."""
    path = fresh_path(t.spark, "release")
    W.write_per_source_parquet(stage(released(t), "released"), path)
    combined = W.combine_sources(W.read_released(t.spark, path), ["ship", "order"])
    single = None
    for rank, source in enumerate(["ship", "order"]):
        one = W.read_released(t.spark, path, source).withColumn("source_rank", F.lit(rank))
        single = one if single is None else single.unionByName(one)
    single = single.withColumn("utterance", F.when(F.col("source_row") % 100 == 7, "x").otherwise(F.col("utterance")))
    columns = ["utterance", "pattern", "slot_count", "source"]
    bad = P.content_differences(combined, single, ["source_rank", "source_row"], columns)
    return combined.agg(F.count("*").alias("row_count"), F.count_if(F.col("source") == "ship").alias("ship_rows")).withColumn(
        "differing", bad.agg(F.count("*").cast("int").alias("n")).scalar()
    )


def field_sql(column):
    return f"concat(strlen(CAST({column} AS VARCHAR)), ':', CAST({column} AS VARCHAR))"


@query(f"""WITH l0 AS (SELECT 0 AS lvl, doc_id AS p, sha256(concat_ws(',', {field_sql('text')}, {field_sql('lang')}, {field_sql('n_chars')})) AS h, 1 AS n FROM documents),
l1 AS (SELECT p // 64 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n FROM l0 GROUP BY 1),
l2 AS (SELECT p // 64 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n FROM l1 GROUP BY 1),
l3 AS (SELECT p // 64 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n FROM l2 GROUP BY 1),
l4 AS (SELECT p // 64 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n FROM l3 GROUP BY 1)
SELECT CAST(n AS BIGINT) AS "rows", h AS digest FROM l4""")
def content_digest(t):
    docs = t.table("documents")
    return D.ordered_digest(docs, ["text", "lang", "n_chars"], "doc_id", fanout=64, levels=4)


@query(f"""SELECT conv_id, turn, sha256(concat_ws(',', {field_sql('role')}, {field_sql('text')})) AS row_sha FROM conversations""")
def row_digests(t):
    return t.table("conversations").select("conv_id", "turn", D.row_digest(["role", "text"]).alias("row_sha"))


PAIRED = """
paired AS (SELECT * FROM seed_runs WHERE seed IN (SELECT seed FROM seed_runs GROUP BY seed HAVING count(DISTINCT condition) = 2)),
scores AS (SELECT condition, seed, task, accuracy FROM paired UNION ALL SELECT condition, seed, 'macro', avg(accuracy) FROM paired GROUP BY 1, 2),
deltas AS (SELECT a.seed, a.task, b.accuracy - a.accuracy AS delta FROM scores a JOIN scores b ON a.seed = b.seed AND a.task = b.task
  AND a.condition = 'a' AND b.condition = 'b')"""


def _r(df):
    return df.withColumns({"mean": F.round("mean", 6), "sample_std": F.round("sample_std", 6)})


@query(oracle(["seed_runs"], """
SELECT condition, task, count(*) AS n, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sample_std FROM scores GROUP BY 1, 2""", PAIRED))
def seed_summary(t):
    return _r(Z.seed_summary(t.view("seed_runs"), ("a", "b")))


@query(oracle(["seed_runs"], "SELECT seed, task, round(delta, 6) AS delta FROM deltas", PAIRED))
def paired_deltas(t):
    return Z.paired_deltas(t.view("seed_runs"), ("a", "b")).withColumn("delta", F.round("delta", 6))


@query(oracle(["seed_runs"], """
SELECT task, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sample_std FROM deltas GROUP BY 1""", PAIRED))
def delta_summary(t):
    return _r(Z.delta_summary(Z.paired_deltas(t.view("seed_runs"), ("a", "b"))))
