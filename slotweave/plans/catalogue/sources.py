"""Format queries: the tables are written in each input format and read back through its reader.

Files go to the session's shared folder under a fresh name. Whole-document formats are cut into
documents of bounded size, one file each.
"""

from pyspark.sql import functions as F

from slotweave.functions import annotation as A
from slotweave.functions import text as X
from slotweave.functions import vectors as VX
from slotweave.operators import digest as D
from slotweave.operators import gate as G
from slotweave.operators import seeds as Z
from slotweave.operators import tagger
from slotweave.operators import vocab as V
from slotweave.plans.catalogue.texts import ANN, MASKED, SLOTS, examples
from slotweave.plans.registry import query
from slotweave.plans.views import oracle
from slotweave.session import fresh_path
from slotweave.sources import readers as R
from slotweave.sources import writers as W

DOC_ROWS = 2000


def _documents(df, path):
    """One file per row of the single string column."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)
    return path


def _bucketed(df, keys, value, order):
    """Arrays of at most DOC_ROWS values per key and id range."""
    bucket = F.floor(F.col(order) / DOC_ROWS).cast("bigint")
    return df.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda s: s["v"]).alias("rows")
    )


def _keyed_documents(df, key, value, order):
    """One object per id range, an array for each key in it: as many documents as ranges, however many keys there are.

    A null key cannot be written and stops the job.
    """
    arrays = _bucketed(df, [key], value, order).groupBy("_bucket").agg(F.collect_list(F.struct(key, "rows")).alias("arrays"))
    return arrays.select(F.to_json(F.map_from_entries("arrays")))


@query(oracle(["annotated"], """
SELECT CAST(ex_id AS VARCHAR) AS id, split, utterance, annotation, intent, source AS scenario FROM annotated"""))
def scan_annotated_jsonl(t):
    path = fresh_path(t.spark, "jsonl")
    rows = t.view("annotated")
    partition = F.when(F.col("split") == "valid", "dev").otherwise(F.col("split"))
    rows.select(
        F.col("ex_id").cast("string").alias("id"), partition.alias("partition"), F.col("utterance").alias("utt"),
        F.col("annotation").alias("annot_utt"), "intent", F.col("source").alias("scenario"),
    ).write.json(path)
    return R.read_annotated_jsonl(t.spark, path).drop("ord")


@query(oracle(["annotated"], rf"""
SELECT intent, regexp_replace(annotation, {ANN}, '\2', 'g') AS utterance, annotation, 'utf-8' AS encoding FROM annotated"""))
def scan_part_json(t):
    path = fresh_path(t.spark, "nested")
    data = F.transform("parts", lambda p: F.struct(p["value"].alias("text"), p["kind"].alias("entity")))
    _documents(_keyed_documents(examples(t), "intent", F.struct(data.alias("data")), "ex_id"), path)
    return R.read_part_json(t.spark, path).select(
        "intent", "utterance", A.parts_to_annotation(F.col("parts")).alias("annotation"), "encoding"
    )


@query("SELECT doc_id, 'latin-1' AS encoding, md5(text) AS text_md5 FROM documents WHERE length(text) < strlen(text) UNION ALL SELECT doc_id, 'utf-8', md5(text) FROM documents WHERE length(text) = strlen(text)")
def decode_fallback(t):
    """Documents as Latin-1 bytes: the non-ASCII ones are not valid UTF-8 and fall back."""
    content = F.encode(F.col("text"), "ISO-8859-1")
    return t.table("documents").select(
        "doc_id", R.decoded_as(content).alias("encoding"), F.md5(R.decode_bytes(content)).alias("text_md5")
    )


@query(oracle(["spans"], """
SELECT utterance, intent, pattern, repaired FROM (
  SELECT ex_id, text AS utterance, 'order' AS intent, FALSE AS repaired,
    string_agg(substr(text, prev + 1, start - prev) || '{SLOT}', '' ORDER BY start) || substr(text, max(stop) + 1) AS pattern
  FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY ex_id ORDER BY start), 0) AS prev FROM (
    SELECT ex_id, text, ent_ord, start - shift AS start, stop - shift AS stop
    FROM (SELECT *, start - (strpos(text, value) - 1) AS shift FROM spans))) GROUP BY ex_id, text)
UNION ALL SELECT value, 'value', '{SLOT}', start - (strpos(text, value) - 1) <> 0 FROM spans"""))
def scan_span_json(t):
    """Every text with both entities, and every value as a text of its own (shifted ones are repaired)."""
    path = fresh_path(t.spark, "spans")
    spans = t.view("spans").withColumn("base", F.instr("text", F.col("value")) - 1)
    size = F.char_length("value")
    both = spans.groupBy("ex_id", "text").agg(
        F.collect_list(F.struct(F.col("base").cast("bigint").alias("start"), (F.col("base") + size).cast("bigint").alias("end"),
                                F.col("kind").alias("entity"), "value")).alias("entities")
    ).select("ex_id", "text", F.lit("order").alias("intent"), "entities")
    single = spans.select(
        "ex_id", F.col("value").alias("text"), F.lit("value").alias("intent"),
        F.array(F.struct((F.col("start") - F.col("base")).alias("start"), (F.col("stop") - F.col("base")).alias("end"),
                         F.col("kind").alias("entity"), "value")).alias("entities"),
    )
    rows = _bucketed(both.unionByName(single), ["intent"], F.struct("text", "intent", "entities"), "ex_id")
    _documents(rows.select(F.to_json(F.struct(F.struct(F.col("rows").alias("common_examples")).alias("rasa_nlu_data")))), path)
    out = R.spans_to_examples(R.read_span_json(t.spark, path))
    return out.select("utterance", "intent", A.parts_to_pattern(F.col("parts")).alias("pattern"), "repaired")


@query("""SELECT text AS utterance, '[text : ' || text || ']' AS annotation, role AS scenario, CAST(conv_id AS VARCHAR) AS intent
FROM conversations WHERE length(text) > 0""")
def scan_semicolon_csv(t):
    """Conversation turns with their line breaks; answers that are empty are dropped by the reader."""
    path = fresh_path(t.spark, "semicolon")
    rows = t.table("conversations")
    values = {"scenario": F.col("role"), "intent": F.col("conv_id").cast("string"),
              "answer_annotation": F.concat(F.lit("[text : "), "text", F.lit("]")), "answer_normalised": F.col("text")}
    W.write_csv(rows.select(*[values.get(c, F.lit("x;y")).alias(c) for c in R.SEMICOLON_COLUMNS]), path, sep=";")
    return R.read_semicolon_csv(t.spark, path).drop("ord")


@query(oracle(["annotated"], """
SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS split, trim(utterance) AS utterance, source || '_' || intent AS intent FROM annotated"""))
def scan_fold_csv(t):
    path = fresh_path(t.spark, "folds")
    rows = t.view("annotated").select(
        F.col("source").alias("scenario"), "intent", F.trim("utterance").alias("answer_from_anno"), "split"
    )
    W.write_csv(rows.filter(F.col("split") == "train").drop("split"), f"{path}/trainset", sep=";")
    W.write_csv(rows.filter(F.col("split") != "train").drop("split"), f"{path}/testset", sep=";")
    return R.read_fold_csv(t.spark, [f"{path}/trainset", f"{path}/testset"]).drop("ord")


@query("""SELECT text AS utterance, role AS intent, CASE WHEN trim(text) = '' THEN 'empty utterance or intent' END AS problem FROM (
  SELECT CASE WHEN turn % 7 = 3 THEN ' ' ELSE text END AS text, role FROM conversations)""")
def scan_intent_csv(t):
    """Every seventh turn is blanked; the reader says so in its row."""
    path = fresh_path(t.spark, "intents")
    text = F.when(F.col("turn") % 7 == 3, " ").otherwise(F.col("text"))
    W.write_csv(t.table("conversations").select(text.alias("text"), F.col("role").alias("category")), path)
    return R.read_intent_csv(t.spark, path, strict=False).drop("ord")


@query(oracle(["annotated"], f"SELECT utterance, {MASKED} AS pattern FROM annotated"))
def scan_pair_json(t):
    """JSON lines whose keys are not in alphabetical order; the file's order says which is the utterance."""
    path = fresh_path(t.spark, "pairs") + ".json"
    rows = t.view("annotated").select("utterance", X.generic_mask(F.col("annotation")).alias("pattern"))
    rows.write.json(path)
    return R.read_pairs(t.spark, path).drop("ord")


@query(oracle(["annotated"], f"SELECT trim(utterance) AS utterance, {MASKED} AS pattern FROM annotated"))
def scan_pair_csv(t):
    path = fresh_path(t.spark, "pairs")
    rows = t.view("annotated")
    W.write_csv(rows.select(F.col("utterance").alias("utt"), X.generic_mask(F.col("annotation")).alias("ptn")), path)
    return R.read_pair_csv(t.spark, path).drop("ord")


@query(oracle(["annotated"], f"SELECT utterance, {MASKED} AS pattern FROM annotated"))
def scan_pairs_by_extension(t):
    """A tab-separated training file chosen by its name."""
    path = fresh_path(t.spark, "pairs") + "_tsv.csv"
    rows = t.view("annotated")
    W.write_csv(rows.select("utterance", X.generic_mask(F.col("annotation")).alias("pattern")), path, sep="\t")
    return R.read_pairs(t.spark, path).drop("ord")


@query(oracle(["doc_rows"], """
SELECT split, task = 'web' AS is_oos, md5(utterance) AS utterance_md5, intent FROM doc_rows"""))
def scan_split_json(t):
    path = fresh_path(t.spark, "splits")
    rows = t.view("doc_rows").withColumn(
        "name", F.concat(F.when(F.col("task") == "web", "oos_").otherwise(""), F.when(F.col("split") == "valid", "val").otherwise(F.col("split")))
    )
    _documents(_keyed_documents(rows, "name", F.array("utterance", "intent"), "idx"), path)
    return R.read_split_json(t.spark, path).select("split", "is_oos", F.md5("utterance").alias("utterance_md5"), "intent")


@query(oracle(["annotated"], "SELECT utterance, annotation FROM annotated"))
def scan_annotation_log(t):
    path = fresh_path(t.spark, "log")
    t.view("log_lines").repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.text(path)
    return R.read_annotation_log(t.spark, path).drop("pair")


@query(oracle(["log_lines"], "SELECT utterance, annotation FROM annotated"))
def log_pairing(t):
    return R.pair_log_lines(t.view("log_lines")).drop("pair")


@query(oracle(["annotated"], f"""
SELECT CAST(row_number() OVER (ORDER BY ex_id) - 1 AS BIGINT) AS ord, utterance, {MASKED} AS pattern, intent FROM annotated"""))
def scan_parallel_files(t):
    path = fresh_path(t.spark, "parallel")
    rows = t.view("annotated").withColumn("pattern", X.generic_mask(F.col("annotation")))
    W.write_parallel_files(rows.select(F.col("ex_id").alias("ord"), "utterance", "pattern", "intent"), path)
    return R.read_parallel_files(t.spark, path)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT CAST(row_number() OVER (ORDER BY doc_id, pos) - 1 AS BIGINT) AS ord, rtrim(line) AS text FROM l""")
def scan_lines(t):
    path = fresh_path(t.spark, "lines")
    lines = t.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines.repartitionByRange("doc_id", "pos").sortWithinPartitions("doc_id", "pos").select("line").write.text(path)
    return R.read_lines(t.spark, path)


@query(oracle(["annotated"], """
SELECT CAST(row_number() OVER (ORDER BY n DESC, kind) - 1 AS BIGINT) AS rank, '{' || kind || '}' AS slot
FROM (SELECT kind, count(*) AS n FROM slots GROUP BY kind)""", SLOTS))
def scan_slot_list(t):
    path = fresh_path(t.spark, "slots")
    kinds = V.slot_occurrences(examples(t)).groupBy("kind").agg(F.count("*").alias("n"))
    kinds.orderBy(F.col("n").desc(), "kind").select(F.concat(F.lit("{"), "kind", F.lit("}")).alias("slot")).coalesce(1).write.parquet(path)
    return R.read_slot_list(t.spark, path)


@query(oracle(["annotated"], f"""
SELECT utterance, pattern AS template, n AS slot_rows, n > 0 AND source <> 'ship' AS valid FROM (
  SELECT source, utterance, {MASKED} AS pattern, CAST((length({MASKED}) - length(replace({MASKED}, '{{SLOT}}', ''))) / 6 AS BIGINT) AS n FROM annotated)"""))
def scan_evidence(t):
    """One source writes blank slot types on purpose; validation flags exactly those rows."""
    path = fresh_path(t.spark, "evidence")
    slots = F.transform(
        F.filter("parts", lambda p: p["kind"].isNotNull()),
        lambda p: F.struct(F.when(F.col("source") == "ship", " ").otherwise(p["kind"]).alias("type"), p["value"].alias("value")),
    )
    examples(t).select("utterance", A.parts_to_pattern(F.col("parts")).alias("template"), slots.alias("slots")).write.json(path)
    return R.read_evidence_jsonl(t.spark, path).select(
        "utterance", "template", F.size("slots").cast("bigint").alias("slot_rows"), "valid"
    )


@query(oracle(["seed_runs"], """
SELECT g.condition, g.seed, r.accuracy IS NOT NULL AS available, r.task, round(r.accuracy, 6) AS accuracy
FROM (SELECT * FROM (VALUES ('a'), ('b')) c(condition), (VALUES (42), (43), (44)) s(seed)) g
LEFT JOIN seed_runs r ON r.condition = g.condition AND r.seed = g.seed"""))
def scan_run_results(t):
    """One result file per (condition, seed); the missing cell stays in the grid as unavailable."""
    path = fresh_path(t.spark, "runs")
    digest = F.sha2(F.lit("benchmark"), 256)
    runs = t.view("seed_runs").groupBy("condition", "seed").agg(
        F.map_from_entries(F.collect_list(F.struct("task", F.struct("accuracy")))).alias("test_diagnostics")
    )
    body = F.to_json(F.struct(
        digest.alias("benchmark_sha256"), F.lit(True).alias("source_unchanged"),
        F.struct(F.lit(True).alias("source_unchanged"), F.lit(0.0).alias("reload_max_abs_diff")).alias("export_audit"), "test_diagnostics",
    ))
    runs.select("condition", "seed", body.alias("body")).write.partitionBy("condition", "seed").text(path)
    cells = [(c, s, f"condition={c}/seed={s}") for c in "ab" for s in (42, 43, 44)]
    grid = t.spark.createDataFrame(cells, "condition string, seed int, file string")
    results = R.read_run_results(t.spark, grid, f"{path}/*/*/*.txt", "(condition=[^/]+/seed=[^/]+)/")
    scores = Z.run_scores(results)
    problems = Z.run_problems(results, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    clean = results.join(problems, ["condition", "seed"], "left_anti")
    return clean.select("condition", "seed", "available").join(scores, ["condition", "seed"], "left").select(
        "condition", "seed", "available", "task", F.round("accuracy", 6).alias("accuracy")
    )


def _tagged(column, label, pattern):
    marked = rf"regexp_replace({column}, '(\[[^\[\]]*\])|({pattern})', '\1' || chr(1) || '{label} : \2' || chr(2), 'g')"
    return f"translate(replace({marked}, chr(1) || '{label} : ' || chr(2), ''), chr(1) || chr(2), '[]')"


EMAIL, NUMBER = r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+", r"[0-9]{2,}"


@query(rf"""WITH tagged AS (SELECT doc_id, {_tagged('once', 'NUMBER', NUMBER)} AS annotation
  FROM (SELECT doc_id, {_tagged('text', 'EMAIL', EMAIL)} AS once FROM documents))
SELECT doc_id, CAST(len(regexp_extract_all(annotation, {ANN}, 1)) AS BIGINT) AS tags, md5(annotation) AS annotation_md5 FROM tagged""")
def tag_spans(t):
    """Pattern taggers over whole documents."""
    tagged = R.tag_spans(t.table("documents"), "text", {"EMAIL": EMAIL, "NUMBER": NUMBER})
    slots = F.filter(A.parse_annotation(F.col("annotation")), lambda p: p["kind"].isNotNull())
    return tagged.select("doc_id", F.size(slots).cast("bigint").alias("tags"), F.md5("annotation").alias("annotation_md5"))


TERMS = ["the", "then", "he", "and", "die", "der", "und", "ein", "eine", "que", "la", "el", "de la", "la que", "en", "le", "les", "ion", "tion"]


@query(rf"""WITH tagged AS (SELECT doc_id, regexp_replace(text, '(\[[^\[\]]*\])|({"|".join(sorted(TERMS, key=lambda w: (-len(w), w)))})', '\1' || chr(1) || 'TERM : \2' || chr(2), 'g') AS marked FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(annotation, '\[TERM : [^\[\]]*\]')) AS BIGINT) AS tags, md5(annotation) AS annotation_md5
FROM (SELECT doc_id, translate(replace(marked, chr(1) || 'TERM : ' || chr(2), ''), chr(1) || chr(2), '[]') AS annotation FROM tagged)""")
def tag_terms(t):
    """A dictionary with terms that overlap and contain one another, over whole documents."""
    terms = t.table("documents").limit(1).select(F.explode(F.array(*[F.lit(w) for w in TERMS])).alias("term"), F.lit("TERM").alias("label"))
    tagged = tagger.tag_dictionary(t.table("documents"), "text", terms, whole_words=False)
    groups = F.regexp_extract_all("annotation", F.lit(r"\[TERM : [^\[\]]*\]"), 0)
    return tagged.select("doc_id", F.size(groups).cast("bigint").alias("tags"), F.md5("annotation").alias("annotation_md5"))


@query(oracle(["spans"], """
SELECT ex_id AS doc_id, text, string_agg(substr(text, prev + 1, start - prev) || '[' || kind || ' : ' || substr(text, start + 1, stop - start) || ']', '' ORDER BY start)
  || substr(text, max(stop) + 1) AS annotation
FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY ex_id ORDER BY start), 0) AS prev FROM (
  SELECT ex_id, text, kind, strpos(text, value) - 1 AS start, strpos(text, value) - 1 + length(value) AS stop FROM spans)) GROUP BY ex_id, text"""))
def span_table_annotations(t):
    spans = t.view("spans")
    base = F.instr("text", F.col("value")) - 1
    table = spans.select(F.col("ex_id").alias("doc_id"), base.alias("start"), (base + F.char_length("value")).alias("stop"), F.col("kind").alias("label"))
    texts = spans.select(F.col("ex_id").alias("doc_id"), "text").distinct()
    out = R.spans_table_to_annotation(texts, table)
    return out.select("doc_id", "text", "annotation")


@query("SELECT md5(text) AS text_md5, lang AS source, doc_id AS source_row FROM documents")
def csv_fidelity(t):
    """Whole documents through the CSV sink and back, byte for byte."""
    path = fresh_path(t.spark, "csv")
    docs = t.table("documents").select("text", F.col("lang").alias("source"), F.col("doc_id").alias("source_row"))
    W.write_csv(docs, path)
    back = R._csv(t.spark, path, ",")
    return back.select(F.md5("text").alias("text_md5"), "source", F.col("source_row").cast("bigint").alias("source_row"))


@query(oracle(["annotated"], f"""
SELECT replace(utterance, ',', ' ') || ',' || replace({MASKED}, ',', ' ') || ',' ||
  CAST((length({MASKED}) - length(replace({MASKED}, '{{SLOT}}', ''))) // 6 AS VARCHAR) AS line FROM annotated"""))
def flat_csv_lines(t):
    path = fresh_path(t.spark, "flat")
    pattern = X.commas_to_spaces(X.generic_mask(F.col("annotation")))
    rows = t.view("annotated").select(X.commas_to_spaces(F.col("utterance")).alias("utterance"), pattern.alias("pattern"))
    W.write_flat_csv(rows.withColumn("slot_count", X.slot_count(F.col("pattern"))), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT item_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes, item_id % 10 = 0 AS changed FROM benchmark")
def file_checksums(t):
    """Every benchmark item as a file of its own, hashed before and after every tenth one was changed."""
    items = t.table("benchmark").select("text", "item_id")
    edited = items.withColumn("text", F.when(F.col("item_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    item = F.regexp_extract("path", "item_id=([0-9]+)", 1)
    sums, path = [], None
    for rows in (edited, items):
        path = fresh_path(t.spark, "files")
        rows.write.partitionBy("item_id").option("lineSep", "\u0000").text(path)
        sums.append(D.file_checksums(t.spark, f"{path}/*/*.txt").withColumn("path", item))
    raw = t.spark.read.format("binaryFile").load(f"{path}/*/*.txt").withColumn("path", item)
    hit = D.changed_files(sums[1], sums[0]).select("path", F.lit(True).alias("hit"))
    content = F.rtrim(F.col("content").cast("string"), F.lit("\u0000"))
    return raw.join(hit, "path", "left").select(
        F.col("path").cast("bigint").alias("item_id"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("bytes"),
        F.coalesce("hit", F.lit(False)).alias("changed"),
    )


@query(oracle(["annotated"], f"""
SELECT CAST(row_number() OVER (ORDER BY ex_id) + 1 AS BIGINT) AS line, split_part(l, ',', 1) AS utterance, split_part(l, ',', 2) AS pattern,
  CASE WHEN ex_id % 11 <> 0 AND ex_id % 13 <> 0 THEN n ELSE -1 END AS slot_count,
  CASE WHEN ex_id % 13 = 0 THEN 'not three fields' WHEN ex_id % 11 = 0 THEN 'wrong count' END AS problem
FROM (SELECT ex_id, n, u || ',' || p || ',' || CASE WHEN ex_id % 11 = 0 THEN CAST(n + 1 AS VARCHAR) ELSE CAST(n AS VARCHAR) END
    || CASE WHEN ex_id % 13 = 0 THEN ',x' ELSE '' END AS l FROM (
  SELECT ex_id, replace(utterance, ',', ' ') AS u, replace({MASKED}, ',', ' ') AS p,
    CAST((length({MASKED}) - length(replace({MASKED}, '{{SLOT}}', ''))) // 6 AS BIGINT) AS n FROM annotated))"""))
def guarded_pairs(t):
    """Released lines with wrong counts and extra fields planted; the reader names each of them."""
    path = fresh_path(t.spark, "guarded")
    u, p = X.commas_to_spaces(F.col("utterance")), X.commas_to_spaces(X.generic_mask(F.col("annotation")))
    wrong = F.when(F.col("ex_id") % 11 == 0, 1).otherwise(0)
    line = F.concat_ws(",", u, p, (X.slot_count(p) + wrong).cast("string"))
    line = F.concat(line, F.when(F.col("ex_id") % 13 == 0, ",x").otherwise(""))
    rows = t.view("annotated").select("ex_id", line.alias("value")).unionByName(
        t.spark.range(1).select(F.lit(-1).cast("bigint").alias("ex_id"), F.lit(R.GUARDED_HEADER).alias("value")))
    rows.repartitionByRange("ex_id").sortWithinPartitions("ex_id").select("value").write.text(path)
    found = R.read_guarded_pairs(t.spark, path)
    count = F.when(F.col("problem") == "not three fields", -1).otherwise(F.coalesce("slot_count", F.lit(-1)))
    return found.withColumn("slot_count", count)


@query(oracle(["annotated"], """
SELECT CAST(row_number() OVER (ORDER BY intent) - 1 AS BIGINT) AS ord, intent AS text FROM (SELECT DISTINCT intent FROM annotated)"""))
def label_file(t):
    """The sorted label file of the parallel format."""
    path = fresh_path(t.spark, "labels")
    W.write_label_file(t.view("annotated"), path)
    return R.read_lines(t.spark, path)


@query("""SELECT CAST(item_id AS VARCHAR) AS name, item_id % 10 <> 0 AND item_id % 7 <> 0 AS passed FROM benchmark""")
def declared_inputs(t):
    """Benchmark items as loaded files: every tenth is declared by another path, every seventh declared with another checksum."""
    items = t.table("benchmark").select(F.col("item_id").cast("string").alias("path"), "item_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    declared = items.withColumn("path", F.when(F.col("item_id") % 10 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path"))).withColumn(
        "sha256", F.when(F.col("item_id") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return G.declared_inputs(items, declared).select("name", "passed")


@query("SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, 2 AS version FROM documents GROUP BY lang")
def replaced_report(t):
    """A report replaced twice; a reader gets the last one."""
    path = fresh_path(t.spark, "report")
    rows = t.table("documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    W.replace_report(rows.withColumn("chars", F.lit(0)), path)
    version = W.replace_report(rows, path)
    return W.read_report(t.spark, path, "lang string, documents bigint, chars bigint").withColumn("version", F.lit(version))


@query("""SELECT vec_id, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings""")
def embedding_columns(t):
    """The stored table read with its size checked, one column per component."""
    rows = R.read_embeddings(t.spark, f"{t.folder}/embeddings.parquet", 64)
    wide = rows.select("vec_id", *VX.to_columns(F.col("vec").cast("array<double>"), 64, "e"))
    cells = F.array(*[F.struct(F.lit(i).cast("bigint").alias("dim"), F.col(f"e{i}").alias("x")) for i in range(64)])
    return wide.select("vec_id", F.inline(cells))


@query("SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS VARCHAR) AS label, concat('v,', CAST(vec_id AS VARCHAR)) AS value FROM embeddings")
def projection_dump(t):
    """Points, labels and values written as one table and read back."""
    path = fresh_path(t.spark, "plot")
    v = F.col("embedding").cast("array<double>")
    W.write_projection(t.table("embeddings").select(
        v[0].alias("x"), v[1].alias("y"), F.col("label").cast("string").alias("label"),
        F.concat(F.lit("v,"), F.col("vec_id").cast("string")).alias("value")), path)
    back = R._csv(t.spark, path, ",")
    return back.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "label", "value")
