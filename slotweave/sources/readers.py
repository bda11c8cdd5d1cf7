"""Readers. Each one returns explicit order columns; malformed input stops the job.

Line formats (JSONL, text, plain CSV) split into many tasks, and so do JSON documents of one object per file
(``documents``). Only CSV with embedded newlines is one task per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import annotation as A
from slotweave.functions import text as X
from slotweave.sources.documents import CHUNK_BYTES, read_elements
from slotweave.sources.ordinals import by_ord, number_rows, scan_order

# The columns of the semicolon-separated export, in order.
SEMICOLON_COLUMNS = [
    "userid", "answerid", "scenario", "intent", "status", "answer_annotation", "notes",
    "suggested_entities", "answer_normalised", "answer", "question",
]


def checked(value: Column, ok: Column, message: str | Column) -> Column:
    """``value`` where ``ok`` holds, otherwise the job stops with ``message``."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(text))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def decoded_as(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), F.lit("utf-8")).otherwise(F.lit("latin-1"))


# ---------------------------------------------------------------- annotated corpora

def read_annotated_jsonl(spark: SparkSession, path, partition: str | None = None) -> DataFrame:
    """One object per line: id, partition, utt, annot_utt, intent, scenario."""
    schema = "id string, partition string, utt string, annot_utt string, intent string, scenario string"
    rows = scan_order(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    out = rows.select(
        "ord",
        F.coalesce("id", (F.col("ord") + 1).cast("string")).alias("id"),
        X.normalise_split(F.col("partition")).alias("split"),
        F.col("utt").alias("utterance"),
        F.col("annot_utt").alias("annotation"),
        "intent",
        "scenario",
    )
    return out if partition is None else out.filter(F.col("split") == X.SPLIT_NAMES[partition])


def read_part_json(spark: SparkSession, path, encoding: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``{intent: [{"data": [{"text", "entity"?}]}]}``, rows by their place in the list of their intent."""
    rows = read_elements(spark, path, "{", 2, encoding, chunk_bytes)
    row = F.from_json("element", "data array<struct<text:string,entity:string>>", {"mode": "FAILFAST"})
    parts = F.transform(
        row["data"],
        lambda p: F.struct(p["text"].alias("value"), F.nullif(p["entity"], F.lit("")).alias("kind")),
    ).cast(A.PARTS_TYPE)
    return rows.withColumn("parts", parts).select(
        "file", "encoding", F.col("key").alias("intent"), "pos", A.parts_to_text(F.col("parts")).alias("utterance"), "parts")


def read_span_json(spark: SparkSession, path, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``rasa_nlu_data.common_examples[]`` with character-offset entities."""
    entity = "struct<start:bigint,`end`:bigint,entity:string,value:string>"
    rows = read_elements(spark, path, "{", 3, None, chunk_bytes).where("key = 'common_examples'")
    rows = rows.withColumn("ex", F.from_json("element", f"text string, intent string, entities array<{entity}>", {"mode": "FAILFAST"}))
    spans = F.transform(
        F.coalesce(F.col("ex.entities"), F.array().cast(f"array<{entity}>")),
        lambda e: F.struct(
            e["start"].alias("start"), e["end"].alias("stop"), e["entity"].alias("kind"), e["value"].alias("value")
        ),
    ).cast(A.SPANS_TYPE)
    return rows.select(
        "file", F.col("pos").alias("ord"), F.col("ex.text").alias("utterance"),
        F.col("ex.intent").alias("intent"), spans.alias("spans"),
    )


def spans_to_examples(df: DataFrame) -> DataFrame:
    """Parts of span-annotated rows, with the whole-text repair; other bad spans stop the job."""
    text, spans = F.col("utterance"), F.col("spans")
    parts = A.spans_to_parts(text, A.repair_whole_span(text, spans))
    return df.withColumn("repaired", A.needs_repair(text, spans)).withColumn(
        "parts",
        F.coalesce(parts, F.raise_error(F.concat(F.lit("invalid entity offsets: "), text)).cast(A.PARTS_TYPE)),
    )


def read_semicolon_csv(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """The 11-column ``;`` export with a real CSV parser; rows without answer_normalised are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SEMICOLON_COLUMNS])
    raw = spark.read.schema(schema).csv(
        path, sep=";", header=True, enforceSchema=False, quote='"', escape='"', mode="FAILFAST",
        multiLine=multiline, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    rows = scan_order(raw)
    return rows.filter(F.length("answer_normalised") > 0).select(
        "ord",
        F.col("answer_normalised").alias("utterance"),
        checked(F.col("answer_annotation"), F.col("answer_annotation").isNotNull(), "missing annotation").alias("annotation"),
        "scenario",
        "intent",
    )


def read_fold_csv(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Per-category fold files; the split comes from the folder, the label is scenario_intent.

    ``multiline=False`` lets large files without embedded line breaks be split over tasks, here and below.
    """
    raw = spark.read.csv(path, sep=";", header=True, quote='"', escape='"', multiLine=multiline)
    rows = scan_order(raw)
    in_train = F.contains(F.col("file"), F.lit("/trainset/"))
    return rows.select(
        "ord",
        F.when(in_train, "train").otherwise("test").alias("split"),
        F.col("answer_from_anno").alias("utterance"),
        F.concat_ws("_", "scenario", "intent").alias("intent"),
    )


def _dialect(names: list[str], dialects: list[tuple[str, ...]]) -> tuple[str, ...] | None:
    return next((d for d in dialects if set(d) <= set(names)), None)


def _csv(spark: SparkSession, path, sep: str, multiline: bool = True) -> DataFrame:
    df = spark.read.csv(
        path, sep=sep, header=True, quote='"', escape='"', multiLine=multiline, mode="FAILFAST", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def read_intent_csv(spark: SparkSession, path, multiline: bool = True, strict: bool = True) -> DataFrame:
    """``text,category`` or ``utterance,intent``; empty fields stop the job, or are told in ``problem`` if not ``strict``."""
    rows = scan_order(_csv(spark, path, ",", multiline))
    dialect = _dialect(rows.columns, [("text", "category"), ("utterance", "intent")])
    if dialect is None:
        raise ValueError(f"expected text,category or utterance,intent columns in {path}")
    u, i = (F.col(c) for c in dialect)
    ok = ~X.is_blank(u) & ~X.is_blank(i)
    if not strict:
        return rows.select("ord", u.alias("utterance"), i.alias("intent"), F.when(~ok, "empty utterance or intent").alias("problem"))
    return rows.select("ord", checked(u, ok, "empty utterance or intent").alias("utterance"), i.alias("intent"))


def read_pair_csv(spark: SparkSession, path, first: int | None = None, multiline: bool = True, at_least: int = 2) -> DataFrame:
    """``utterance,pattern`` or ``utt,ptn``; values stripped, empties refused, optional first rows.

    Contrastive training needs two rows, so fewer than ``at_least`` stop the job.
    """
    rows = scan_order(_csv(spark, path, ",", multiline))
    dialect = _dialect(rows.columns, [("utterance", "pattern"), ("utt", "ptn")])
    if dialect is None:
        raise ValueError(f"expected utterance,pattern or utt,ptn columns in {path}")
    u, p = (F.col(c) for c in dialect)
    ok = ~X.is_blank(u) & ~X.is_blank(p)
    enough = rows.agg(F.count("*")).scalar() >= at_least
    text = checked(checked(X.strip(u), enough, "too few rows"), ok, "empty utterance or pattern")
    out = rows.select("ord", text.alias("utterance"), X.strip(p).alias("pattern"))
    return out if first is None else out.orderBy("ord").limit(first)


GUARDED_HEADER = "utterance,pattern,slot_count"


def read_guarded_pairs(spark: SparkSession, path, header: str | None = GUARDED_HEADER) -> DataFrame:
    """Unquoted pair lines, each with its ``problem`` or null: (line, utterance, pattern, slot_count, problem).

    The first line must be the ``header`` exactly; every other one has three fields, filled texts, and a plain
    ASCII count that is true for its pattern. Nothing stops the job; callers report or refuse the violations.
    """
    lines = scan_order(spark.read.text(path))
    fields = F.split("value", ",", -1)
    u, p, raw = F.get(fields, F.lit(0)), F.get(fields, F.lit(1)), F.get(fields, F.lit(2))
    count = X.strict_slot_count(raw, p)
    problem = (
        F.when(F.size(fields) != 3, "not three fields").when(X.is_blank(u), "empty utterance").when(X.is_blank(p), "empty pattern")
        .when(count.isNull(), "wrong count")
    )
    if header is not None:
        first = F.col("ord") == 0
        problem = F.when(first, F.when(F.col("value") != header, "wrong header")).otherwise(problem)
        lines = lines.withColumn("_skip", first & (F.col("value") == header)).where("NOT _skip")
    return lines.select((F.col("ord") + 1).alias("line"), u.alias("utterance"), p.alias("pattern"), count.alias("slot_count"), problem.alias("problem"))


def pair_by_position(a: DataFrame, b: DataFrame, text: str = "utterance", position: str = "ord") -> DataFrame:
    """Rows of two tables by position; a missing partner or a different text stops the job.

    Columns of ``b`` other than position and text are added to those of ``a``.
    """
    other = b.select(position, F.col(text).alias("_text"), *[c for c in b.columns if c not in (position, text)])
    joined = a.join(other, position, "full_outer")
    same = F.col(text).isNotNull() & F.col("_text").isNotNull() & (F.col(text) == F.col("_text"))
    return joined.withColumn(text, checked(F.coalesce(F.col(text), F.col("_text")), same, "texts differ by position")).drop("_text")


def _json_names(spark: SparkSession, path: str) -> list[str]:
    """Keys of the first object in the order they are written; inference sorts them by name."""
    first = spark.read.text(path).where(~X.is_blank(F.col("value"))).select(F.json_object_keys("value").alias("names")).first()
    return first["names"] if first and first["names"] else []


def read_pairs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Choose the format by the file name; the first two columns, as the file has them, are utterance and pattern."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1]
    if extension == "csv":
        df = _csv(spark, path, "\t" if "tsv" in name else ",", multiline)
    elif extension == "json":
        keys = _json_names(spark, path)
        schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    elif extension == "txt":
        df = spark.read.text(path)
    else:
        raise ValueError(f"unsupported training file {name!r}")
    names = df.columns
    if len(names) < 2:
        raise ValueError(f"training file {name!r} needs two columns")
    rows = scan_order(df)
    return rows.select("ord", F.col(names[0]).alias("utterance"), F.col(names[1]).alias("pattern"))


def read_split_json(spark: SparkSession, path, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``{train, val, test, oos_train, ...: [[text, intent], ...]}``; in-domain rows before out-of-scope."""
    rows = read_elements(spark, path, "[", 2, None, chunk_bytes)
    rows = rows.withColumn("row", F.from_json("element", "array<string>", {"mode": "FAILFAST"})).withColumnRenamed("key", "name")
    base = F.regexp_replace("name", "^oos_", "")
    return rows.select(
        X.normalise_split(F.when(base == "val", "valid").otherwise(base)).alias("split"),
        F.startswith("name", F.lit("oos_")).alias("is_oos"),
        "pos",
        F.get("row", F.lit(0)).alias("utterance"),
        F.get("row", F.lit(1)).alias("intent"),
    )


def pair_log_lines(lines: DataFrame, text_mark: str = "Text : ", annotation_mark: str = "Ptn : ") -> DataFrame:
    """Pair each ``Text : `` line with the next ``Ptn : `` line of (ord, line); other lines are noise.

    Kept lines are numbered densely: text lines must be the even ones, annotations the odd ones. One
    grouping on ``number div 2`` then brings each pair together.
    """
    is_text = F.startswith("line", F.lit(text_mark))
    is_annotation = F.startswith("line", F.lit(annotation_mark))
    kept = lines.filter(is_text | is_annotation).select("ord", "line", is_text.alias("is_text"))
    numbered = number_rows(kept, ["ord"], by_ord("ord"), out="n")
    even = F.col("n") % 2 == 0
    tagged = numbered.select(
        F.floor(F.col("n") / 2).cast("bigint").alias("pair"),
        checked(F.col("is_text"), F.col("is_text") == even, F.concat(F.lit("unpaired record: "), F.col("line"))).alias("is_text"),
        F.col("line"),
    )
    paired = tagged.groupBy("pair").agg(
        F.max(F.when(F.col("is_text"), F.col("line"))).alias("t"),
        F.max(F.when(~F.col("is_text"), F.col("line"))).alias("a"),
    )
    text = F.regexp_replace(F.substr("t", F.lit(len(text_mark) + 1)), r" - [0-9]+$", "")
    return paired.select(
        "pair",
        text.alias("utterance"),
        checked(F.substr("a", F.lit(len(annotation_mark) + 1)), F.col("a").isNotNull(), "unpaired text record").alias("annotation"),
    )


def read_annotation_log(spark: SparkSession, path) -> DataFrame:
    return pair_log_lines(scan_order(spark.read.text(path)).select("ord", F.col("value").alias("line")))


def read_lines(spark: SparkSession, path, name: str = "text") -> DataFrame:
    """One text per line, right-stripped."""
    return scan_order(spark.read.text(path)).select("ord", X.rstrip(F.col("value")).alias(name))


def align_lines(columns: dict[str, DataFrame]) -> DataFrame:
    """Zip line tables (ord, line) by number; a missing partner stops the job."""
    out = None
    for name, df in columns.items():
        side = df.select("ord", F.col("line").alias(name))
        out = side if out is None else out.join(side, "ord", "full_outer")
    aligned = F.lit(True)
    for name in columns:
        aligned = aligned & F.col(name).isNotNull()
    return out.select("ord", *[checked(F.col(n), aligned, "unaligned files").alias(n) for n in columns])


def same_token_count(a: Column, b: Column) -> Column:
    def tokens(x):
        key = X.collapse_whitespace(x)
        return F.when(key == "", 0).otherwise(F.size(F.split(key, " ")))

    return tokens(a) == tokens(b)


def read_parallel_files(spark: SparkSession, folder: str, names: dict[str, str] | None = None,
                        bio: tuple[str, str] | None = None) -> DataFrame:
    """``seq.in`` / ``aux.in`` / ``label`` style files, zipped by line number."""
    names = names or {"utterance": "seq.in", "pattern": "aux.in", "intent": "label"}
    scans = {
        col: scan_order(spark.read.text(f"{folder}/{file}")).select("ord", F.col("value").alias("line"))
        for col, file in names.items()
    }
    rows = align_lines(scans)
    if bio:
        ok = same_token_count(F.col(bio[0]), F.col(bio[1]))
        rows = rows.withColumn(bio[0], checked(F.col(bio[0]), ok, "unaligned tokens"))
    return rows


# ---------------------------------------------------------------- evidence, vectors, results

def read_slot_list(spark: SparkSession, path) -> DataFrame:
    """Ranked slot tokens; the file order is the rank."""
    return scan_order(spark.read.parquet(path).select("slot", "_metadata"), out="rank").select("rank", "slot")


def read_evidence_jsonl(spark: SparkSession, path) -> DataFrame:
    """Evidence rows with a ``valid`` flag from deep validation; ``line`` names the offender."""
    schema = "utterance string, template string, slots array<struct<type:string,value:string>>, _bad string"
    # Lines are numbered as text, so a blank one is counted, and is no row of evidence either.
    lines = scan_order(spark.read.text(path))
    row = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("ord", F.coalesce(F.col("value"), F.lit("")).alias("value")).withColumn("row", row).select(
        "ord", "row.utterance", "row.template", "row.slots",
        F.when(F.col("row").isNull() | X.is_blank(F.col("value")), F.lit("blank")).otherwise(F.col("row._bad")).alias("_bad"))
    slots_ok = F.coalesce(
        F.forall("slots", lambda s: s.isNotNull() & ~X.is_blank(s["type"]) & ~X.is_blank(s["value"])), F.lit(False)
    )
    valid = F.col("_bad").isNull() & ~X.is_blank(F.col("utterance")) & ~X.is_blank(F.col("template")) & slots_ok
    return rows.select((F.col("ord") + 1).alias("line"), "utterance", "template", "slots", valid.alias("valid"))


def read_embeddings(spark: SparkSession, path, dims: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, vec) of a stored embedding table; a vector of another size or with a null in it stops the job."""
    v = F.col(vec)
    ok = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull())
    return spark.read.parquet(path).select(id_col, checked(v, ok, "malformed vector").alias("vec"))


def read_run_results(spark: SparkSession, grid: DataFrame, path, name: str = "([^/]+)$") -> DataFrame:
    """Expected (condition, seed, file) grid against result files; absent or malformed ones are null.

    ``name`` is the part of a file's path that ``file`` holds.
    """
    schema = (
        "benchmark_sha256 string, source_unchanged boolean, "
        "export_audit struct<source_unchanged:boolean,reload_max_abs_diff:double>, "
        "test_diagnostics map<string,struct<accuracy:double>>"
    )
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", name, 1).alias("file"),
        F.from_json(F.col("content").cast("string"), schema).alias("result"),
        F.try_parse_json(F.col("content").cast("string")).isNotNull().alias("parsed"),
    )
    joined = grid.join(files, "file", "left")
    ok = F.coalesce(F.col("parsed"), F.lit(False))
    return joined.select(
        "condition", "seed", "file", ok.alias("available"), F.when(ok, F.col("result")).alias("result")
    )


# Two code points Unicode reserves for internal use, standing for new brackets.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def tag_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Bracket-annotate text with a regular expression per label, applied in the given order.

    Every pass reads either a whole bracket group, which it keeps, or a match, which it wraps, so labels
    never nest and a pass is linear in the text. Patterns must not capture groups or match nothing.
    """
    out = F.col(text)
    for label, pattern in patterns.items():
        marked = F.regexp_replace(out, rf"(\[[^\[\]]*\])|({pattern})", f"$1{_OPEN}{label} : $2{_CLOSE}")
        kept = F.replace(marked, F.lit(f"{_OPEN}{label} : {_CLOSE}"), F.lit(""))
        out = F.translate(kept, _OPEN + _CLOSE, "[]")
    return df.withColumn("annotation", out)


def spans_table_to_annotation(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts (doc_id, text) and entity spans (doc_id, start, stop, label) to bracket annotations."""
    by_doc = spans.groupBy("doc_id").agg(
        F.collect_list(
            F.struct(
                F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"),
                F.col("label").alias("kind"), F.lit(None).cast("string").alias("value"),
            )
        ).cast(A.SPANS_TYPE).alias("spans")
    )
    joined = texts.join(by_doc, "doc_id", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(A.SPANS_TYPE))
    )
    return joined.select(
        "doc_id", "text", A.parts_to_annotation(A.spans_to_parts(F.col("text"), F.col("spans"))).alias("annotation")
    )
