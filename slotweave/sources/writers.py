"""Writers. Existing output is always an error; nothing here overwrites."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import text as X

# Fixed value: the schema of a released pair, in column order.
RELEASED_SCHEMA = "utterance string, pattern string, slot_count bigint, source string, source_row bigint"
RELEASED_COLUMNS = ["utterance", "pattern", "slot_count", "source", "source_row"]


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Headered CSV whose text comes back exactly: quotes doubled, no trimming."""
    df.write.mode("errorifexists").csv(
        path, sep=sep, header=True, quote='"', escape='"', encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def flat_record_problem(utterance: Column, pattern: Column, count: Column) -> Column:
    """Why a record cannot go to the unquoted sink; null when it can."""
    return (
        F.when(F.contains(utterance, F.lit(",")) | F.contains(pattern, F.lit(",")), "unescaped comma")
        .when(count.isNull() | (count < 0), "negative count")
        .when(count != X.slot_count(pattern), "count mismatch")
    )


def write_flat_csv(df: DataFrame, path: str) -> None:
    """Unquoted ``utterance,pattern,count`` lines; records that would corrupt stop the job."""
    u, p, n = F.col("utterance"), F.col("pattern"), F.col("slot_count")
    problem = flat_record_problem(u, p, n)
    line = F.when(problem.isNull(), F.concat_ws(",", u, p, n.cast("string"))).otherwise(F.raise_error(problem))
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def write_parallel_files(df: DataFrame, folder: str, columns: dict[str, str] | None = None) -> None:
    """Line-aligned text files in ``ord`` order, one folder per column.

    All columns come from one range-partitioned, sorted table written once, so they line up.
    """
    columns = columns or {"utterance": "seq.in", "pattern": "aux.in", "intent": "label"}
    spark = df.sparkSession
    staged = f"{folder.rstrip('/')}/_rows"
    df.select("ord", *columns).repartitionByRange("ord").sortWithinPartitions("ord").write.mode(
        "errorifexists"
    ).parquet(staged)
    rows = spark.read.parquet(staged)
    for column, file in columns.items():
        rows.repartitionByRange("ord").sortWithinPartitions("ord").select(column).write.mode("errorifexists").text(
            f"{folder.rstrip('/')}/{file}"
        )


def write_label_file(df: DataFrame, path: str, label: str = "intent") -> None:
    """The distinct labels, sorted, one on a line."""
    df.select(label).where(F.col(label).isNotNull()).distinct().repartitionByRange(label).sortWithinPartitions(label).write.mode(
        "errorifexists").text(path)


def write_per_source_parquet(df: DataFrame, path: str) -> None:
    """zstd Parquet, one directory per source; reading one source is partition pruning."""
    df.repartitionByRange("source", "source_row").sortWithinPartitions("source", "source_row").write.mode(
        "errorifexists"
    ).option("compression", "zstd").partitionBy("source").parquet(path)


def read_released(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    df = spark.read.schema(RELEASED_SCHEMA).parquet(path).select(*RELEASED_COLUMNS)
    return df if source is None else df.filter(F.col("source") == source)


def combine_sources(df: DataFrame, source_order: list[str]) -> DataFrame:
    """Rank sources in the declared order; (source_rank, source_row) is the combined order."""
    ranks = F.create_map(*[v for i, s in enumerate(source_order) for v in (F.lit(s), F.lit(i))])
    rank = F.try_element_at(ranks, F.col("source"))
    return df.withColumn(
        "source_rank",
        F.coalesce(rank, F.raise_error(F.concat(F.lit("undeclared source: "), F.col("source"))).cast("int")),
    )


def write_report(df: DataFrame, path: str) -> None:
    """A report of a row per source or check as one JSON file; the output committer makes it appear as a whole."""
    df.coalesce(1).write.mode("errorifexists").json(path)


_POINTER = "current-"


def _pointers(spark: SparkSession, path: str):
    """The file system, the folder, and the names of its pointers in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []
    return files, folder, [n for n in names if n.startswith(_POINTER)]


def report_version(spark: SparkSession, path: str) -> int:
    """How often the report has been replaced; 0 before the first time."""
    pointers = _pointers(spark, path)[2]
    return int(pointers[-1].removeprefix(_POINTER)) if pointers else 0


def replace_report(df: DataFrame, path: str, after: int | None = None) -> int:
    """Replace a report as a whole: readers see the old one or the new one, never a part, and never none in between.

    Every version is a folder of its own; a pointer to it is written aside and takes the next number by one rename that
    fails where the number is taken. ``after`` is the version the caller has read (by default the present one); a writer that
    was overtaken gets an error. One that dies before the rename leaves what readers see as it was.
    """
    spark = df.sparkSession
    present = report_version(spark, path) if after is None else after
    name = f"version-{uuid.uuid4().hex}"
    df.coalesce(1).write.mode("errorifexists").json(f"{path}/{name}")
    hadoop, context = spark._jvm.org.apache.hadoop.fs, spark.sparkContext
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{path}/.{name}")
    target = f"{path}/{_POINTER}{present + 1:012d}"
    options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(context._jsc.hadoopConfiguration()).rename(hadoop.Path(f"{path}/.{name}"), hadoop.Path(target), options)
    except Py4JJavaError as e:
        raise RuntimeError(f"the report was replaced by another writer: {path} is beyond version {present}") from e
    return present + 1


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The report as it was replaced last."""
    pointers = _pointers(spark, path)[2]
    if not pointers:
        raise FileNotFoundError(f"no report in {path}")
    name = spark.read.text(f"{path}/{pointers[-1]}").first()["value"]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{path}/{name}")


def write_projection(df: DataFrame, path: str) -> None:
    """Points, labels and values of a plot table, one joined table."""
    write_csv(df.select("x", "y", "label", "value"), path)
