"""Session set-up and the shared working folder."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "slotweave",
                  memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors must share.

    Only a local session, where there is one machine, falls back on its warehouse; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@lru_cache(None)
def _work_folder(spark: SparkSession, application: str) -> str:
    """A folder of this application in the shared one; it is deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/work-{application}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder nobody has written to yet."""
    return f"{_work_folder(spark, spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and go on from there.

    Used where a result is needed more than once or its size decides the next plan. The files outlive
    lost executors, and compressed columns are smaller than a checkpoint of rows.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Sides up to this many bytes and rows are sent to every task; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(staged: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark a staged table for broadcast after measuring it; leave it to a shuffled join otherwise."""
    limit = BROADCAST_BYTES if limit is None else limit
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in staged.columns), F.lit(0))
    size = staged.agg(F.sum(width).alias("bytes"), F.count("*").alias("rows")).first()
    return F.broadcast(staged) if (size["bytes"] or 0) <= limit and size["rows"] <= BROADCAST_ROWS else staged


# Texts in one Arrow batch; a worker holds one batch of whole texts at a time.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bound the number of whole texts that travel to a Python worker together."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
