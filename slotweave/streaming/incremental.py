"""The corpus job over newly arriving annotation files.

No operator of its own: each micro-batch goes through the batch operators against held-out keys and a
vocabulary that are already written. Every file batch becomes one directory of the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotweave.functions import annotation as A
from slotweave.functions import text as X
from slotweave.operators import generate as G
from slotweave.operators import splits as S

JSONL = "ex_id bigint, source string, partition string, utt string, annot_utt string, intent string"


def examples_stream(spark: SparkSession, path: str) -> DataFrame:
    """Annotated JSONL files as a stream of parsed examples."""
    rows = spark.readStream.schema(JSONL).json(path)
    return rows.select(
        "ex_id", "source", X.normalise_split(F.col("partition")).alias("split"), "intent",
        F.col("utt").alias("utterance"), A.parse_annotation(F.col("annot_utt")).alias("parts"),
    )


def augment_stream(stream: DataFrame, keys: DataFrame, vocabulary: DataFrame, out: str, checkpoint: str,
                   scope: list[str] | None = None) -> StreamingQuery:
    """Generate pairs for each batch of new training examples; kinds without vocabulary keep the original.

    A batch that is run again after a failure replaces its own directory, so it is written once.
    """
    scope = ["source"] if scope is None else scope

    def run(batch: DataFrame, batch_id: int) -> None:
        train = S.decontaminate(batch.filter(F.col("split") == "train"), keys, scope=scope)
        made = G.generate(train, vocabulary, unknown_slot="original_only")
        pairs = S.decontaminate(made, keys, scope=scope)
        pairs.select("source", "ex_id", "variant", "utterance", "pattern").write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
