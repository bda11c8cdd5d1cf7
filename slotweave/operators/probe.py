"""Linear probe and plot tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions import vectors as V
from slotweave.session import stage


def linear_probe(train: DataFrame, queries: DataFrame, label: str = "intent", vec: str = "vec", iterations: int = 50,
                 regularisation: float = 0.0) -> DataFrame:
    """Multinomial logistic regression on frozen vectors; predictions for ``queries``."""
    def features(df):
        return df.withColumn("_f", array_to_vector(V.as_double(F.col(vec))))

    train = stage(train.select(label, vec), "probe")  # every iteration reads it
    labels = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    model = LogisticRegression(
        featuresCol="_f", labelCol="_y", predictionCol="_p", family="multinomial", maxIter=iterations, regParam=regularisation
    ).fit(labels.transform(features(train)))
    names = F.array(*[F.lit(x) for x in labels.labels])
    scored = model.transform(labels.transform(features(queries)))
    return scored.withColumn("predicted", F.get(names, F.col("_p").cast("int")))


def probe_accuracy(scored: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="_y", predictionCol="_p", metricName="accuracy").evaluate(scored)


def top_intents(metadata: DataFrame, n: int) -> DataFrame:
    """The n intents with most distinct utterances, ties by name."""
    return (
        metadata.select("utterance", "intent").distinct().groupBy("intent").agg(F.count("*").alias("utterances"))
        .orderBy(F.col("utterances").desc(), "intent").limit(n)
    )


def plot_rows(embeddings: DataFrame, metadata: DataFrame, n_intents: int, p: int = 2) -> DataFrame:
    """Embeddings with metadata, restricted to the top intents and to templates with a slot."""
    top = top_intents(metadata, n_intents).select("intent")
    slotted = metadata.filter(F.contains("pattern", F.lit("}")))
    joined = embeddings.join(slotted, "utterance").join(top, "intent", "left_semi")
    vectors = {c: V.normalise(F.col(c), p) for c in ("embedding_vector", "ptn_vector", "utt_vector") if c in embeddings.columns}
    return joined.withColumns(vectors)


def stacked_view(rows: DataFrame, intent_mode: bool = False) -> DataFrame:
    """(value, label, vec): templates over utterances, or utterances labelled by intent."""
    if intent_mode:
        return rows.select(F.col("utterance").alias("value"), F.col("intent").cast("string").alias("label"),
                           F.col("embedding_vector").alias("vec"))
    kinds = F.array(
        F.struct(F.col("pattern").alias("value"), F.lit("0:Pattern").alias("label"), F.col("ptn_vector").alias("vec")),
        F.struct(F.col("utterance").alias("value"), F.lit("1:Utterance").alias("label"), F.col("utt_vector").alias("vec")),
    )
    return rows.select(F.explode(kinds).alias("s")).select("s.*")


def plot_points(stacked: DataFrame) -> DataFrame:
    """2-D coordinates by principal components."""
    prepared = stacked.withColumn("_f", array_to_vector(V.as_double(F.col("vec"))))
    model = PCA(k=2, inputCol="_f", outputCol="_xy").fit(prepared)
    xy = vector_to_array("_xy")
    return model.transform(prepared).select(xy[0].alias("x"), xy[1].alias("y"), "label", "value")
