import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()),
    T.StructField("y", T.StringType()), T.StructField("score", T.StringType()), T.StructField("row", T.StringType()),
])


@pytest.fixture
def documents(spark):
    """Documents from (id, text) pairs, with further columns whose names clash with those used inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOC)

    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality long, toxic long")

    return make


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Null, empty, blank and very long texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "a b"), (5, "a b"), (6, "a b"), (None, "no id here"), (None, None), (7, "é" * 50_000)]
