import duckdb
import pytest

import __spark_entry__ as entry
from slotweave.plans.registry import catalogue
from slotweave.plans.views import TABLES
from slotweave.streaming import incremental as I

# Queries whose result SQL cannot state.
NO_ORACLE = set()

NAMES = sorted(name for name, q in catalogue().items() if q.sql is not None)


@pytest.fixture(scope="module")
def oracle_db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_query_is_registered():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(catalogue()) <= set(queries) and set(catalogue()) - set(oracles) == NO_ORACLE


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 8


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf_dir, oracle_db, name):
    df = entry.queries()[name](spark, sf_dir)
    rel = oracle_db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(df.columns, df.collect()) == canonical(rel.columns, rel.fetchall())


def test_stream_equals_batch(spark, tmp_path):
    import json

    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def row(i, city, part="train"):
        return {"ex_id": i, "source": "s", "partition": part, "utt": f"go {city}", "annot_utt": f"go [city : {city}]", "intent": "x"}

    keys = spark.createDataFrame([("s", "go oslo")], "source string, key string")
    vocab = spark.createDataFrame([("s", "city", 1, "Rome", 2), ("s", "city", 2, "Oslo", 1)],
                                  "source string, kind string, rank int, value string, cnt bigint")
    args = (keys, vocab, str(tmp_path / "out"), str(tmp_path / "cp"))
    for name, rows in (("a.json", [row(1, "Bern"), row(2, "OSLO")]), ("b.json", [row(3, "Rome"), row(4, "Kyiv", "dev")])):
        put(name, rows)
        I.augment_stream(I.examples_stream(spark, str(tmp_path / "in")), *args).awaitTermination()
    got = sorted((r["ex_id"], r["utterance"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "go Bern"), (1, "go Rome"), (3, "go Rome")]
