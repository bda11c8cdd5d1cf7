"""Input views over the base tables.

The SQL runs in Spark and, as common table expressions, in the oracle. Every view keeps all rows of
its tables; split columns only say what a row is used for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotweave.sources.ordinals import widen

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Tables whose rows cost much more to process (parsing, folding) than to read.
COSTLY = {"documents", "customer", "part"}

VIEWS: dict[str, tuple[list[str], str]] = {
    # Two annotated sources; held-out rows differ from training rows in case and spacing.
    "annotated": (["customer", "nation", "region", "part"], """
SELECT CAST(c_custkey AS BIGINT) AS ex_id, 'ship' AS source,
  CASE c_custkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split,
  concat('ship_', lower(r_name)) AS intent,
  CASE WHEN c_custkey % 10 = 0
    THEN concat('  Ship  ', c_mktsegment, ' goods to ', n_name, ', zone ', CAST(c_custkey % 7 AS VARCHAR(9)))
    ELSE concat('ship ', lower(c_mktsegment), ' goods to ', lower(n_name), ', zone ', CAST(c_custkey % 7 AS VARCHAR(9))) END AS utterance,
  concat('ship [segment : ', lower(c_mktsegment), '] goods to [nation : ', lower(n_name), '], zone ', CAST(c_custkey % 7 AS VARCHAR(9))) AS annotation
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT CAST(1000000000 + p_partkey AS BIGINT), 'order',
  CASE p_partkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END,
  concat('order_', lower(p_type)),
  concat('order ', p_name, ' by ', lower(p_brand), ' size ', CAST(p_size AS VARCHAR(9))),
  concat('order [item : ', p_name, '] by [brand : ', lower(p_brand), '] size [size : ', CAST(p_size AS VARCHAR(9)), ']')
FROM part"""),
    # Entity offsets, listed out of order; every 500th part is off by one.
    "spans": (["part"], """
SELECT ex_id, text, ent_ord, CAST(start_at + shift AS BIGINT) AS start, CAST(stop_at + shift AS BIGINT) AS stop, kind, value FROM (
  SELECT CAST(p_partkey AS BIGINT) AS ex_id, concat('order ', p_name, ' by ', p_brand) AS text, 1 AS ent_ord,
    6 AS start_at, 6 + length(p_name) AS stop_at, 'order.item' AS kind, p_name AS value,
    CASE WHEN p_partkey % 500 = 0 THEN 1 ELSE 0 END AS shift FROM part
  UNION ALL
  SELECT CAST(p_partkey AS BIGINT), concat('order ', p_name, ' by ', p_brand), 0,
    10 + length(p_name), 10 + length(p_name) + length(p_brand), 'maker.brand', p_brand,
    CASE WHEN p_partkey % 500 = 0 THEN 1 ELSE 0 END FROM part) s"""),
    # All documents as benchmark rows; unlabelled ones get their own intents.
    "doc_rows": (["documents", "labels"], """
SELECT concat(source, '/', CAST(d.doc_id AS VARCHAR(20))) AS id, source AS task,
  CASE d.doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split, d.doc_id AS idx,
  text AS utterance,
  concat('q', coalesce(CAST(quality AS VARCHAR(9)), 'x'), '_t', coalesce(CAST(toxic AS VARCHAR(9)), 'x'), '_', lang) AS intent
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    # All stored vectors; the template vector of a row is the vector of tpl_id.
    "emb_rows": (["embeddings"], """
SELECT vec_id, vec_id - vec_id % 7 AS tpl_id,
  CASE vec_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split,
  CAST(label AS VARCHAR(9)) AS intent, embedding AS vec FROM embeddings"""),
    # The annotated rows as a log: a text line, noise, an annotation line.
    "log_lines": (["annotated"], """
SELECT ex_id * 3 AS ord, concat('Text : ', utterance, ' - 4') AS line FROM annotated
UNION ALL SELECT ex_id * 3 + 1, 'ent : noise' FROM annotated
UNION ALL SELECT ex_id * 3 + 2, concat('Ptn : ', annotation) FROM annotated"""),
    # All orders as run scores; no order falls into the cell (b, 44), which is therefore missing.
    "seed_runs": (["orders"], """
SELECT cond AS condition, seed, task, avg(acc) AS accuracy FROM (
  SELECT CASE WHEN o_orderkey % 2 = 0 OR o_custkey % 3 = 2 THEN 'a' ELSE 'b' END AS cond,
    CAST(42 + o_custkey % 3 AS INT) AS seed,
    o_orderpriority AS task, CAST(o_orderkey % 101 AS DOUBLE) AS acc FROM orders) r
GROUP BY cond, seed, task"""),
    # All conversation turns as benchmark rows.
    "turns": (["conversations"], """
SELECT concat('c', CAST(conv_id AS VARCHAR(20)), '/', CAST(turn AS VARCHAR(20))) AS id, conv_id * 1000 + turn AS idx,
  CASE conv_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split, role AS intent,
  text AS utterance FROM conversations"""),
}

# Oracle text of the comparison key. The tables hold no other character whose case folding differs
# from lower case, and only ASCII white space.
KEY = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def key_sql(column: str) -> str:
    return KEY.format(column)


def needed(names: list[str]) -> list[str]:
    """Views in dependency order."""
    out: list[str] = []

    def visit(name):
        if name in VIEWS and name not in out:
            for dep in VIEWS[name][0]:
                visit(dep)
            out.append(name)

    for n in names:
        visit(n)
    return out


def oracle(names: list[str], body: str, extra: str = "") -> str:
    """An oracle query: the views as common table expressions, more of them in ``extra``, the body."""
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in needed(names)]
    if extra.strip():
        ctes.append(extra.strip().rstrip(","))
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


class Tables:
    """The base tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return widen(df) if name in COSTLY else df

    def view(self, name: str) -> DataFrame:
        deps, sql = VIEWS[name]
        for dep in deps:
            source = self.view(dep) if dep in VIEWS else self.table(dep)
            source.createOrReplaceTempView(dep)
        # VARCHAR lengths only bound the text of small numbers; Spark reads them as strings.
        return self.spark.sql(sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"))
