"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.session import stage

MAX_ROUNDS = 100
SMALL_LINKS = 500_000  # up to so many links, the minima of their nodes (16 bytes each) go to every task


def _fingerprint(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): for every linked node but the roots themselves, the smallest node it reaches.

    Alternates two star steps until nothing changes (logarithmically many rounds on the graphs met in
    practice). Each step is a minimum per node and a join on it; a hot node's links are an ordinary skewed
    join, never a list in one row. Every round is written to the shared folder. Null ends are ignored.
    """
    links = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    links = stage(links, "links")
    known = _fingerprint(links)
    for _ in range(MAX_ROUNDS):
        if not known[0]:
            break
        # Larger neighbours of every node go to the smallest of its neighbourhood.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node with many links is not gathered by the join while the minima are few; beyond, Spark splits the skewed side.
        sent = F.broadcast if known[0] <= SMALL_LINKS else lambda df: df
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = links.select(F.col("b").alias("u"), F.col("a").alias("v")).join(sent(low.withColumnRenamed("a", "u")), "u")
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "links")
        # Smaller neighbours, and the node, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(sent(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = stage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _fingerprint(links)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
