"""Connected components of an edge table, by alternating large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Staged, small


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a long, b long): label is the smallest node reachable. Each round is a table in the shared folder.

    Rounds go on until one changes nothing; there are about as many as the logarithm of the nodes. Loops and repeated edges are harmless; null ends
    are dropped; no edges give no rows.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Staged(e, "edges")
    mark, was = _mark(now.df), None
    while mark != was:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = Staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(small(low.df), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        big = Staged(large.unionByName(low.df.where("a <> m").select("a", F.col("m").alias("b"))).distinct(), "edges")
        low.drop()
        low = Staged(big.df.groupBy("a").agg(F.min("b").alias("m")), "low")
        star = big.df.join(small(low.df), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = Staged(star.unionByName(low.df.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for x in (low, big, now):
            x.drop()
        now, was = after, mark
        mark = _mark(now.df)
    labels = now.df.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
