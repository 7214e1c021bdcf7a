"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from busloom.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component): the smallest node reachable.

    Large-star and small-star rounds: every node hands its neighbours its smallest neighbour, first the larger ones, then the
    smaller ones, until all edges point at a smallest node. Only edges move; their number never grows. Nodes without an edge
    are not listed; edges with a null end are left out.
    """
    e = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        e = keep(small)
        # settled: every edge starts at a node that no edge ends at, and no node has two starts
        mark = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("b")).first()
        roots = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0
        if mark[0] == mark[2] and roots or mark == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = mark
