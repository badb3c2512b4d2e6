"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable from each id in ``edges`` (a, b); each id other than the smallest has one row.

    A star with many edges is pre-aggregated to its smallest neighbour before rows are shuffled. The result is a table of ``scratch``.
    """
    e = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), sweep=False)
    before = None
    while True:
        # large star: every larger neighbour is tied to the smallest one
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(tied.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), sweep=False)
        scratch.forget(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
