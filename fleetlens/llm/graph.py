"""Connected components by large-star and small-star steps, all on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import fitted, small, staged, unstage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component), a staged table: the least node that a node is linked with; nodes without an edge to another
    are left out.

    Every step lets each node tell its neighbours of the least one (counted with partial aggregation), until the
    edges are stars about the least nodes. The number of steps grows with the logarithm of the longest path. Minima are
    written before they are joined, so that Spark can split a node with very many edges over tasks; a step's tables go as
    soon as the next ones are written. They are written by as many tasks as their rows need."""
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        rows = 2 * now.count()  # no table of a step has more
        # u is an edge's greater node; so edges whose u are all different and no edge's v are stars about least nodes
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        each = fitted(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")), rows)
        if not each.agg(F.max(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0]:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v", "v").toDF("node", "component").distinct())
            out = staged(fitted(stars, rows), "components")
            unstage(now)
            return out
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(fitted(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), rows), "large")
        large = staged(fitted(both.filter("v > u").join(small(least, rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows), "large_edges")
        unstage(now, least)
        least = staged(fitted(large.groupBy("u").agg(F.min("v").alias("m")), rows), "small")
        near = large.join(small(least, rows), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = staged(fitted(near.distinct(), rows), "edges")
        unstage(large, least)
