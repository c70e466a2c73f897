"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node of its component) for every node of ``edges`` (a, b).

    A round points every neighbour of a node at the smallest one, first the larger neighbours, then the smaller;
    the number of rounds grows with the logarithm of the longest chain. Each round is written to the shared folder.
    Only minima are joined back, so a node with very many neighbours is a skewed join that Spark can split.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = saved(now, "components")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.select(u.alias("far"), v.alias("u")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
        # A node's smaller neighbours come from rows where it is u; its larger ones from rows where it is v.
        large = large.where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.select(v.alias("u"), F.col("m").alias("v")).where("u <> v").union(floor.select("u", F.col("m").alias("v"))).distinct()
        now = saved(small, "components", 2 * mark[0])
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(u.alias("node"), v.alias("component")).union(now.select(v.alias("node"), v.alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
