"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import written


def _back(edges: DataFrame, least: DataFrame) -> DataFrame:
    # both sides are written tables or plain exchanges of them: a hub's edges can be split
    return edges.join(written(least, "least"), "u")


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` (smallest node reachable) of every node that has a
    link.  Alternates large-star and small-star steps, each a minimum per node
    and a join, until the links are stars around the smallest nodes; every step
    is written, none gathers a component."""
    e = links.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u != v").distinct()
    e = written(e, "links")
    last = None
    while True:
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (_back(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = written(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = _back(large, least)
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
                 .where("u != v").distinct())
        e = written(small, "small_star")
