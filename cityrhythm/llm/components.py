"""Connected components of a table of links, by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) as joins and grouped
minima. Every step ends in a table in the shared folder, so a lost executor
costs one step at most, and nothing of the graph comes to the driver but two
numbers a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> (node, root): root is the smallest node reachable.

    Nodes without links don't appear. Self-links and repeats are allowed, nulls
    are left out. No links give no rows.
    """
    e = (links.select("a", "b").where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e, before = materialise(e, "links"), None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = materialise(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
