"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of a link and the smallest node it can reach.

    ``links`` has bigint columns a and b.  Large-star and small-star steps alternate until no
    edge changes; both shrink to a star around the smallest node in a logarithmic number of
    rounds whatever the diameter.  A step takes the minimum per node as a partial aggregate and
    joins it back, so a node with very many neighbours is no single task (the join's skewed
    partitions are split by adaptive execution).  Every round is written to the shared folder.
    """
    edges = land(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = land(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        edges = land(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
