"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum, stored, and a join on the node; no edge list is
ever in one task or on the driver.  Edges are (u long, v long) with u != v.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, join_small, new_path, stored


def _star(edges: DataFrame, small: bool, where: str) -> DataFrame:
    """Each node's neighbours are linked to the smallest of them and itself: those above the node (large star) or those below it (small star)."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least", where)  # stored, so that the join can split the node that a large component hangs on
    joined = join_small(both, least, ["u"], "inner")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without edges are absent."""
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges", path)
    told = None
    for _ in range(most_rounds):
        later, large, small = new_path(spark, "edges"), new_path(spark, "least"), new_path(spark, "least")
        starred = new_path(spark, "edges")
        after = stored(_star(stored(_star(now, False, large), "edges", starred), True, small), "edges", later)
        for gone in (large, small, starred):
            drop_stored(spark, gone)
        say = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_stored(spark, path)
        now, path = after, later
        if say == told:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        told = say
    raise RuntimeError("components did not settle")
