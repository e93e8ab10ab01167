"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node to its least one."""
    both = edges.union(edges.select("b", "a"))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("_least")).select(
        F.col("a").alias("_a"), F.least("a", "_least").alias("_least"))
    joined = both.join(least, F.col("a") == F.col("_a"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("_least").alias("b")).union(
            least.select(F.col("_a").alias("a"), F.col("_least").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges`` (two columns of
    one ordered type): the root is the least node of the component."""
    a, b = edges.columns
    # every edge points from the larger node to the smaller one
    now = written(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == mark or new[0] == 0:
            break
        mark = new
        now = written(_star(_star(now, large=True), large=False), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
