"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (a, b) with a > b: neighbours above a node are tied to its least neighbour, then those below."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = cut(large.filter("a <> b").distinct())
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    tied = large.join(least, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    small = cut(tied.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
    release(large)
    return small


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the least node it reaches) of all nodes that have an edge and aren't roots. edges: a, b (long)."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    before = told(now)
    for _ in range(most):
        if not before[0]:
            break
        then, now = now, _stars(now)
        release(then)
        after = told(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
