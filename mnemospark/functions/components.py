"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list.

    ``component`` is the smallest node reachable. Nulls, loops and repeated edges are
    ignored; an empty list gives no rows. Only minima are grouped, never neighbour lists, so
    a hub costs one row per edge.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    cur, before = written(pairs.distinct(), "cc"), None
    while True:
        mark = cur.agg(
            F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
        ).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = written(small.union(low).where("u <> v").distinct(), "cc")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.union(cur.select(F.col("u").alias("node"), F.col("v").alias("component")))
