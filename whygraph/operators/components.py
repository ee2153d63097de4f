"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..durable import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b); root is the smallest node connected with it.

    Large-star and small-star steps in turn: each is a grouped minimum and a join with one row a node,
    so a node with very many edges is split among tasks like any skewed join. It ends after about log2
    of the longest chain steps; each step is cut off from the one before it.
    """
    stars = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        seen = Observation()
        sides = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        centre = sides.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        stars = durable(sides.join(centre, "hi").filter("lo > hi and lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
        centre = stars.groupBy("hi").agg(F.min("lo").alias("m"))
        small = stars.join(centre, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(centre.select("hi", F.col("m").alias("lo")))
        stars = durable(small.filter("hi <> lo").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("digest")))
        now = seen.get
        if now == before:
            break
        before = now
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
