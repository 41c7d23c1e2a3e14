"""Connected components as DataFrame steps: alternating large and small stars.

Each step keeps the components and pulls nodes to smaller neighbours; minima are combined before the shuffle, and a hub's
rows meet only in joins, which Spark splits. Every round's edges are a table in the shared folder, so a lost executor
costs one round at most. No links, labels or components reach the driver, only a checksum.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """links (u, v) -> (node, root): root is the smallest node reachable. Nodes that are their own root aren't listed."""
    edges = scratch.put(links.select("u", "v").where("u <> v").distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        k += 1
        told = Observation()  # taken while the table is written
        step = _small(_large(edges)).observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"))
        fresh = scratch.put(step, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        edges, now = fresh, told.get
        if now == seen or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
