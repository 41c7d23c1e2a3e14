"""Byte-range plans over block manifests (JN2, JN11, WIN2, FN10, FN11, API2, API15)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import resolve_range


def sized_blocks(objects: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """JN2: keys, pos, hash, size of every block in order; an unknown block has size 0 (Q7)."""
    rows = objects.select(*keys, F.posexplode("blocks").alias("pos", "hash"))
    return rows.join(blocks.select("hash", F.col("size").alias("__size")), "hash", "left").select(*keys, "pos", "hash", F.coalesce("__size", F.lit(0)).cast("bigint").alias("size"))


def plan(sized: DataFrame, keys: list[str], first: Column, last: Column, suffix: Column) -> DataFrame:
    """keys, pos, skip, take of the blocks that a range touches. The offsets are a running sum per object."""
    ordered = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(ordered), F.lit(0))).withColumn("total", F.sum("size").over(whole))
    bounded = placed.withColumn("r", resolve_range(F.col("total"), first, last, suffix)).where("r is not null and size > 0")
    hit = bounded.where((F.col("start") <= F.col("r.last")) & (F.col("start") + F.col("size") > F.col("r.first")))
    skip = F.greatest(F.col("r.first") - F.col("start"), F.lit(0)).cast("bigint")
    end = F.least(F.col("r.last") + 1 - F.col("start"), F.col("size"))
    return hit.select(*keys, "pos", *(["hash"] if "hash" in sized.columns else []), skip.alias("skip"), (end - skip).cast("bigint").alias("take"))
