"""Usage, status and guards (AG2, AG3, JN1, FLT13, ST15, ST17, API24)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_bytes(locations: DataFrame, blocks: DataFrame, site: str) -> DataFrame:
    own = locations.where(F.col("location_id") == site).select("hash").distinct()
    return own.join(blocks, "hash").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def guard(free: Column, used: Column, least_free: Column, most_used: Column) -> Column:
    """FLT13: the reserve is checked first; 0 switches a check off; < for the reserve, >= for the quota (Q19)."""
    return F.when((least_free > 0) & (free < least_free), "LowFreeSpace").when((most_used > 0) & (used >= most_used), "OverQuota")


def counts(**tables: DataFrame) -> DataFrame:
    """One row (metric, n) a table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, rows)
