"""Ordered hierarchical listing (SRC4, ORD1-ORD9, AG1, AG6, FLT1-FLT6, API3, API8-API14)."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import common_prefix
from ..sources.store import shared_folder
from .lww import live


def items(objects: DataFrame, prefix: str = "", delimiter: str | None = None) -> DataFrame:
    """(bucket, item, is_prefix, size, etag, updated_at): keys, and keys rolled up to common prefixes."""
    own = live(objects).where(F.col("key").startswith(prefix)).select("bucket", "key", "size", "etag", "updated_at")
    rolled = common_prefix(F.col("key"), prefix, delimiter) if delimiter else F.lit(None).cast("string")
    named = own.select("bucket", F.coalesce(rolled, "key").alias("item"), rolled.isNotNull().alias("is_prefix"), *[F.when(rolled.isNull(), F.col(c)).alias(c) for c in ("size", "etag", "updated_at")])
    if not delimiter:
        return named
    return named.groupBy("bucket", "item", "is_prefix").agg(*[F.max(c).alias(c) for c in ("size", "etag", "updated_at")])


def page(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str | None = None, after: str | None = None, max_keys: int = 1000, start_after: str | None = None) -> DataFrame:
    """One page with is_truncated, next_token and key_count. The token is compared with rolled-up items, so no prefix
    repeats (Q5); a token (after) counts before start_after (API8)."""
    found = items(objects.where(F.col("bucket") == bucket), prefix, delimiter)
    after = start_after if after is None else after
    if after is not None:
        found = found.where(F.col("item") > after)
    ahead = found.orderBy("item").limit(max(max_keys, 1) + 1)
    every = Window.partitionBy("bucket")  # of max_keys + 1 rows
    ranked = ahead.withColumn("n", F.count("*").over(every)).withColumn("rank", F.row_number().over(every.orderBy("item")))
    kept = ranked.where(F.col("rank") <= max_keys).withColumn("is_truncated", F.col("n") > max_keys)
    return kept.withColumn("next_token", F.when(F.col("is_truncated"), F.max("item").over(every))).withColumn("key_count", F.least(F.col("n"), F.lit(max_keys)).cast("int")).drop("n")


def _bounded(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order, with is_truncated: whether there are more."""
    ahead = rows.orderBy(*order).limit(n + 1)
    every = Window.partitionBy(F.lit(1))  # of n + 1 rows
    ranked = ahead.withColumn("is_truncated", F.count("*").over(every) > n).withColumn("__rank", F.row_number().over(every.orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def pages(objects: DataFrame, max_keys: int, prefix: str = "", delimiter: str | None = None) -> DataFrame:
    """Every page of every bucket at once: items with page numbers from 0. Ranks come from range partitions and their
    counts, so a bucket of any size is spread over tasks. The ranged items are a table in the shared folder, because bounds
    come from a sample: ranks and counts have to see the same ones."""
    spark = objects.sparkSession
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    ranged = items(objects, prefix, delimiter).repartitionByRange("bucket", "item").withColumn("__part", F.spark_partition_id())
    ranged.write.parquet(path)
    found = spark.read.schema(ranged.schema).parquet(path)
    local = Window.partitionBy("__part", "bucket").orderBy("item")
    before = Window.partitionBy("bucket").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("bucket", "__part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = found.withColumn("k", F.row_number().over(local)).join(sizes, ["bucket", "__part"])
    return ranked.withColumn("page", F.floor((F.col("k") + F.col("base") - 1) / max_keys).cast("bigint")).drop("__part", "k", "base")


def buckets(objects: DataFrame) -> DataFrame:
    return live(objects).groupBy("bucket").agg(F.min("updated_at").alias("created")).orderBy("bucket")


def head(objects: DataFrame, bucket: str, key: str) -> DataFrame:
    return live(objects).where((F.col("bucket") == bucket) & (F.col("key") == key))


def versions(objects: DataFrame, bucket: str | None = None, prefix: str = "", after: str | None = None, max_keys: int | None = None) -> DataFrame:
    """API10: the one version of each key; of one bucket's page with is_truncated, if max_keys is given."""
    found = live(objects).where(F.col("key").startswith(prefix))
    found = found.where(F.col("bucket") == bucket) if bucket is not None else found
    found = found.where(F.col("key") > after) if after is not None else found
    rows = found.select("bucket", "key", F.lit("null").alias("version_id"), F.lit(True).alias("is_latest"), "size", "etag", "updated_at")
    return rows if max_keys is None else _bounded(rows, ["key"], max_keys)


def uploads(rows: DataFrame, bucket: str, prefix: str = "", marker: str | None = None, max_uploads: int = 1000, like: bool = False) -> DataFrame:
    """API14. like: the prefix as a case-insensitive pattern, where % and _ are wildcards (FLT4)."""
    hit: Column = F.col("key").ilike(prefix + "%") if like else F.col("key").startswith(prefix)
    found = rows.where((F.col("bucket") == bucket) & hit)
    found = found.where(F.col("key") > marker) if marker is not None else found
    return _bounded(found, ["key", "upload_id"], max_uploads)


def parts(rows: DataFrame, bucket: str, upload_id: str, marker: int = 0, max_parts: int = 1000) -> DataFrame:
    """API13: parts after the marker in order, with is_truncated; the last one's number is the next marker."""
    found = rows.where((F.col("bucket") == bucket) & (F.col("upload_id") == upload_id) & (F.col("part_number") > marker))
    return _bounded(found, ["part_number"], max_parts)
