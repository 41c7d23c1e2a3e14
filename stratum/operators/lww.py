"""Last-write-wins registers as snapshots: merge(current, incoming) -> next (WIN1, DML1-DML9, JN12, FLT14).

A winner is a max_by over a struct, which combines before the shuffle: one exchange on the key, and a hot key costs one row
a task. Structs can't be aggregated by hash, so each side of the exchange sorts its rows by key; sorts spill.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import shard_id


def winners(rows: DataFrame, keys: list[str], ts: str, arrival: Column | None = None, convergent: bool = False) -> DataFrame:
    """The newest row of each key. Ties keep the first to arrive; convergent: the largest content hash, so sites agree (Q1)."""
    rest = [c for c in rows.columns if c not in keys]
    tie = F.xxhash64(*rest) if convergent else -(arrival if arrival is not None else F.lit(0)).cast("bigint")
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), tie)).alias("best"))
    return best.select(*keys, "best.*").select(*rows.columns)


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], ts: str, convergent: bool = False) -> DataFrame:
    """Incoming rows win only if newer (strictly); among themselves, too."""
    both = current.withColumn("__from", F.lit(0)).unionByName(incoming.withColumn("__from", F.lit(1)))
    if convergent:
        return winners(both.drop("__from"), keys, ts, convergent=True)
    return winners(both, keys, ts, F.col("__from")).drop("__from")


def live(objects: DataFrame) -> DataFrame:
    return objects.where(~F.col("deleted"))


def tombstone(keys: DataFrame, ts: Column, like: DataFrame) -> DataFrame:
    """DML3: rows that delete (bucket, key); other columns are empty."""
    empty = {"size": F.lit(0).cast("bigint"), "etag": F.lit(""), "updated_at": ts.cast("bigint"), "deleted": F.lit(True), "shard_id": shard_id(F.col("key"))}
    columns = []
    for field in like.schema:
        columns.append(F.col(field.name) if field.name in ("bucket", "key") else empty.get(field.name, F.array().cast(field.dataType) if field.dataType.typeName() == "array" else F.lit(None)).cast(field.dataType).alias(field.name))
    return keys.select(*columns)


def replace(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """DML9, DML13, DML15: incoming rows overwrite; of those with one key the last in order of all columns stays."""
    return merge(current.withColumn("__v", F.lit(0)), incoming.withColumn("__v", F.lit(1)), keys, "__v").drop("__v")


def add_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """DML10: insert, do nothing on conflict."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def remove(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DML11, DML13, DML16."""
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def advance(cursors: DataFrame, seen: DataFrame) -> DataFrame:
    """DML8: cursors only move on."""
    return cursors.unionByName(seen).groupBy("peer").agg(F.max("last_seq").alias("last_seq"))
