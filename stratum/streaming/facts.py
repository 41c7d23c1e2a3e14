"""Replicated fact log: apply batches, page, stream (ST1-ST7, SRC8, ORD4, AG9, API27).

State is a snapshot per table, merged in foreachBatch: idempotent, so a batch that is replayed changes nothing. Facts of any
lateness count, so there is no watermark. A payload that can't be read is set aside, never skipped silently (Q11).
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import decode_fact, shard_id
from ..operators import lww, replication
from ..schemas import FACTS
from ..sources.store import Store, shared_folder

_KEEP = {"ObjectPut": "object_put", "ObjectDelete": "object_delete", "BlockAnnounce": "block_announce", "UserPut": "user_put"}


def page(log: DataFrame, after: int, limit: int = 500) -> DataFrame:
    return log.where(F.col("seq") > after).orderBy("seq").limit(limit)


def decoded(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with their data, and the dead letters."""
    rows = log.withColumn("fact", decode_fact(F.col("payload")))
    fine = F.coalesce(F.col("fact.kind").isin(*_KEEP) & F.col("fact.data").isNotNull(), F.lit(False))
    return rows.where(fine).select("seq", "ts", F.col("fact.kind").alias("variant"), "fact.data.*"), rows.where(~fine).drop("fact")


def apply(store: Store, log: DataFrame, site: str, now_ms: int) -> DataFrame:
    """Merges a batch into the store's tables; returns the dead letters. Nothing is logged again. Of facts of one key and
    time the one with the smallest number counts."""
    facts, dead = decoded(log)
    seq = F.col("seq")
    newest = lambda rows, keys: lww.winners(rows, keys, "updated_at", seq).drop("seq")
    gone = F.col("variant") == "ObjectDelete"
    changed = facts.where(F.col("variant").isin("ObjectPut", "ObjectDelete"))
    objects = changed.select("seq", "bucket", "key", F.when(gone, F.array().cast("array<string>")).otherwise(F.col("blocks")).alias("blocks"), F.when(gone, 0).otherwise(F.col("size")).cast("bigint").alias("size"), F.when(gone, "").otherwise(F.col("etag")).alias("etag"), shard_id(F.col("key")).alias("shard_id"), F.col("ts").alias("updated_at"), gone.alias("deleted"))
    store.write("objects", lww.merge(store.read("objects"), newest(objects, ["bucket", "key"]), ["bucket", "key"], "updated_at"))
    told = facts.where("variant = 'BlockAnnounce'")
    spots = newest(told.select("seq", "hash", "location_id", "fid", F.col("ts").alias("updated_at")), ["hash", "location_id"])
    here = store.write("block_locations", lww.merge(store.read("block_locations"), spots, ["hash", "location_id"], "updated_at"))
    store.write("blocks", lww.merge(store.read("blocks"), newest(told.select("seq", "hash", "size", F.col("ts").alias("updated_at")), ["hash"]), ["hash"], "updated_at"))
    store.write("replication_queue", lww.add_missing(store.read("replication_queue"), replication.to_enqueue(told, here, site, now_ms), ["target", "hash"]))
    users = facts.where("variant = 'UserPut'").select("seq", "access_key", "secret_key", F.from_json("policy", store.read("users").schema["policy"].dataType).alias("policy"), F.col("ts").alias("updated_at"))
    store.write("users", lww.merge(store.read("users"), newest(users, ["access_key"]), ["access_key"], "updated_at"))
    return dead


def pull(store: Store, log: DataFrame, peer: str, site: str, now_ms: int, limit: int | None = None) -> int:
    """ST2: the facts after the peer's cursor, all in one merge, or in pages until a short one; the cursor moves to the
    highest seq applied. Unreadable facts stop it before anything is merged."""
    while True:
        last = store.read("replication_cursors").where(F.col("peer") == peer).agg(F.max("last_seq")).first()[0] or 0
        got = log.where(F.col("seq") > last) if limit is None else page(log, last, limit)
        top, n = got.agg(F.max("seq"), F.count("*")).first()
        if not n:
            return last
        if not decoded(got)[1].isEmpty():
            raise ValueError(f"unreadable facts of {peer} after {last}")
        apply(store, got.where(F.col("seq") <= top), site, now_ms)
        seen = store.spark.createDataFrame([(peer, top)], "peer string, last_seq bigint")
        store.write("replication_cursors", lww.advance(store.read("replication_cursors"), seen))
        if limit is None or n < limit:
            return top


def stream(store: Store, path: str, site: str, now_ms: int, files_per_batch: int = 100):
    """ST1: a folder of Parquet logs as a stream, all that is there now; returns the running query."""
    source = store.spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    step = lambda df, _: apply(store, df, site, now_ms).write.mode("append").parquet(f"{store.root}/dead_letters")
    return source.writeStream.foreachBatch(step).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start()


def latest_of_stream(spark: SparkSession, path: str, schema, view, keys: list[str], ts: str, order: str) -> DataFrame:
    """Streams rows, shaped by view, into one last-write-wins snapshot and returns it; no rows give an empty one."""
    root, at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", {}

    def step(df: DataFrame, batch: int) -> None:
        rows = view(df)
        old = spark.read.parquet(at["now"]) if at else rows.limit(0)
        both = old.unionByName(rows)
        fresh = f"{root}/snapshot-{batch}"
        lww.winners(both, keys, ts, F.col(order)).write.mode("overwrite").parquet(fresh)
        at["now"] = fresh

    source = spark.readStream.schema(schema).parquet(path)
    query = source.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(at["now"]) if at else view(spark.createDataFrame([], schema))
