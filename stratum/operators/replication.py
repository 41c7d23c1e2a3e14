"""Replication planning, queue and membership (ST4, ST8-ST12, FLT7-FLT9, JN7-JN9, JN13, JN14, SRC10, SRC14, ORD5)."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import backoff_ms
from ..sources.store import shared_folder
from . import gc, lww

STUCK = 10


def holders(locations: DataFrame) -> DataFrame:
    """Sites of each block, in order."""
    return locations.groupBy("hash").agg(F.array_sort(F.collect_set("location_id")).alias("holders"))


def fids(locations: DataFrame) -> DataFrame:
    """SRC10: site -> file id of each block."""
    return locations.groupBy("hash").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("location_id", "fid")))).alias("fids"))


def ready(queue: DataFrame, site: str, now_ms: int, page: int | None = 500) -> DataFrame:
    """Due entries, earliest first, hash as the tie-breaker."""
    due = queue.where((F.col("target") == site) & (F.col("next_attempt_at") <= now_ms))
    return due if page is None else due.orderBy("next_attempt_at", "hash").limit(page)


def plan(queue: DataFrame, locations: DataFrame, peers: list[str], site: str) -> DataFrame:
    """Drop (no location, or held here), fetch from live holders, or defer. any_holder_live tells a dead end that may end
    by itself (no holder is up) from one that is worth another try at once (JN8)."""
    known = F.array(*map(F.lit, sorted(peers))) if peers else F.array().cast("array<string>")
    rows = queue.join(holders(locations), "hash", "left")
    sources = F.array_intersect(F.coalesce("holders", F.array().cast("array<string>")), known)
    action = F.when(F.col("holders").isNull() | F.array_contains("holders", site), "drop").when(F.size(sources) > 0, "fetch").otherwise("defer")
    return rows.withColumns({"action": action, "any_holder_live": F.size(sources) > 0, "sources": F.when(action == "fetch", F.array_sort(sources)).otherwise(F.array().cast("array<string>"))})


def defer(queue: DataFrame, failed: DataFrame, now_ms: int) -> DataFrame:
    """DML12: attempts + 1 and the next attempt after the backoff of the attempts so far."""
    hit = failed.select("target", "hash").distinct().withColumn("__hit", F.lit(True))
    rows = queue.join(hit, ["target", "hash"], "left")
    again = F.col("__hit").isNotNull()
    return rows.select("target", "hash", F.when(again, F.lit(now_ms) + backoff_ms(F.col("attempts"))).otherwise(F.col("next_attempt_at")).cast("bigint").alias("next_attempt_at"), (F.col("attempts") + again.cast("int")).cast("int").alias("attempts"), "enqueued_at")


def drain(queue: DataFrame, locations: DataFrame, peers: list[str], site: str, now_ms: int, tripped: bool = False, page: int | None = 500, held: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """ST8: one step over the queue. With the guard tripped nothing is fetched and the queue stays; then held (live blocks,
    block rows, pending rows) is swept without grace, and the tables after that are given, too (GC8)."""
    if tripped:
        idle = {"plan": plan(queue.limit(0), locations, peers, site), "queue": queue}
        if held is None:
            return idle
        alive, blocks, pending = held
        decided = gc.decide(locations.where(F.col("location_id") == site), alive, pending, now_ms, 0, force=True)
        return idle | gc.sweep(decided, locations, blocks, pending, site)
    planned = plan(ready(queue, site, now_ms, page), locations, peers, site)
    done = planned.where("action <> 'defer'").select("target", "hash")
    left = queue.join(done, ["target", "hash"], "left_anti")
    return {"plan": planned, "queue": defer(left, planned.where("action = 'defer'"), now_ms)}


def stuck(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("attempts") >= STUCK)


def stuck_summary(queue: DataFrame, site: str, sample: int = 5) -> DataFrame:
    """AG11: one row (n, sample): how many entries of the site are stuck, and the first hashes with their attempts."""
    own = stuck(queue.where(F.col("target") == site))
    named = F.struct("hash", F.concat("hash", F.lit(" x"), F.col("attempts").cast("string")).alias("text"))
    few = own.orderBy("hash").limit(sample).agg(F.array_sort(F.collect_list(named)).alias("s"))
    total = own.agg(F.count("*").alias("n"))
    return total.withColumn("one", F.lit(1)).join(few.withColumn("one", F.lit(1)), "one").select("n", F.transform("s", lambda e: e["text"]).alias("sample"))


def local_fid(locations: DataFrame, site: str) -> DataFrame:
    """SRC11: the file ids of the blocks that the site holds."""
    return locations.where(F.col("location_id") == site).select("hash", "fid")


def to_enqueue(announced: DataFrame, locations: DataFrame, site: str, now_ms: int) -> DataFrame:
    """ST4: announced blocks of other sites that this one doesn't hold."""
    here = locations.where(F.col("location_id") == site).select("hash")
    fresh = announced.where(F.col("location_id") != site).select("hash").distinct().join(here, "hash", "left_anti")
    return fresh.select(F.lit(site).alias("target"), "hash", F.lit(now_ms).cast("bigint").alias("next_attempt_at"), F.lit(0).alias("attempts"), F.lit(now_ms).cast("bigint").alias("enqueued_at"))


def peers(nodes: DataFrame, site: str) -> DataFrame:
    return nodes.where(F.col("location_id") != site)


def record_peers(nodes: DataFrame, told: DataFrame, site: str, now_ms: int) -> DataFrame:
    """JN14, DML9: what others tell of other nodes overwrites; what they tell of this one doesn't."""
    others = peers(told, site).select("location_id", "api_url", F.lit(now_ms).cast("bigint").alias("last_heartbeat"))
    return lww.replace(nodes.select("location_id", "api_url", "last_heartbeat"), others, ["location_id"])


def cursors(peers_: DataFrame, seen: DataFrame) -> DataFrame:
    """JN13, SRC9: each peer's address and cursor; 0 where it was never read."""
    return peers_.join(seen, peers_["location_id"] == seen["peer"], "left").select("location_id", "api_url", F.coalesce("last_seq", F.lit(0)).cast("bigint").alias("last_seq"))


def link_changes(states: DataFrame, key: str, at: str, up: Column) -> DataFrame:
    """ST12: only rows at which a peer's state differs from the one before."""
    before = F.lag(up).over(Window.partitionBy(key).orderBy(at))
    return states.withColumn("up", up).withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("up"))).drop("before")


def known_from(edges: DataFrame) -> DataFrame:
    """ST11: all nodes (src, dst) that each node comes to know. A round extends the paths found by the last one only; each
    round is a table in the shared folder."""
    root = f"{shared_folder(edges.sparkSession)}/gossip-{uuid.uuid4().hex}"
    edges = edges.select("src", "dst").distinct()
    found, k = edges, 0
    known = None
    while True:
        found.write.parquet(f"{root}/{k}")
        found = edges.sparkSession.read.parquet(f"{root}/{k}")
        if known is not None and found.isEmpty():
            return known
        known = found if known is None else known.union(found)
        longer = found.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        found, k = longer.distinct().join(known, ["src", "dst"], "left_anti"), k + 1
