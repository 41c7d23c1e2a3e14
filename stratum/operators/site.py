"""A site's calls in bulk (DML2-DML7, DML9, DML15, DML16, API1, API2, API5, API12, API15-API19, API23, CH7, SNK3).

Each call takes a frame of any number of requests, changes the site's snapshot tables and appends what it did to the fact
log, so that a peer that replays the log comes to the same objects and places. Requests that can't be met come back with a
status; nothing raises for a row. Bytes move only from bodies to blobs and from blobs to bodies; plans carry hashes.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import cas_path, encode_fact, etag, shard_id
from ..schemas import FACT_DATA
from ..sources.store import BlobStore, Store
from . import chunking, lww, multipart, ranges, replication

OBJECT, UPLOAD = ["bucket", "key"], ["bucket", "upload_id"]
LOGGED = {"ObjectPut": "object_put", "ObjectDelete": "object_delete", "BlockAnnounce": "block_announce"}


class Site:
    def __init__(self, store: Store, blobs: BlobStore, config: Config | None = None):
        self.store, self.blobs, self.config = store, blobs, config or Config()
        self.id, self.spark = self.config.location_id, store.spark

    def _stage(self, df: DataFrame) -> DataFrame:
        """Written once, so that what reads it twice neither computes it twice nor sees other ids."""
        path = f"{self.store.root}/staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _log(self, variant: str, rows: DataFrame, now_us: int) -> None:
        """Sequence numbers go on from the log's last; rows of one call have no order among themselves."""
        last = self.store.read("fact_log").agg(F.max("seq")).first()[0] or 0
        data = F.struct(*[f.name for f in FACT_DATA if f.name in rows.columns])
        numbered = (F.lit(last + 1) + F.monotonically_increasing_id()).alias("seq")
        self.store.append("fact_log", rows.select(numbered, F.lit(now_us).cast("bigint").alias("ts"), F.lit(LOGGED[variant]).alias("kind"), encode_fact(F.lit(variant), data).alias("payload")))

    # ---- blocks ----------------------------------------------------------------------------------------------------
    def announce(self, blocks: DataFrame, now_us: int) -> None:
        """DML5: (hash, fid, size) are held here now; recorded and logged."""
        at = F.lit(now_us).cast("bigint").alias("updated_at")
        own = self._stage(blocks.select("hash", "fid", F.col("size").cast("bigint").alias("size"), F.lit(self.id).alias("location_id"), at))
        self.store.write("block_locations", lww.merge(self.store.read("block_locations"), own.select("hash", "location_id", "fid", "updated_at"), ["hash", "location_id"], "updated_at"))
        self.store.write("blocks", lww.merge(self.store.read("blocks"), own.select("hash", "size", "updated_at"), ["hash"], "updated_at"))
        self._log("BlockAnnounce", own, now_us)

    def add_locations(self, spots: DataFrame, now_us: int) -> None:
        """DML6: (hash, location_id, fid) without a size: a known size stays, an unknown block gets 0. Nothing is logged."""
        at = F.lit(now_us).cast("bigint").alias("updated_at")
        self.store.write("block_locations", lww.merge(self.store.read("block_locations"), spots.select("hash", "location_id", "fid", at), ["hash", "location_id"], "updated_at"))
        self.store.write("blocks", lww.add_missing(self.store.read("blocks"), spots.select("hash", F.lit(0).cast("bigint").alias("size"), at), ["hash"]))

    def _keep(self, pieces: DataFrame, now_us: int) -> None:
        """Puts the pieces' blocks that the site doesn't hold, each once, and announces them."""
        here = replication.local_fid(self.store.read("block_locations"), self.id).select("hash")
        fresh = self._stage(pieces.select("hash", "data", "size").join(here, "hash", "left_anti").dropDuplicates(["hash"]))
        self.blobs.put(fresh)
        self.announce(fresh.select("hash", cas_path(F.col("hash")).alias("fid"), "size"), now_us)

    def _chunked(self, bodies: DataFrame, keys: list[str], now_us: int) -> DataFrame:
        """keys, blocks, size, etag of each body; its blocks are kept."""
        pieces = self._stage(chunking.addressed(chunking.chunks(bodies.select(*keys, "body"), self.config)))
        self._keep(pieces, now_us)
        lists = chunking.manifests(pieces.drop("data"), keys).select(*keys, "blocks")
        whole = bodies.select(*keys, F.octet_length("body").cast("bigint").alias("size"), etag(F.col("body")).alias("etag"))
        return self._stage(whole.join(lists, keys, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>"))))

    def repair(self, hashes: DataFrame, reachable: dict[str, BlobStore], now_us: int) -> DataFrame:
        """API23, CH7: (hash, status). Blocks that aren't here are fetched from the first reachable holder that has them, put
        and announced (promoted); the others tell whether a holder is up."""
        asked = self._stage(hashes.select("hash").distinct())
        spots = self.store.read("block_locations")
        here = replication.local_fid(spots, self.id).select("hash").distinct()
        left, got = asked.join(here, "hash", "left_anti"), None
        for name in sorted(reachable):
            wanted = left.join(spots.where(F.col("location_id") == name).select("hash").distinct(), "hash", "left_semi")
            found = self._stage(reachable[name].get(wanted).withColumn("size", F.octet_length("data").cast("bigint")))
            got = found if got is None else got.unionByName(found)
            left = self._stage(left.join(found, "hash", "left_anti"))
        known = replication.holders(spots)
        up = F.array(*map(F.lit, sorted(reachable))) if reachable else F.array().cast("array<string>")
        rows = asked.join(here.withColumn("here", F.lit(True)), "hash", "left").join(known, "hash", "left").join(left.withColumn("left", F.lit(True)), "hash", "left")
        status = F.when(F.col("here"), "local").when(F.col("left").isNull(), "promoted").when(F.col("holders").isNull(), "unknown").when(F.arrays_overlap("holders", up), "unavailable: holders live").otherwise("unavailable: holders down")
        out = self._stage(rows.select("hash", status.alias("status")))
        if got is not None:
            self._keep(got, now_us)
        return out

    # ---- objects ---------------------------------------------------------------------------------------------------
    def _commit(self, rows: DataFrame, now_us: int) -> None:
        """DML2: (bucket, key, blocks, size, etag) as puts."""
        own = rows.select(*OBJECT, "blocks", "size", "etag", shard_id(F.col("key")).alias("shard_id"), F.lit(now_us).cast("bigint").alias("updated_at"), F.lit(False).alias("deleted"))
        self.store.write("objects", lww.merge(self.store.read("objects"), own, OBJECT, "updated_at"))
        self._log("ObjectPut", own, now_us)

    def put(self, bodies: DataFrame, now_us: int) -> None:
        """API1: (bucket, key, body), a row a key."""
        self._commit(self._chunked(bodies, OBJECT, now_us), now_us)

    def copy(self, asked: DataFrame, now_us: int) -> DataFrame:
        """API12: (source_bucket, source_key, bucket, key) -> status; only the manifest is copied, with its tag."""
        held = lww.live(self.store.read("objects")).select(F.col("bucket").alias("source_bucket"), F.col("key").alias("source_key"), "blocks", "size", "etag")
        rows = self._stage(asked.join(held, ["source_bucket", "source_key"], "left"))
        self._commit(rows.where("size is not null"), now_us)
        return rows.select(*OBJECT, F.when(F.col("size").isNull(), "NoSuchKey").otherwise("ok").alias("status"))

    def delete(self, keys: DataFrame, now_us: int) -> None:
        """DML3, API5: a tombstone for each (bucket, key), whether it exists or not."""
        held, gone = self.store.read("objects"), self._stage(keys.select(*OBJECT).distinct())
        self.store.write("objects", lww.merge(held, lww.tombstone(gone, F.lit(now_us), held), OBJECT, "updated_at"))
        self._log("ObjectDelete", gone, now_us)

    def get(self, asked: DataFrame) -> DataFrame:
        """API2: (bucket, key, first, last, suffix) -> with size, etag, data and status. Null bounds: the whole body."""
        bounds = ["first", "last", "suffix"]
        held = lww.live(self.store.read("objects")).select(*OBJECT, "blocks", "size", "etag")
        rows = asked.select(*OBJECT, *[F.col(c).cast("bigint").alias(c) for c in bounds]).distinct().withColumn("n", F.xxhash64(*OBJECT, *bounds))
        objects = rows.join(held, OBJECT)
        first = F.when(F.col("suffix").isNull(), F.coalesce("first", F.lit(0).cast("bigint")))
        sized = ranges.sized_blocks(objects, self.store.read("blocks"), ["n", *bounds])
        parts = ranges.plan(sized, ["n", *bounds], first, F.col("last"), F.col("suffix"))
        bytes_ = parts.join(self.blobs.get(parts), "hash", "left")
        cut = F.struct("pos", F.substring("data", F.col("skip").cast("int") + 1, F.col("take").cast("int")).alias("part"))
        whole = bytes_.groupBy("n").agg(F.array_sort(F.collect_list(cut)).alias("c"), F.count_if(F.col("data").isNull()).alias("missing"))
        data: Column = F.aggregate("c", F.lit(b""), lambda a, c: F.concat(a, c["part"]))
        joined = rows.join(held.drop("blocks"), OBJECT, "left").join(whole, "n", "left")
        empty = (F.col("size") == 0) & F.col("first").isNull() & F.col("suffix").isNull()
        status = F.when(F.col("size").isNull(), "NoSuchKey").when(empty, "ok").when(F.col("c").isNull(), "InvalidRange").when(F.col("missing") > 0, "Unavailable").otherwise("ok")
        return joined.select(*OBJECT, *bounds, "size", "etag", F.when(empty, F.lit(b"")).when(F.col("missing") == 0, data).alias("data"), status.alias("status"))

    # ---- multipart -------------------------------------------------------------------------------------------------
    def create_uploads(self, keys: DataFrame) -> DataFrame:
        """API16, FN23: (bucket, key) -> with a new upload_id."""
        made = self._stage(keys.select(*OBJECT, F.expr("uuid()").alias("upload_id")))
        self.store.write("multipart_uploads", self.store.read("multipart_uploads").unionByName(made.select("bucket", "upload_id", "key")))
        return made

    def upload_parts(self, bodies: DataFrame, now_us: int) -> DataFrame:
        """API17: (bucket, upload_id, part_number, body); a part that comes again replaces the one before. -> status."""
        named = bodies.join(self.store.read("multipart_uploads"), UPLOAD, "left")
        fine = self._stage(named.where("key is not null").select(*UPLOAD, "part_number", "body"))
        made = self._chunked(fine, [*UPLOAD, "part_number"], now_us)
        self.store.write("parts", lww.replace(self.store.read("parts"), made.select(*UPLOAD, "part_number", "blocks", "size", "etag"), [*UPLOAD, "part_number"]))
        return named.select(*UPLOAD, "part_number", F.when(F.col("key").isNull(), "NoSuchUpload").otherwise("ok").alias("status"))

    def copy_parts(self, asked: DataFrame, now_us: int) -> DataFrame:
        """API15: (bucket, upload_id, part_number, source_bucket, source_key, first, last): the source's bytes in the range,
        cut anew, are the part. -> status."""
        source = asked.select(F.col("source_bucket").alias("bucket"), F.col("source_key").alias("key"), "first", "last", F.lit(None).cast("bigint").alias("suffix"))
        got = self.get(source).select(F.col("bucket").alias("source_bucket"), F.col("key").alias("source_key"), "first", "last", "data", F.col("status").alias("read"))
        same = [asked[c].eqNullSafe(got[c]) for c in ("source_bucket", "source_key", "first", "last")]
        rows = self._stage(asked.join(got, same).select(*[asked[c] for c in (*UPLOAD, "part_number")], F.col("data").alias("body"), "read"))
        done = self.upload_parts(rows.where("read = 'ok'").drop("read"), now_us)
        return done.unionByName(rows.where("read <> 'ok'").select(*UPLOAD, "part_number", F.col("read").alias("status")))

    def complete_uploads(self, asked: DataFrame, now_us: int) -> DataFrame:
        """API18: (bucket, upload_id, key) -> status; completed uploads become objects, and they and their parts go."""
        done = self._stage(multipart.finish(self.store.read("multipart_uploads"), self.store.read("parts"), asked))
        fine = done.where("status = 'ok'")
        none = F.array().cast("array<string>")
        self._commit(fine.select(*OBJECT, F.coalesce("blocks", none).alias("blocks"), F.coalesce("size", F.lit(0).cast("bigint")).alias("size"), F.coalesce("etag", F.concat(F.md5(F.lit(b"")), F.lit("-0"))).alias("etag")), now_us)
        self.abort_uploads(fine)
        return done.select(*UPLOAD, "key", "status")

    def abort_uploads(self, asked: DataFrame) -> None:
        """API19, DML16."""
        for name in ("multipart_uploads", "parts"):
            self.store.write(name, lww.remove(self.store.read(name), asked, UPLOAD))
