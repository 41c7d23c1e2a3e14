"""The object-store model as views over the provided tables; nothing is materialised."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import digest


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts).cast("bigint")


def objects(spark: SparkSession, sf: str) -> DataFrame:
    d = raw(spark, sf, "documents")
    key = F.concat(F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return d.select(F.col("source").alias("bucket"), key.alias("key"), F.octet_length("text").cast("bigint").alias("size"), F.md5("text").alias("etag"), (F.col("doc_id") * 1000).alias("updated_at"), (F.col("doc_id") % 10 == 0).alias("deleted"))


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    d = raw(spark, sf, "documents")
    return d.select("doc_id", F.encode("text", "UTF-8").alias("body"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    p = raw(spark, sf, "pages")
    host, path = F.regexp_extract("url", "^https?://([^/]+)/", 1), F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1)
    return p.select(host.alias("bucket"), path.alias("key"), F.octet_length("html").cast("bigint").alias("size"), F.md5("html").alias("etag"), (F.col("page_id") * 1000).alias("updated_at"), F.lit(False).alias("deleted"))


def puts(spark: SparkSession, sf: str) -> DataFrame:
    """Versioned puts and tombstones: line items with one key more than once."""
    li = raw(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", micros(F.col("l_shipdate")).alias("ts"), "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("deleted"))


def block_hash(part: Column, supplier: Column) -> Column:
    """A line item's block: its part and supplier."""
    return digest(F.concat_ws("-", part.cast("string"), supplier.cast("string")))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "lineitem").withColumn("hash", block_hash(F.col("l_partkey"), F.col("l_suppkey")))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).groupBy("hash").agg(F.max(F.col("l_quantity").cast("bigint")).alias("size"))


def locations(spark: SparkSession, sf: str) -> DataFrame:
    site = F.concat(F.lit("site-"), F.col("l_linenumber").cast("string"))
    return _lines(spark, sf).select("hash", site.alias("location_id")).distinct()


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as an object of its lines' blocks (bucket, key, blocks, deleted). An order with a returned line is
    deleted, so blocks that only such orders have are orphans."""
    lists = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "hash")))
    made = _lines(spark, sf).groupBy("l_orderkey").agg(lists.alias("e"), F.max("l_returnflag").alias("flag"))
    return made.select(F.lit("orders").alias("bucket"), F.col("l_orderkey").cast("string").alias("key"), F.transform("e", lambda x: x["hash"]).alias("blocks"), (F.col("flag") == "R").alias("deleted"))


def staged_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of uploads in progress: the blocks of untaxed lines."""
    return _lines(spark, sf).where("l_tax = 0").select(F.array("hash").alias("blocks"))


def pending(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks marked for deletion: those of lines sold at full price, and their suppliers' next ones, which nobody holds."""
    marked = raw(spark, sf, "lineitem").where("l_discount = 0")
    supplier = F.explode(F.array(F.col("l_suppkey"), -F.col("l_suppkey")))
    each = marked.select("l_partkey", supplier.alias("s"), (F.col("l_quantity").cast("bigint") * 40_000).alias("at"))
    return each.groupBy(block_hash(F.col("l_partkey"), F.col("s")).alias("hash")).agg(F.min("at").alias("not_before_ms"))


def part_hash(key: Column) -> Column:
    return digest(key.cast("string"))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    o = raw(spark, sf, "orders")
    at = F.floor(micros(F.col("o_orderdate")) / 1000).cast("bigint")
    attempts = (F.col("o_orderkey") % 13).cast("int")
    return o.select(F.concat(F.lit("site-"), (F.col("o_custkey") % 3).cast("string")).alias("target"), part_hash(F.col("o_orderkey")).alias("hash"), (at + attempts * 60000).alias("next_attempt_at"), attempts.alias("attempts"), at.alias("enqueued_at"))


def upload_parts(spark: SparkSession, sf: str) -> DataFrame:
    c = raw(spark, sf, "conversations")
    text = F.coalesce("text", F.lit(""))
    return c.select(F.lit("chat").alias("bucket"), F.col("conv_id").cast("string").alias("upload_id"), F.col("turn").cast("int").alias("part_number"), F.array(digest(text)).alias("blocks"), F.octet_length(text).cast("bigint").alias("size"), F.md5(text).alias("etag"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    e = raw(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "object_delete").otherwise("object_put")
    return e.select(F.col("event_id").alias("seq"), micros(F.col("ts")).alias("ts"), F.concat(F.lit("site-"), (F.col("event_id") % 3).cast("string")).alias("origin"), kind.alias("kind"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), "value")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "supplier").select(F.concat(F.lit("site-"), F.col("s_suppkey").cast("string")).alias("location_id"), F.col("s_name").alias("api_url"))
