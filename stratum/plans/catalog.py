"""Queries by name over the provided tables, each beside its SQL. Comments name the operators of the survey."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import policy, scalar
from ..operators import chunking, gc, listing, lww, multipart, ranges, replication, site, usage
from ..sources import views
from ..sources.store import ParquetBlobs, Store
from ..streaming import facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW, GRACE, SITE = 1_000_000, 300_000, "site-1"
PEERS = ["site-2", "site-3", "site-4"]

# ---- the model in SQL ------------------------------------------------------------------------------------------------
_CTE = {
    "objects": "SELECT source AS bucket, lang || '/' || lpad(doc_id::VARCHAR, 8, '0') AS key, strlen(text)::BIGINT AS size, md5(text) AS etag, doc_id * 1000 AS updated_at, doc_id % 10 = 0 AS deleted FROM documents",
    "webpages": "SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS bucket, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS key, strlen(html)::BIGINT AS size FROM pages",
    "puts": "SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate)::BIGINT AS ts, l_partkey, l_suppkey, l_returnflag = 'R' AS deleted FROM lineitem",
    "lines": "SELECT *, sha256(l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR) AS hash FROM lineitem",
    "blocks": "SELECT hash, max(l_quantity::BIGINT) AS size FROM lines GROUP BY hash",
    "locations": "SELECT DISTINCT hash, 'site-' || l_linenumber::VARCHAR AS location_id FROM lines",
    "manifests": "SELECT l_orderkey, max(l_returnflag) = 'R' AS deleted FROM lines GROUP BY 1",
    "live": "SELECT DISTINCT hash FROM lines JOIN manifests USING (l_orderkey) WHERE NOT deleted UNION SELECT hash FROM lines WHERE l_tax = 0",
    "pending": "SELECT sha256(l_partkey::VARCHAR || '-' || s::VARCHAR) AS hash, min(l_quantity::BIGINT * 40000) AS not_before_ms FROM (SELECT l_partkey, unnest([l_suppkey, -l_suppkey]) AS s, l_quantity FROM lineitem WHERE l_discount = 0) GROUP BY 1",
    "held": "SELECT hash FROM locations WHERE location_id = 'site-1'",
    "queue": "SELECT 'site-' || (o_custkey % 3)::VARCHAR AS target, sha256(o_orderkey::VARCHAR) AS hash, (epoch_us(o_orderdate) // 1000 + (o_orderkey % 13) * 60000)::BIGINT AS next_attempt_at, (o_orderkey % 13)::INTEGER AS attempts, (epoch_us(o_orderdate) // 1000)::BIGINT AS enqueued_at FROM orders",
    "parts": "SELECT conv_id::VARCHAR AS upload_id, turn::INTEGER AS part_number, strlen(coalesce(text, ''))::BIGINT AS size, md5(coalesce(text, '')) AS etag FROM conversations",
    "facts": "SELECT event_id AS seq, epoch_us(ts)::BIGINT AS ts, 'site-' || (event_id % 3)::VARCHAR AS origin, CASE WHEN event_type = 'error' THEN 'object_delete' ELSE 'object_put' END AS kind, 'user/' || user_id::VARCHAR AS key, value FROM events",
    "nodes": "SELECT 'site-' || s_suppkey::VARCHAR AS location_id, s_name AS api_url FROM supplier",
    "pieces": "SELECT doc_id, (o // 1024)::INTEGER AS pos, encode(text)[o + 1 : o + 1024] AS data FROM (SELECT doc_id, text, unnest(range(0, strlen(text), 1024)) AS o FROM documents)",
    "chunks": "SELECT doc_id, pos, sha256(data) AS hash, octet_length(data)::BIGINT AS size FROM pieces",
}
_NEEDS = {"blocks": ["lines"], "locations": ["lines"], "manifests": ["lines"], "live": ["lines", "manifests"], "held": ["lines", "locations"], "chunks": ["pieces"]}


def _with(names: str, body: str) -> str:
    order: list[str] = []
    for n in names.split():
        for k in [*_NEEDS.get(n, []), n]:
            if k not in order:
                order.append(k)
    return "WITH " + ", ".join(f"{k} AS ({_CTE[k]})" for k in order) + " " + body


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- last write wins: WIN1, FLT1, FLT14, DML1-DML9, JN12, Q1 -----------------------------------------------------------
_KEY = ["l_orderkey", "l_linenumber"]


def _arrival():
    return F.col("l_partkey") * 100_000 + F.col("l_suppkey")


_WIN = "SELECT * FROM puts QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ts DESC, l_partkey * 100000 + l_suppkey) = 1"


@query(_with("puts", _WIN))
def lww_latest(spark, sf):
    return lww.winners(views.puts(spark, sf), _KEY, "ts", _arrival())


@query(_with("puts", f"SELECT l_orderkey, l_linenumber, ts FROM ({_WIN}) WHERE NOT deleted"))
def lww_live_only(spark, sf):
    return lww.live(lww.winners(views.puts(spark, sf), _KEY, "ts", _arrival())).select(*_KEY, "ts")


@query(_with("puts", f"SELECT count(*) FILTER (WHERE deleted)::BIGINT AS tombstones, count(*)::BIGINT AS keys FROM ({_WIN})"))
def lww_tombstone_count(spark, sf):
    won = lww.winners(views.puts(spark, sf), _KEY, "ts", _arrival())
    return won.agg(F.count_if("deleted").alias("tombstones"), F.count("*").alias("keys"))


@query(_with("puts", """, a AS (SELECT *, 0 AS f FROM puts WHERE l_suppkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ts DESC, l_partkey * 100000 + l_suppkey) = 1),
 b AS (SELECT *, 1 AS f FROM puts WHERE l_suppkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ts DESC, l_partkey * 100000 + l_suppkey) = 1)
 SELECT l_orderkey, l_linenumber, ts, l_partkey, l_suppkey, deleted FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ts DESC, f) = 1"""))
def lww_merge_two_sites(spark, sf):
    puts = views.puts(spark, sf)
    a, b = (lww.winners(puts.where(F.col("l_suppkey") % 2 == k), _KEY, "ts", _arrival()) for k in (0, 1))
    return lww.merge(a, b, _KEY, "ts")


@query(_with("puts", "SELECT l_orderkey, l_linenumber, max(ts) AS ts, count(*)::BIGINT AS n FROM (SELECT * FROM puts QUALIFY rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ts DESC) = 1) GROUP BY 1, 2 HAVING count(*) > 1"))
def lww_conflict_audit(spark, sf):
    puts = views.puts(spark, sf)
    times = puts.groupBy(*_KEY, "ts").agg(F.count("*").alias("n"))
    return times.groupBy(*_KEY).agg(F.max("ts").alias("ts"), F.max_by("n", "ts").alias("n")).where("n > 1")


# ---- listing: SRC3, SRC4, SRC12, FLT1-FLT6, ORD1-ORD9, AG1, AG6, SET5, FN12, API3, API8-API14 ------------------------------
@query(_with("objects", "SELECT bucket, min(updated_at) AS created FROM objects WHERE NOT deleted GROUP BY bucket ORDER BY bucket"))
def list_buckets(spark, sf):
    return listing.buckets(views.objects(spark, sf))


def _page_sql(bucket: str, prefix: str, delimiter: str, after: str, n: int, table: str = "objects", live: str = "NOT deleted") -> str:
    rolled = f"CASE WHEN instr(substr(key, {len(prefix) + 1}), '{delimiter}') > 0 THEN substr(key, 1, {len(prefix)} + instr(substr(key, {len(prefix) + 1}), '{delimiter}')) END" if delimiter else "NULL::VARCHAR"
    inner = f"SELECT {rolled} AS p, key, size FROM {table} WHERE {live} AND bucket = '{bucket}' AND starts_with(key, '{prefix}')"
    items = f"SELECT coalesce(p, key) AS item, p IS NOT NULL AS is_prefix, max(CASE WHEN p IS NULL THEN size END) AS size FROM ({inner}) GROUP BY 1, 2"
    if after:
        items = f"SELECT * FROM ({items}) WHERE item > '{after}'"
    ahead = f"SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY item) AS rank FROM (SELECT * FROM ({items}) ORDER BY item LIMIT {n + 1})"
    return f"SELECT item, is_prefix, size, rank::INTEGER AS rank, n > {n} AS is_truncated, CASE WHEN n > {n} THEN max(item) OVER () END AS next_token FROM ({ahead}) WHERE rank <= {n}".replace("max(item) OVER ()", f"(max(CASE WHEN rank <= {n} THEN item END) OVER ())")


_PAGE = ["item", "is_prefix", "size", "rank", "is_truncated", "next_token"]


@query(_with("objects", _page_sql("src1", "", "", "", 10)))
def list_page(spark, sf):
    return listing.page(views.objects(spark, sf), "src1", max_keys=10).select(*_PAGE)


@query(_with("objects", _page_sql("src1", "en/", "", "", 1000)))
def list_prefix(spark, sf):
    return listing.page(views.objects(spark, sf), "src1", prefix="en/").select(*_PAGE)


@query(_with("objects", _page_sql("src1", "en/", "", "en/00000200", 5)))
def list_after(spark, sf):
    return listing.page(views.objects(spark, sf), "src1", prefix="en/", after="en/00000200", max_keys=5).select(*_PAGE)


@query(_with("objects", _page_sql("src1", "", "/", "", 1000)))
def list_delimiter_root(spark, sf):
    return listing.page(views.objects(spark, sf), "src1", delimiter="/").select(*_PAGE)


@query(_with("objects", _page_sql("src1", "en/", "/", "", 1000)))
def list_delimiter_prefix(spark, sf):
    return listing.page(views.objects(spark, sf), "src1", prefix="en/", delimiter="/").select(*_PAGE)


@query(_with("objects", _page_sql("src1", "", "/", "de/", 1)))
def list_delimiter_truncated(spark, sf):
    return listing.page(views.objects(spark, sf), "src1", delimiter="/", after="de/", max_keys=1).select(*_PAGE)


@query(_with("webpages", "SELECT DISTINCT bucket, CASE WHEN instr(key, '/') > 0 THEN substr(key, 1, instr(key, '/')) ELSE key END AS item, instr(key, '/') > 0 AS is_prefix FROM webpages"))
def list_pages_rollup(spark, sf):
    return listing.items(views.pages(spark, sf), delimiter="/").select("bucket", "item", "is_prefix")


@query(_with("objects", "SELECT bucket, key AS item, (row_number() OVER (PARTITION BY bucket ORDER BY key) - 1) // 7 AS page FROM objects WHERE NOT deleted"))
def list_all_pages(spark, sf):
    return listing.pages(views.objects(spark, sf), 7).select("bucket", "item", "page")


@query(_with("objects", "SELECT bucket, key, 'null' AS version_id, true AS is_latest, size, etag, updated_at FROM objects WHERE NOT deleted"))
def list_versions(spark, sf):
    return listing.versions(views.objects(spark, sf))


@query(_with("objects", "SELECT bucket, key, size, etag, updated_at FROM objects WHERE NOT deleted AND bucket = 'src1' AND key = 'en/00000001'"))
def head_object(spark, sf):
    return listing.head(views.objects(spark, sf), "src1", "en/00000001").select("bucket", "key", "size", "etag", "updated_at")


@query(_with("parts", "SELECT part_number, size, etag, n > 4 AS is_truncated FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY part_number) AS r FROM parts WHERE upload_id = '3' AND part_number > 1) WHERE r <= 4"))
def list_parts(spark, sf):
    return listing.parts(views.upload_parts(spark, sf), "chat", "3", 1, 4).select("part_number", "size", "etag", "is_truncated")


def _uploads(spark, sf):
    return views.raw(spark, sf, "conversations").where("turn = 0").select(F.lit("chat").alias("bucket"), F.concat(F.col("role"), F.lit("/"), F.col("conv_id").cast("string")).alias("key"), F.col("conv_id").cast("string").alias("upload_id"))


@query("SELECT key, upload_id, n > 20 AS is_truncated FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY key, upload_id) AS r FROM (SELECT role || '/' || conv_id::VARCHAR AS key, conv_id::VARCHAR AS upload_id FROM conversations WHERE turn = 0) WHERE key ILIKE 'USER/%' AND key > 'user/2') WHERE r <= 20")
def list_uploads(spark, sf):
    return listing.uploads(_uploads(spark, sf), "chat", "USER/", "user/2", 20, like=True).select("key", "upload_id", "is_truncated")


# ---- chunks: CH1-CH7, JN10, AG7, FN1, FN4, FN6, FN21 ------------------------------------------------------------------------
def _chunks(spark, sf):
    return chunking.addressed(chunking.fixed(views.bodies(spark, sf), 1024)).drop("data")


@query(_with("chunks", "SELECT doc_id, pos, hash, size FROM chunks"))
def chunk_fixed(spark, sf):
    return _chunks(spark, sf)


@query(_with("chunks", "SELECT doc_id, sha256(string_agg(hash, '' ORDER BY pos)) AS manifest, count(*)::INTEGER AS n_blocks, sum(size)::BIGINT AS size FROM chunks GROUP BY doc_id"))
def chunk_manifest(spark, sf):
    made = chunking.manifests(_chunks(spark, sf), ["doc_id"])
    return made.select("doc_id", F.sha2(F.array_join("blocks", ""), 256).alias("manifest"), F.size("blocks").alias("n_blocks"), "size")


@query(_with("chunks", "SELECT count(*)::BIGINT AS blocks, count(DISTINCT hash)::BIGINT AS distinct_blocks, sum(size)::BIGINT AS bytes FROM chunks"))
def chunk_dedup_ratio(spark, sf):
    each = _chunks(spark, sf).groupBy("hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return each.agg(F.sum("n").alias("blocks"), F.count("*").alias("distinct_blocks"), F.sum("bytes").alias("bytes"))


@query(_with("chunks", "SELECT hash, min(size) AS size, count(*)::BIGINT AS copies FROM chunks WHERE doc_id % 5 = 0 AND hash NOT IN (SELECT hash FROM chunks WHERE doc_id % 5 <> 0) GROUP BY hash"))
def new_blocks_only(spark, sf):
    own = _chunks(spark, sf)
    return chunking.new_blocks(own.where("doc_id % 5 = 0"), own.where("doc_id % 5 <> 0"))


@query("SELECT doc_id, md5(text) AS etag, '\"' || md5(text) || '\"' AS quoted FROM documents")
def etag_md5(spark, sf):
    return views.bodies(spark, sf).select("doc_id", scalar.etag(F.col("body")).alias("etag"), scalar.quoted(scalar.etag(F.col("body"))).alias("quoted"))


@query(_with("chunks", "SELECT DISTINCT hash, substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash AS path FROM chunks"))
def cas_paths(spark, sf):
    return _chunks(spark, sf).select("hash", scalar.cas_path(F.col("hash")).alias("path")).distinct()


@query(_with("chunks", "SELECT doc_id, count(*)::INTEGER AS n, (32 * count(*))::INTEGER AS bytes, true AS same FROM chunks GROUP BY doc_id"))
def pack_blocks(spark, sf):
    made = chunking.manifests(_chunks(spark, sf), ["doc_id"]).withColumn("packed", scalar.pack_blocks(F.col("blocks")))
    return made.select("doc_id", F.size("blocks").alias("n"), F.octet_length("packed").alias("bytes"), (scalar.unpack_blocks(F.col("packed")) == F.col("blocks")).alias("same"))


@query()
def cdc_chunks(spark, sf):
    return chunking.addressed(chunking.content_defined(views.bodies(spark, sf), 512, 1024, 2048)).drop("data")


@query("SELECT doc_id, strlen(text)::BIGINT AS size, md5(text) AS etag, true AS sizes_fit FROM documents WHERE strlen(text) > 0")
def cdc_invariants(spark, sf):
    """What any cut has to keep: chunks join to the body, all but the last have the least size, none has more than the most."""
    made = chunking.content_defined(views.bodies(spark, sf), 512, 1024, 2048)
    whole = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("c"))
    size = lambda c: F.octet_length(c["data"])
    fit = F.forall("c", lambda c: (size(c) <= 2048) & ((size(c) >= 512) | (c["pos"] == F.size("c") - 1)))
    body = F.unhex(F.array_join(F.transform("c", lambda c: F.hex(c["data"])), ""))
    return whole.select("doc_id", F.octet_length(body).cast("bigint").alias("size"), F.md5(body).alias("etag"), fit.alias("sizes_fit"))


# ---- writes that log: DML2, DML3, DML5, API1, API2, API5, SNK3 ---------------------------------------------------------------
def _site(spark, sf):
    """A site into which all documents have been put."""
    store = Store(spark)
    made = site.Site(store, ParquetBlobs(spark, f"{store.root}/blobs"), Config(location_id=SITE, chunk_size=1024))
    made.put(_keyed_bodies(spark, sf), NOW)
    return made


def _keyed_bodies(spark, sf):
    key = F.concat(F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return views.raw(spark, sf, "documents").select(F.col("source").alias("bucket"), key.alias("key"), F.encode("text", "UTF-8").alias("body"))


_KEYED = "SELECT source AS bucket, lang || '/' || lpad(doc_id::VARCHAR, 8, '0') AS key, doc_id, text FROM documents"


@query(_with("chunks", f"SELECT bucket, key, strlen(text)::BIGINT AS size, md5(text) AS etag, coalesce(m, sha256('')) AS manifest, {NOW}::BIGINT AS updated_at, false AS deleted FROM ({_KEYED}) LEFT JOIN (SELECT doc_id, sha256(string_agg(hash, '' ORDER BY pos)) AS m FROM chunks GROUP BY doc_id) USING (doc_id)"))
def put_object(spark, sf):
    rows = _site(spark, sf).store.read("objects")
    return rows.select("bucket", "key", "size", "etag", F.sha2(F.array_join("blocks", ""), 256).alias("manifest"), "updated_at", "deleted")


@query(_with("chunks", f"SELECT 'object_put' AS kind, bucket, key, NULL AS hash, strlen(text)::BIGINT AS size FROM ({_KEYED}) UNION ALL SELECT DISTINCT 'block_announce', NULL, NULL, hash, size FROM chunks"))
def put_object_facts(spark, sf):
    log = _site(spark, sf).store.read("fact_log").withColumn("f", scalar.decode_fact(F.col("payload")))
    return log.select("kind", "f.data.bucket", "f.data.key", "f.data.hash", "f.data.size")


@query(f"SELECT bucket, count(*) FILTER (WHERE NOT starts_with(key, 'en/'))::BIGINT AS live, count(*)::BIGINT AS keys, count(*) FILTER (WHERE starts_with(key, 'en/'))::BIGINT AS logged FROM ({_KEYED}) GROUP BY bucket")
def delete_object(spark, sf):
    made = _site(spark, sf)
    made.delete(_keyed_bodies(spark, sf).where(F.col("key").startswith("en/")), NOW + 1)
    log = made.store.read("fact_log").where("kind = 'object_delete'").withColumn("f", scalar.decode_fact(F.col("payload")))
    logged = log.groupBy(F.col("f.data.bucket").alias("bucket")).agg(F.count("*").alias("logged"))
    rows = made.store.read("objects").groupBy("bucket").agg(F.count_if(~F.col("deleted")).alias("live"), F.count("*").alias("keys"))
    return rows.join(logged, "bucket", "left").select("bucket", "live", "keys", F.coalesce("logged", F.lit(0)).alias("logged"))


@query(f"SELECT bucket, key, 'ok' AS status, md5(encode(text)[1001:2501]) AS etag FROM ({_KEYED}) WHERE strlen(text) > 1000 UNION ALL SELECT bucket, key, 'InvalidRange', NULL FROM ({_KEYED}) WHERE strlen(text) <= 1000")
def get_object(spark, sf):
    asked = _keyed_bodies(spark, sf).select("bucket", "key", F.lit(1000).alias("first"), F.lit(2500).alias("last"), F.lit(None).alias("suffix"))
    return _site(spark, sf).get(asked).select("bucket", "key", "status", F.md5("data").alias("etag"))


# ---- ranges: FN10, FN11, FN14, FN15, WIN2, JN2, JN11, API2, API15 ---------------------------------------------------------------
def _range(spark, sf, first, last, suffix):
    sized = _chunks(spark, sf).select("doc_id", "pos", "hash", "size")
    number = lambda v: F.lit(v).cast("bigint")
    return ranges.plan(sized, ["doc_id"], number(first), number(last), number(suffix)).select("doc_id", "pos", "skip", "take")


def _range_sql(first: str, last: str) -> str:
    bounds = f"SELECT doc_id, pos, size, pos::BIGINT * 1024 AS start, {first} AS a, least({last}, total - 1) AS z FROM (SELECT *, sum(size) OVER (PARTITION BY doc_id) AS total FROM chunks) WHERE {first} < total"
    return _with("chunks", f"SELECT doc_id, pos, greatest(a - start, 0)::BIGINT AS skip, (least(z + 1 - start, size) - greatest(a - start, 0))::BIGINT AS take FROM ({bounds}) WHERE start <= z AND start + size > a")


@query(_range_sql("1000", "2500"))
def range_plan_int(spark, sf):
    return _range(spark, sf, 1000, 2500, None)


@query(_range_sql("greatest(total - 1500, 0)", "total - 1"))
def range_plan_suffix(spark, sf):
    return _range(spark, sf, None, None, 1500)


@query("SELECT doc_id, md5(encode(text)[101:300]) AS etag, 'bytes 100-' || least(299, strlen(text) - 1)::VARCHAR || '/' || strlen(text)::VARCHAR AS content_range FROM documents WHERE strlen(text) > 100")
def range_bytes(spark, sf):
    n = F.octet_length("body").cast("bigint")
    got = views.bodies(spark, sf).withColumn("r", scalar.resolve_range(n, F.lit(100), F.lit(299), F.lit(None).cast("bigint"))).where("r is not null")
    data = scalar.slice_bytes(F.col("body"), F.col("r.first"), F.col("r.last") - F.col("r.first") + 1)
    return got.select("doc_id", F.md5(data).alias("etag"), scalar.content_range(F.col("r.first"), F.col("r.last"), n).alias("content_range"))


# ---- multipart: AG8, API16-API19, DML15, DML16, Q2, Q3 -----------------------------------------------------------------------------
@query(_with("parts", "SELECT upload_id, count(*)::INTEGER AS n_parts, sum(size)::BIGINT AS size, md5(unhex(string_agg(etag, '' ORDER BY part_number))) || '-' || count(*)::VARCHAR AS etag FROM parts GROUP BY upload_id"))
def multipart_complete(spark, sf):
    return multipart.complete(views.upload_parts(spark, sf), ["upload_id"]).select("upload_id", "n_parts", "size", "etag")


@query("SELECT conv_id::VARCHAR AS upload_id, CASE WHEN conv_id % 3 = 0 THEN 'InvalidRequest' WHEN conv_id % 3 = 1 THEN 'ok' ELSE 'NoSuchUpload' END AS status FROM conversations WHERE turn = 0")
def multipart_finish(spark, sf):
    own = views.raw(spark, sf, "conversations").where("turn = 0").select(F.lit("chat").alias("bucket"), F.col("conv_id").cast("string").alias("upload_id"), "conv_id")
    held = own.where("conv_id % 3 < 2").select("bucket", "upload_id", F.when(F.col("conv_id") % 3 == 0, "other").otherwise("k").alias("key"))
    asked = own.select("bucket", "upload_id", F.lit("k").alias("key"))
    return multipart.finish(held, views.upload_parts(spark, sf), asked).select("upload_id", "status")


@query(_with("parts", "SELECT upload_id, part_number FROM parts WHERE upload_id::BIGINT % 4 <> 0"))
def multipart_abort(spark, sf):
    rows = views.upload_parts(spark, sf)
    return lww.remove(rows, rows.where(F.col("upload_id").cast("bigint") % 4 == 0), ["bucket", "upload_id"]).select("upload_id", "part_number")


# ---- garbage collection: GC1-GC8, JN3-JN6, SET1-SET3, AG4, AG5, SRC5-SRC7, DML13, DML14, Q9 -------------------------------------------
def _gc(spark, sf):
    alive = gc.live_set(views.manifests(spark, sf), views.staged_parts(spark, sf))
    return views.locations(spark, sf).where(F.col("location_id") == SITE).select("hash"), alive, views.pending(spark, sf)


def _gc_sql(force: bool) -> str:
    due = "true" if force else f"{NOW} >= coalesce(not_before_ms, {NOW + GRACE})"
    return _with("locations held live pending", f", j AS (SELECT coalesce(h.hash, p.hash) AS hash, h.hash IS NOT NULL AS here, l.hash IS NOT NULL AS alive, not_before_ms FROM (held h LEFT JOIN live l ON h.hash = l.hash) FULL JOIN pending p ON h.hash = p.hash) SELECT hash, CASE WHEN NOT here THEN 'drop_stale' WHEN alive AND not_before_ms IS NOT NULL THEN 'cancel' WHEN alive THEN 'keep' WHEN {due} THEN 'reap' WHEN not_before_ms IS NULL THEN 'mark' ELSE 'wait' END AS action, CASE WHEN here AND NOT alive THEN coalesce(not_before_ms, {NOW + GRACE})::BIGINT END AS reap_at FROM j")


@query(_with("live", "SELECT hash FROM live"))
def live_block_set(spark, sf):
    return _gc(spark, sf)[1]


@query(_with("held live", "SELECT hash FROM held EXCEPT SELECT hash FROM live"))
def orphan_blocks(spark, sf):
    local, alive, _ = _gc(spark, sf)
    return local.join(alive, "hash", "left_anti").distinct()


@query(_gc_sql(False))
def gc_decisions(spark, sf):
    return gc.decide(*_gc(spark, sf), NOW, GRACE)


@query(_gc_sql(True))
def gc_forced(spark, sf):
    return gc.decide(*_gc(spark, sf), NOW, GRACE, force=True)


@query(_with("pending held", "SELECT hash FROM pending EXCEPT SELECT hash FROM held"))
def gc_stale_pending(spark, sf):
    return gc.decide(*_gc(spark, sf), NOW, GRACE).where("action = 'drop_stale'").select("hash")


@query(_with("locations held live blocks", "SELECT hash, size FROM blocks WHERE hash NOT IN (SELECT hash FROM held EXCEPT SELECT hash FROM live) OR hash IN (SELECT hash FROM locations WHERE location_id <> 'site-1')"))
def gc_sweep_blocks(spark, sf):
    local, alive, due = _gc(spark, sf)
    after = gc.sweep(gc.decide(local, alive, due, NOW, GRACE, True), views.locations(spark, sf), views.blocks(spark, sf), due, SITE)
    return after["blocks"].select("hash", "size")


@query(_with("locations", "SELECT hash, count(*)::BIGINT AS copies FROM locations GROUP BY hash HAVING count(*) = 1"))
def last_copy_blocks(spark, sf):
    return gc.copies(views.locations(spark, sf)).where("copies = 1")


@query(_with("locations live", "SELECT hash, count(*)::BIGINT AS copies FROM locations WHERE location_id <> 'site-1' AND hash NOT IN (SELECT hash FROM live) GROUP BY hash"))
def stale_holders(spark, sf):
    alive = _gc(spark, sf)[1]
    return gc.copies(views.locations(spark, sf).where(F.col("location_id") != SITE).join(alive, "hash", "left_anti"))


# ---- usage: AG2, AG3, AG10, JN1, FLT13, FN7, FN8, API21, API24 -----------------------------------------------------------------------
@query(_with("held blocks", "SELECT coalesce(sum(size), 0)::BIGINT AS bytes FROM held JOIN blocks USING (hash)"))
def local_block_bytes(spark, sf):
    return usage.local_bytes(views.locations(spark, sf), views.blocks(spark, sf), SITE)


@query(_with("objects held pending facts queue", "SELECT 'objects' AS metric, count(*)::BIGINT AS n FROM objects WHERE NOT deleted UNION ALL SELECT 'local_blocks', count(*) FROM held UNION ALL SELECT 'pending_deletions', count(*) FROM pending UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'pending_pulls', count(*) FROM queue WHERE target = 'site-1'"))
def site_stats(spark, sf):
    local = views.locations(spark, sf).where(F.col("location_id") == SITE)
    return usage.counts(objects=lww.live(views.objects(spark, sf)), local_blocks=local, pending_deletions=views.pending(spark, sf), facts=views.facts(spark, sf), pending_pulls=views.queue(spark, sf).where(F.col("target") == SITE))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'LowFreeSpace' WHEN p_partkey % 100 >= 90 THEN 'OverQuota' END AS trip FROM part")
def quota_guard(spark, sf):
    return views.raw(spark, sf, "part").select("p_partkey", usage.guard(F.col("p_size"), F.col("p_partkey") % 100, F.lit(10), F.lit(90)).alias("trip"))


@query("SELECT n, CASE WHEN n < 1024 THEN n::VARCHAR || 'B' WHEN n < 1048576 THEN printf('%.1fKi', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1fMi', n / 1048576.0) ELSE printf('%.1fGi', n / 1073741824.0) END AS text FROM (SELECT DISTINCT o_custkey * o_custkey * 7 AS n FROM orders)")
def size_format(spark, sf):
    n = views.raw(spark, sf, "orders").select((F.col("o_custkey") * F.col("o_custkey") * 7).alias("n")).distinct()
    return n.select("n", scalar.format_bytes(F.col("n"), ("Ki", "Mi", "Gi")).alias("text"))


@query("SELECT text, (regexp_extract(text, '^([0-9.]+)', 1)::DOUBLE * CASE lower(regexp_extract(text, '([A-Za-z]*)$', 1)) WHEN 'ki' THEN 1024.0 WHEN 'mi' THEN 1048576.0 WHEN 'gi' THEN 1073741824.0 WHEN 'kb' THEN 1000.0 WHEN 'm' THEN 1000000.0 WHEN '' THEN 1.0 END)::BIGINT AS bytes FROM (SELECT DISTINCT p_size::VARCHAR || CASE p_size % 6 WHEN 0 THEN 'Ki' WHEN 1 THEN 'Mi' WHEN 2 THEN 'gi' WHEN 3 THEN 'KB' WHEN 4 THEN 'M' ELSE 'Xy' END AS text FROM part)")
def size_parse(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("Ki", "Mi", "gi", "KB", "M", "Xy"))), F.col("p_size") % 6 + 1)
    text = views.raw(spark, sf, "part").select(F.concat(F.col("p_size").cast("string"), unit).alias("text")).distinct()
    return text.select("text", scalar.parse_size(F.col("text")).alias("bytes"))


# ---- replication: FLT7-FLT9, ST4, ST8-ST12, FN9, AG11, AG12, JN7-JN9, SRC10, ORD5, DML10-DML12 ---------------------------------------------
_WHEN = 800_000_000_000


@query(_with("queue", f"SELECT target, hash, next_attempt_at, attempts FROM queue WHERE target = 'site-1' AND next_attempt_at <= {_WHEN} ORDER BY next_attempt_at, hash LIMIT 500"))
def replication_ready(spark, sf):
    return replication.ready(views.queue(spark, sf), SITE, _WHEN).select("target", "hash", "next_attempt_at", "attempts")


def _wanted(spark, sf):
    """Every second line's block, and one beside it that nobody may hold."""
    pair = F.explode(F.array(F.col("l_suppkey"), F.col("l_suppkey") + 1))
    each = views.raw(spark, sf, "lineitem").select("l_partkey", pair.alias("s"))
    return each.select(F.lit(SITE).alias("target"), views.block_hash(F.col("l_partkey"), F.col("s")).alias("hash")).distinct()


@query(_with("locations", "SELECT q.hash, CASE WHEN h IS NULL OR list_contains(h, 'site-1') THEN 'drop' WHEN list_has_any(h, ['site-2', 'site-3', 'site-4']) THEN 'fetch' ELSE 'defer' END AS action, coalesce(list_has_any(h, ['site-2', 'site-3', 'site-4']), false) AS any_holder_live, CASE WHEN h IS NULL OR list_contains(h, 'site-1') THEN '' ELSE array_to_string(list_sort(list_intersect(h, ['site-2', 'site-3', 'site-4'])), ',') END AS sources FROM (SELECT DISTINCT sha256(l_partkey::VARCHAR || '-' || s::VARCHAR) AS hash FROM (SELECT l_partkey, unnest([l_suppkey, l_suppkey + 1]) AS s FROM lineitem)) q LEFT JOIN (SELECT hash, list(location_id ORDER BY location_id) AS h FROM locations GROUP BY hash) USING (hash)"))
def replication_plan(spark, sf):
    planned = replication.plan(_wanted(spark, sf), views.locations(spark, sf), PEERS, SITE)
    return planned.select("hash", "action", "any_holder_live", F.array_join("sources", ",").alias("sources"))


@query(_with("queue", "SELECT attempts, least(60000 * pow(2, attempts), 21600000)::BIGINT AS backoff_ms, count(*)::BIGINT AS n FROM queue GROUP BY 1, 2"))
def replication_backoff(spark, sf):
    return views.queue(spark, sf).groupBy("attempts", scalar.backoff_ms(F.col("attempts")).alias("backoff_ms")).agg(F.count("*").alias("n"))


@query(_with("queue", "SELECT target, hash, attempts FROM queue WHERE attempts >= 10"))
def replication_stuck(spark, sf):
    return replication.stuck(views.queue(spark, sf)).select("target", "hash", "attempts")


@query(_with("queue", f"SELECT target, hash, CASE WHEN target = 'site-1' THEN {_WHEN} + least(60000 * pow(2, attempts), 21600000)::BIGINT ELSE next_attempt_at END AS next_attempt_at, (attempts + CASE WHEN target = 'site-1' THEN 1 ELSE 0 END)::INTEGER AS attempts FROM queue"))
def queue_defer(spark, sf):
    rows = views.queue(spark, sf)
    return replication.defer(rows, rows.where("target = 'site-1'"), _WHEN).select("target", "hash", "next_attempt_at", "attempts")


@query(_with("locations held", "SELECT DISTINCT hash FROM locations WHERE location_id = 'site-2' AND hash NOT IN (SELECT hash FROM held)"))
def queue_enqueue(spark, sf):
    spots = views.locations(spark, sf)
    return replication.to_enqueue(spots.where("location_id = 'site-2'"), spots, SITE, NOW).select("hash")


@query(_with("locations", "SELECT hash, array_to_string(list(location_id ORDER BY location_id), ',') AS holders FROM locations GROUP BY hash"))
def holder_map(spark, sf):
    return replication.holders(views.locations(spark, sf)).select("hash", F.array_join("holders", ",").alias("holders"))


@query(_with("locations", "SELECT hash, count(*)::BIGINT AS copies FROM locations GROUP BY hash HAVING count(*) < 3"))
def under_replicated_blocks(spark, sf):
    return gc.copies(views.locations(spark, sf)).where("copies < 3")


@query(_with("nodes facts", "SELECT location_id, api_url, coalesce(last_seq, 0)::BIGINT AS last_seq FROM nodes LEFT JOIN (SELECT origin, max(seq) AS last_seq FROM facts GROUP BY origin) ON location_id = origin WHERE location_id <> 'site-1'"))
def peer_cursors(spark, sf):
    seen = views.facts(spark, sf).groupBy(F.col("origin").alias("peer")).agg(F.max("seq").alias("last_seq"))
    return replication.cursors(replication.peers(views.nodes(spark, sf), SITE), seen)


@query("WITH RECURSIVE edges AS (SELECT n_nationkey AS src, (n_nationkey + n_regionkey + 1) % 25 AS dst FROM nation), known AS (SELECT src, dst FROM edges UNION SELECT k.src, e.dst FROM known k JOIN edges e ON k.dst = e.src) SELECT DISTINCT src::INTEGER AS src, dst::INTEGER AS dst FROM known")
def gossip_closure(spark, sf):
    n = views.raw(spark, sf, "nation")
    return replication.known_from(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + F.col("n_regionkey") + 1) % 25).cast("int").alias("dst")))


@query("SELECT event_id, user_id, up FROM (SELECT event_id, user_id, event_type <> 'error' AS up, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> up")
def link_state_changes(spark, sf):
    e = views.raw(spark, sf, "events").select("event_id", "user_id", "event_type")
    return replication.link_changes(e, "user_id", "event_id", F.col("event_type") != "error").select("event_id", "user_id", "up")


# ---- facts: SRC8, ORD4, AG9, ST1-ST6 ----------------------------------------------------------------------------------------------------------
@query(_with("facts", "SELECT seq, ts, kind, key FROM facts WHERE seq > 100 ORDER BY seq LIMIT 500"))
def facts_page(spark, sf):
    return facts.page(views.facts(spark, sf), 100).select("seq", "ts", "kind", "key")


@query(_with("facts", "SELECT origin, kind, count(*)::BIGINT AS n, max(seq) AS last_seq FROM facts GROUP BY 1, 2"))
def facts_by_kind(spark, sf):
    return views.facts(spark, sf).groupBy("origin", "kind").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


_LAST = "SELECT key, seq, ts, kind FROM facts QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) = 1"


@query(_with("facts", _LAST))
def events_lww_stream(spark, sf):
    path = f"{sf}/events.parquet"
    shape = lambda df: df.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), views.micros(F.col("ts")).alias("ts"), F.when(F.col("event_type") == "error", "object_delete").otherwise("object_put").alias("kind"))
    # a pattern, so that one file is as good as a folder of them
    return facts.latest_of_stream(spark, f"{sf}/event[s].parquet", spark.read.parquet(path).schema, shape, ["key"], "ts", "seq")


# ---- policy: FLT11, FLT12, UD1, API20, API25, FN16, SRC13 --------------------------------------------------------------------------------------------
_ACTIONS = ("s3:GetObject", "s3:HeadObject", "s3:PutObject", "s3:DeleteObject", "s3:ListBucket", "s3:ListAllMyBuckets", "s3:CreateBucket", "s3:DeleteBucket", "s3:AbortMultipartUpload", "s3:ListMultipartUploadParts", "s3:ListBucketMultipartUploads", "s3:PutBucketPolicy")
_ASKED = f"(SELECT unnest({list(_ACTIONS)}) AS action)"


def _asked(spark, sf):
    c = views.raw(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("b"), (F.col("c_nationkey") % 3).cast("string")).alias("bucket"))
    return c.withColumn("action", F.explode(F.array(*map(F.lit, _ACTIONS)))).withColumn("resource", scalar.arn(F.col("bucket"), F.lit("k")))


@query(f"SELECT c_custkey, action, CASE WHEN action = 's3:DeleteObject' THEN false WHEN c_mktsegment = 'BUILDING' THEN true WHEN starts_with(action, 's3:Get') THEN c_nationkey % 3 = 1 ELSE false END AS allowed FROM customer, {_ASKED}")
def policy_eval(spark, sf):
    rule = lambda effect, action, resource: F.struct(F.lit(effect).alias("effect"), F.array(action).alias("actions"), F.array(resource).alias("resources"))
    action = F.when(F.col("c_mktsegment") == "BUILDING", "*").otherwise("s3:Get*")
    resource = F.when(F.col("c_mktsegment") == "BUILDING", "*").otherwise("arn:ss:bucket:::b1*")
    own = F.struct(F.array(rule("Allow", action, resource), rule("Deny", F.lit("s3:DeleteObject"), F.lit("*"))).alias("statements"))
    return _asked(spark, sf).select("c_custkey", "action", policy.allowed(own, F.col("action"), F.col("resource")).alias("allowed"))


@query(f"SELECT c_custkey, action, c_mktsegment = 'BUILDING' OR action IN ('s3:GetObject', 's3:HeadObject', 's3:ListBucket', 's3:ListAllMyBuckets', 's3:ListMultipartUploadParts', 's3:ListBucketMultipartUploads') OR (c_mktsegment = 'MACHINERY' AND action <> 's3:PutBucketPolicy') AS allowed FROM customer, {_ASKED}")
def policy_presets(spark, sf):
    own = F.when(F.col("c_mktsegment") == "BUILDING", policy.preset("admin")).when(F.col("c_mktsegment") == "MACHINERY", policy.preset("readwrite")).otherwise(policy.preset("readonly"))
    return _asked(spark, sf).select("c_custkey", "action", policy.allowed(own, F.col("action"), F.col("resource")).alias("allowed"))


# ---- the rest: FN2, FN17, FN20, API5-API7, API12, DML3, DML16 --------------------------------------------------------------------------------------------
@query(_with("objects", "SELECT (('0x' || substr(sha256(key), 1, 2))::INTEGER & 63)::INTEGER AS shard_id, count(*)::BIGINT AS n FROM objects GROUP BY 1"))
def shard_distribution(spark, sf):
    return views.objects(spark, sf).groupBy(scalar.shard_id(F.col("key")).alias("shard_id")).agg(F.count("*").alias("n"))


@query("SELECT page_id, url_decode(replace(replace(p[:instr(p, '=') - 1], '%zz', '%25zz'), '+', ' ')) AS name, url_decode(replace(replace(p[instr(p, '=') + 1:], '%zz', '%25zz'), '+', ' ')) AS value FROM (SELECT page_id, unnest(string_split(CASE WHEN contains(url, '?') THEN split_part(split_part(url, '?', 2), '#', 1) ELSE '' END || '&flag&&a+b=x%zz+%C3%A9=' || page_id::VARCHAR || '%26&empty=', '&')) AS p FROM pages) WHERE contains(p, '=')")
def url_query(spark, sf):
    p = views.raw(spark, sf, "pages")
    own = F.when(F.col("url").contains("?"), F.split(F.split("url", "[?]", 2)[1], "#", 2)[0]).otherwise("")
    # pairs without a value, without a sign, and with malformed escapes, too
    text = F.concat(own, F.lit("&flag&&a+b=x%zz+%C3%A9="), F.col("page_id").cast("string"), F.lit("%26&empty="))
    return p.select("page_id", F.explode(scalar.query_pairs(text)).alias("q")).select("page_id", F.col("q.key").alias("name"), "q.value")


@query("SELECT event_id, CASE WHEN abs(v - 5) > 10 THEN v ELSE 5 END::BIGINT AS offset_ms FROM (SELECT event_id, event_id % 40 + (event_id % 7) // 2 - 20 AS v FROM events)")
def clock_offset(spark, sf):
    e = views.raw(spark, sf, "events")
    return e.select("event_id", scalar.clock_offset_ms(F.lit(5), F.col("event_id") % 40, F.col("event_id") % 7, F.lit(20)).cast("bigint").alias("offset_ms"))


@query(_with("objects", "SELECT 'copy' AS bucket, key, size, etag, 99000000::BIGINT AS updated_at FROM objects WHERE NOT deleted AND bucket = 'src1'"))
def copy_object(spark, sf):
    source = lww.live(views.objects(spark, sf)).where("bucket = 'src1'")
    copied = source.withColumns({"bucket": F.lit("copy"), "updated_at": F.lit(99_000_000).cast("bigint")})
    merged = lww.merge(views.objects(spark, sf), copied, ["bucket", "key"], "updated_at")
    return merged.where("bucket = 'copy'").select("bucket", "key", "size", "etag", "updated_at")


@query(_with("objects", "SELECT bucket, count(*) FILTER (WHERE NOT deleted AND NOT starts_with(key, 'en/'))::BIGINT AS live, count(*)::BIGINT AS keys FROM objects GROUP BY bucket"))
def delete_batch(spark, sf):
    own = views.objects(spark, sf)
    gone = lww.tombstone(own.where(F.col("key").startswith("en/")).select("bucket", "key"), F.lit(10**12), own)
    after = lww.merge(own, gone, ["bucket", "key"], "updated_at")
    return after.groupBy("bucket").agg(F.count_if(~F.col("deleted")).alias("live"), F.count("*").alias("keys"))




# ---- single steps: SRC10, AG11, AG12, JN2, JN14, FN15, FN18, FN22, DML4, DML8-DML11, DML13, DML15, ST2, ST3, ST8, GC8, API10, API12, API16-API20 ----
@query(_with("locations", "SELECT hash, string_agg(location_id || '=' || location_id || '/' || hash, ',' ORDER BY location_id) AS fids FROM locations GROUP BY hash"))
def fid_map(spark, sf):
    spots = views.locations(spark, sf).withColumn("fid", F.concat_ws("/", "location_id", "hash"))
    pairs = F.transform(F.map_entries("fids"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return replication.fids(spots).select("hash", F.array_join(pairs, ",").alias("fids"))


@query(_with("locations", "SELECT hash, location_id || '/' || hash AS fid FROM locations WHERE location_id = 'site-1'"))
def local_fids(spark, sf):
    return replication.local_fid(views.locations(spark, sf).withColumn("fid", F.concat_ws("/", "location_id", "hash")), SITE)


@query(_with("lines blocks", "SELECT l_orderkey::VARCHAR AS key, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l.hash) - 1)::INTEGER AS pos, CASE WHEN b.size > 25 THEN 0 ELSE b.size END AS size FROM lines l JOIN blocks b ON l.hash = b.hash"))
def block_sizes(spark, sf):
    """Sizes in the manifests' order; blocks of more than 25 aren't known here."""
    known = views.blocks(spark, sf).where("size <= 25")
    return ranges.sized_blocks(views.manifests(spark, sf), known, ["key"]).select("key", "pos", "size")


@query("SELECT o_orderkey, CASE WHEN a <= b AND o_orderkey % 5 > 0 THEN a END AS first, CASE WHEN a <= b AND o_orderkey % 5 > 0 THEN b END AS last FROM (SELECT o_orderkey, o_custkey % 50 AS a, o_orderkey % 60 AS b FROM orders)")
def copy_ranges(spark, sf):
    """Every fifth text has no end, some are reversed."""
    end = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise((F.col("o_orderkey") % 60).cast("string"))
    text = F.concat(F.lit("bytes="), (F.col("o_custkey") % 50).cast("string"), F.lit("-"), end)
    return views.raw(spark, sf, "orders").select("o_orderkey", scalar.copy_range(text).alias("r")).select("o_orderkey", "r.first", "r.last")


@query(_with("objects", "SELECT bucket, greatest(min(updated_at) - 5000, 0)::BIGINT AS created FROM objects WHERE NOT deleted GROUP BY bucket"))
def bucket_created(spark, sf):
    return listing.buckets(views.objects(spark, sf)).select("bucket", F.unix_micros(scalar.created_at(F.col("created") - 5000)).alias("created"))


@query(_with("objects", "SELECT 'ObjectPut' AS kind, bucket, key, size, etag, NULL::VARCHAR AS hash FROM objects"))
def fact_roundtrip(spark, sf):
    text = scalar.encode_fact(F.lit("ObjectPut"), F.struct("bucket", "key", "size", "etag"))
    return views.objects(spark, sf).select(scalar.decode_fact(text).alias("f")).select("f.kind", "f.data.bucket", "f.data.key", "f.data.size", "f.data.etag", "f.data.hash")


@query(_with("lines", "SELECT hash, 'site-' || l_linenumber::VARCHAR AS location_id, max(epoch_us(l_shipdate))::BIGINT AS updated_at FROM lines GROUP BY 1, 2"))
def location_upsert(spark, sf):
    rows = views.raw(spark, sf, "lineitem").select(views.block_hash(F.col("l_partkey"), F.col("l_suppkey")).alias("hash"), F.concat(F.lit("site-"), F.col("l_linenumber").cast("string")).alias("location_id"), views.micros(F.col("l_shipdate")).alias("updated_at"), "l_linestatus")
    held, told = rows.where("l_linestatus = 'F'").drop("l_linestatus"), rows.where("l_linestatus <> 'F'").drop("l_linestatus")
    return lww.merge(lww.merge(held.limit(0), held, ["hash", "location_id"], "updated_at"), told, ["hash", "location_id"], "updated_at")


@query(_with("facts", "SELECT origin AS peer, max(seq) AS last_seq FROM facts GROUP BY 1"))
def cursor_advance(spark, sf):
    """Old news after new ones doesn't move a cursor back."""
    at = lambda kind: views.facts(spark, sf).where(F.col("kind") == kind).groupBy(F.col("origin").alias("peer")).agg(F.max("seq").alias("last_seq"))
    return lww.advance(lww.advance(at("object_put"), at("object_delete")), at("object_delete"))


@query(_with("queue", "SELECT target, hash, CASE WHEN attempts < 6 THEN attempts ELSE 0 END::INTEGER AS attempts FROM queue"))
def queue_insert(spark, sf):
    rows = views.queue(spark, sf)
    return lww.add_missing(rows.where("attempts < 6"), rows.withColumn("attempts", F.lit(0)), ["target", "hash"]).select("target", "hash", "attempts")


@query(_with("queue", "SELECT target, hash, attempts FROM queue WHERE attempts < 10"))
def queue_remove(spark, sf):
    rows = views.queue(spark, sf)
    return lww.remove(rows, replication.stuck(rows), ["target", "hash"]).select("target", "hash", "attempts")


@query(_with("held live pending", f", orphans AS (SELECT hash FROM held EXCEPT SELECT hash FROM live) SELECT hash, {NOW + GRACE}::BIGINT AS not_before_ms FROM orphans UNION ALL SELECT hash, not_before_ms FROM pending WHERE hash NOT IN (SELECT hash FROM orphans) AND hash NOT IN (SELECT hash FROM live)"))
def pending_update(spark, sf):
    """Orphans are marked anew, live blocks' marks go."""
    local, alive, due = _gc(spark, sf)
    marks = local.join(alive, "hash", "left_anti").select("hash", F.lit(NOW + GRACE).cast("bigint").alias("not_before_ms"))
    return lww.remove(lww.replace(due, marks, ["hash"]), alive, ["hash"])


@query(_with("parts", "SELECT upload_id, part_number, size + part_number % 2 AS size FROM parts"))
def part_replace(spark, sf):
    rows = views.upload_parts(spark, sf).select("bucket", "upload_id", "part_number", "size")
    again = rows.where("part_number % 2 = 1").withColumn("size", F.col("size") + 1)
    return lww.replace(rows, again, ["bucket", "upload_id", "part_number"]).select("upload_id", "part_number", "size")


@query(f"SELECT key, updated_at, deleted, CASE WHEN deleted THEN 0 ELSE length(key) END::BIGINT AS size, (('0x' || substr(sha256(key), 1, 2))::INTEGER & 63)::INTEGER AS shard_id, seq AS last_seq FROM (SELECT key, ts AS updated_at, kind = 'object_delete' AS deleted FROM ({_LAST.replace('FROM facts', 'FROM (' + _CTE['facts'] + ')')})), (SELECT max(event_id) AS seq FROM events)")
def facts_pull(spark, sf):
    """The events as a peer's log, pulled and merged; the cursor stands at its end."""
    log = views.facts(spark, sf)
    name = F.when(F.col("kind") == "object_delete", "ObjectDelete").otherwise("ObjectPut")
    data = F.struct(F.lit("b").alias("bucket"), "key", F.array(F.sha2(F.col("seq").cast("string"), 256)).alias("blocks"), F.length("key").cast("bigint").alias("size"), F.lit("e").alias("etag"))
    store = Store(spark)
    facts.pull(store, log.select("seq", "ts", "kind", scalar.encode_fact(name, data).alias("payload")), "site-9", SITE, NOW)
    last = store.read("replication_cursors").first()["last_seq"]
    rows = store.read("objects").select("key", "updated_at", "deleted", "size", "shard_id")
    return rows.withColumn("last_seq", F.lit(last))


@query(_with("locations", f"SELECT hash, {NOW + 60_000}::BIGINT AS next_attempt_at, 1::INTEGER AS attempts FROM (SELECT DISTINCT sha256(l_partkey::VARCHAR || '-' || s::VARCHAR) AS hash FROM (SELECT l_partkey, unnest([l_suppkey, l_suppkey + 1]) AS s FROM lineitem)) WHERE hash IN (SELECT hash FROM locations) AND hash NOT IN (SELECT hash FROM locations WHERE location_id IN ('site-1', 'site-2', 'site-3', 'site-4'))"))
def replication_drain(spark, sf):
    """What is left of a queue after one step: blocks whose holders aren't reachable."""
    queue = _wanted(spark, sf).select("target", "hash", F.lit(NOW - 1).cast("bigint").alias("next_attempt_at"), F.lit(0).alias("attempts"), F.lit(NOW - 1).cast("bigint").alias("enqueued_at"))
    return replication.drain(queue, views.locations(spark, sf), PEERS, SITE, NOW, page=None)["queue"].select("hash", "next_attempt_at", "attempts")


@query(_with("locations held live blocks", "SELECT hash, size FROM blocks WHERE hash NOT IN (SELECT hash FROM held EXCEPT SELECT hash FROM live) OR hash IN (SELECT hash FROM locations WHERE location_id <> 'site-1')"))
def drain_forced_sweep(spark, sf):
    """The guard has tripped: nothing is fetched, and orphans go at once."""
    _, alive, due = _gc(spark, sf)
    step = replication.drain(views.queue(spark, sf), views.locations(spark, sf), PEERS, SITE, NOW, tripped=True, held=(alive, views.blocks(spark, sf), due))
    return step["blocks"].select("hash", "size")


@query(_with("queue", "SELECT count(*)::BIGINT AS n, array_to_string((list(hash || ' x' || attempts::VARCHAR ORDER BY hash))[1:5], ',') AS sample FROM queue WHERE target = 'site-1' AND attempts >= 10"))
def stuck_summary(spark, sf):
    return replication.stuck_summary(views.queue(spark, sf), SITE).select("n", F.array_join("sample", ",").alias("sample"))


@query(_with("nodes", "SELECT location_id, CASE WHEN location_id = 'site-1' THEN api_url ELSE 'https://' || api_url END AS api_url FROM nodes"))
def membership_merge(spark, sf):
    held = views.nodes(spark, sf).withColumn("last_heartbeat", F.lit(0).cast("bigint"))
    told = held.withColumn("api_url", F.concat(F.lit("https://"), "api_url"))
    return replication.record_peers(held, told, SITE, NOW).select("location_id", "api_url")


@query("SELECT access_key, action, c_mktsegment IS NOT NULL AND (c_mktsegment = 'BUILDING' OR action = 's3:GetObject') AS allowed FROM (SELECT (c_custkey * 2)::VARCHAR AS access_key, unnest(['s3:GetObject', 's3:PutObject']) AS action FROM customer) LEFT JOIN (SELECT c_custkey::VARCHAR AS access_key, c_mktsegment FROM customer) USING (access_key)")
def user_access(spark, sf):
    """Keys that no user has are refused."""
    own = F.when(F.col("c_mktsegment") == "BUILDING", policy.preset("admin")).otherwise(policy.preset("readonly"))
    c = views.raw(spark, sf, "customer")
    users = c.select(F.col("c_custkey").cast("string").alias("access_key"), own.alias("policy"))
    asked = c.select((F.col("c_custkey") * 2).cast("string").alias("access_key"), F.explode(F.array(F.lit("s3:GetObject"), F.lit("s3:PutObject"))).alias("action"), F.lit("r").alias("resource"))
    return policy.authorize(asked, users).select("access_key", "action", "allowed")


@query(_with("objects", "SELECT key, version_id, is_latest, size, n > 5 AS is_truncated FROM (SELECT *, 'null' AS version_id, true AS is_latest, count(*) OVER () AS n, row_number() OVER (ORDER BY key) AS r FROM objects WHERE NOT deleted AND bucket = 'src1' AND starts_with(key, 'en/')) WHERE r <= 5"))
def versions_page(spark, sf):
    return listing.versions(views.objects(spark, sf), "src1", "en/", None, 5).select("key", "version_id", "is_latest", "size", "is_truncated")


@query(_with("objects", "SELECT bucket, count(*)::BIGINT AS items, least(count(*), 4)::INTEGER AS key_count, count(*) > 4 AS is_truncated FROM objects WHERE NOT deleted AND bucket = 'src1' GROUP BY bucket"))
def list_key_count(spark, sf):
    got = listing.page(views.objects(spark, sf), "src1", max_keys=4, start_after="a").groupBy("bucket").agg(F.max("key_count").alias("key_count"), F.max("is_truncated").alias("is_truncated"))
    return lww.live(views.objects(spark, sf)).groupBy("bucket").agg(F.count("*").alias("items")).join(got, "bucket").select("bucket", "items", "key_count", "is_truncated")


@query(_with("parts", "SELECT upload_id AS key, sum(size)::BIGINT AS size, md5(unhex(string_agg(etag, '' ORDER BY part_number))) || '-' || sum((size + 1023) // 1024)::BIGINT::VARCHAR AS etag, 0::BIGINT AS left_over FROM parts GROUP BY upload_id"))
def multipart_site(spark, sf):
    """Uploads created, their parts put, and all of them completed."""
    store = Store(spark)
    made = site.Site(store, ParquetBlobs(spark, f"{store.root}/blobs"), Config(location_id=SITE, chunk_size=1024))
    c = views.raw(spark, sf, "conversations").select(F.lit("chat").alias("bucket"), F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("int").alias("part_number"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    uploads = made.create_uploads(c.select("bucket", "key").distinct())
    made.upload_parts(c.join(uploads, ["bucket", "key"]).select("bucket", "upload_id", "part_number", "body"), NOW)
    made.complete_uploads(uploads.select("bucket", "upload_id", "key"), NOW + 1)
    left = F.lit(store.read("parts").count()).cast("bigint")
    return store.read("objects").select("key", "size", "etag", left.alias("left_over"))


@query(_with("objects", "SELECT 'copy' AS bucket, key, size, etag FROM objects WHERE bucket = 'src1'"))
def copy_manifests(spark, sf):
    made = _site(spark, sf)
    asked = made.store.read("objects").where("bucket = 'src1'").select(F.col("bucket").alias("source_bucket"), F.col("key").alias("source_key"), F.lit("copy").alias("bucket"), "key")
    made.copy(asked, NOW + 1)
    return made.store.read("objects").where("bucket = 'copy'").select("bucket", "key", "size", "etag")
