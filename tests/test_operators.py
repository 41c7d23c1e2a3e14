"""Cases of the reference's behaviour over tiny frames."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratum.config import Config
from stratum.functions import policy, scalar
from stratum.operators import chunking, gc, listing, lww, multipart, ranges, replication, usage
from stratum.operators.site import Site
from stratum.sources.store import ParquetBlobs, Store
from stratum.streaming import facts

OBJECT = "bucket string, key string, blocks array<string>, size bigint, etag string, shard_id int, updated_at bigint, deleted boolean"


def objects(spark, keys, deleted=()):
    return spark.createDataFrame([("b", k, ["h"], 1, "e", None, i, k in deleted) for i, k in enumerate(keys)], OBJECT)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lww_any_order(spark):
    rows = [("k", ts, f"v{ts}") for ts in range(6)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "key string, ts bigint, v string").withColumn("arrival", F.monotonically_increasing_id())
        assert [r["v"] for r in lww.winners(df, ["key"], "ts", F.col("arrival")).collect()] == ["v5"]


def test_lww_tie_keeps_incumbent_and_convergent_agrees(spark):
    a, b = (spark.createDataFrame([("k", 7, v)], "key string, ts bigint, v string") for v in "ab")
    assert lww.merge(a, b, ["key"], "ts").first()["v"] == "a"
    assert lww.merge(b, a, ["key"], "ts").first()["v"] == "b"
    assert lww.merge(a, b, ["key"], "ts", convergent=True).first() == lww.merge(b, a, ["key"], "ts", convergent=True).first()


def test_tombstone_is_not_resurrected(spark):
    held = objects(spark, ["k"])
    gone = lww.tombstone(held.select("bucket", "key"), F.lit(60), held)
    older = held.withColumn("updated_at", F.lit(30).cast("bigint"))
    assert lww.live(lww.merge(lww.merge(held, gone, ["bucket", "key"], "updated_at"), older, ["bucket", "key"], "updated_at")).count() == 0


def test_listing_pages(spark):
    held = objects(spark, ["c", "a", "b", "e", "d"])
    first = listing.page(held, "b", max_keys=3).orderBy("item").collect()
    assert [r["item"] for r in first] == ["a", "b", "c"] and first[0]["is_truncated"] and first[0]["next_token"] == "c"
    rest = listing.page(held, "b", after="c", max_keys=3).orderBy("item").collect()
    assert [r["item"] for r in rest] == ["d", "e"] and not rest[0]["is_truncated"]


def test_listing_delimiter(spark):
    held = objects(spark, ["datasets/a.txt", "datasets/b/c.txt", "notes/x", "top.txt"])
    got = {r["item"]: r["is_prefix"] for r in listing.page(held, "b", delimiter="/").collect()}
    assert got == {"datasets/": True, "notes/": True, "top.txt": False}
    # a token that is a prefix doesn't come again
    assert [r["item"] for r in listing.page(held, "b", delimiter="/", after="datasets/", max_keys=1).collect()] == ["notes/"]


@pytest.mark.parametrize(("first", "last", "suffix", "size", "want"), [(0, 9, None, 100, (0, 9)), (50, None, None, 100, (50, 99)), (90, 999, None, 100, (90, 99)), (None, None, 20, 100, (80, 99)), (None, None, 500, 100, (0, 99)), (100, None, None, 100, None), (0, None, None, 0, None)])
def test_resolve_range(spark, first, last, suffix, size, want):
    lit = lambda v: F.lit(v).cast("bigint")
    got = one(spark, scalar.resolve_range(lit(size), lit(first), lit(last), lit(suffix)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("a", "z", "want"), [(12, 15, [(1, 2, 4)]), (5, 24, [(0, 5, 5), (1, 0, 10), (2, 0, 5)]), (10, 19, [(1, 0, 10)]), (29, 29, [(2, 9, 1)])])
def test_range_plan(spark, a, z, want):
    sized = spark.createDataFrame([("k", i, 10) for i in range(3)], "key string, pos int, size bigint")
    lit = lambda v: F.lit(v).cast("bigint")
    got = ranges.plan(sized, ["key"], lit(a), lit(z), lit(None)).orderBy("pos").collect()
    assert [(r["pos"], r["skip"], r["take"]) for r in got] == want


def test_slices(spark):
    data = F.lit("0123456789").cast("binary")
    got = [bytes(one(spark, scalar.slice_bytes(data, F.lit(s), F.lit(t)))) for s, t in ((2, 3), (8, 50), (20, 5))]
    assert got == [b"234", b"89", b""]


def test_chunks(spark):
    cases = {"abcdefgh": 4, "abcde": 4, "abc": 4, "": 4, "xyz": 1}
    want = [["abcd", "efgh"], ["abcd", "e"], ["abc"], [], ["x", "y", "z"]]
    for (text, size), expected in zip(cases.items(), want, strict=True):
        df = spark.createDataFrame([("k", text.encode())], "key string, body binary")
        got = [bytes(r["data"]).decode() for r in chunking.fixed(df, size).orderBy("pos").collect()]
        assert got == expected
    body = spark.createDataFrame([("k", b"A" * 25)], "key string, body binary")
    made = chunking.manifests(chunking.addressed(chunking.fixed(body, 10)), ["key"]).first()
    assert len(made["blocks"]) == 3 and made["size"] == 25
    assert body.select(scalar.etag(F.col("body"))).first()[0] == "1995da96cd16a48cebcbc08424f6f945"


def test_content_defined(spark):
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(60_000))
    for data in (b"\x42" * 10_240, bytes(range(256)) * 32, noise, b"", b"x"):
        ends = chunking.cut_points(data, 512, 1024, 2048)
        sizes = [b - a for a, b in itertools.pairwise([0, *ends])]
        assert sum(sizes) == len(data) and all(s <= 2048 for s in sizes) and all(s >= 512 for s in sizes[:-1])
    shifted = {noise[a:b] for a, b in itertools.pairwise([0, *chunking.cut_points(b"new" + noise, 512, 1024, 2048)])}
    assert len(shifted) > 10
    df = spark.createDataFrame([("k", noise)], "key string, body binary")
    got = chunking.chunks(df, Config(chunking="cdc", cdc_min=512, cdc_avg=1024, cdc_max=2048)).orderBy("pos").collect()
    assert b"".join(bytes(r["data"]) for r in got) == noise


def test_incremental_chunks(spark, tmp_path):
    """Cut as they arrive, bodies have the chunks of whole ones."""
    rng = random.Random(2)
    for config in (Config(chunk_size=700), Config(chunking="cdc", cdc_min=512, cdc_avg=1024, cdc_max=2048)):
        for size in (0, 1, 700, 1400, 20_000):
            body = rng.randbytes(size)
            whole = [body[a:z] for a, z in itertools.pairwise([0, *chunking.ends_of(body, config)])]
            for step in (1 if size < 2000 else 97, 333, 5000):
                got, carried = [], b""
                for i in range(0, size, step):
                    done, carried = chunking.process(carried, body[i : i + step], config)
                    got += done
                assert got + ([carried] if carried else []) == whole
    bodies = {f"k{i}": rng.randbytes(3000 * i) for i in range(4)}
    batches = [[(k, n, b[i : i + 999], i + 999 >= len(b)) for k, b in bodies.items() for n, i in enumerate(range(0, max(len(b), 1), 999)) if n // 4 == batch] for batch in range(3)]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "key string, seq bigint, data binary, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("key string, seq bigint, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = chunking.chunk_stream(source, config).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    got = {k: [] for k in bodies}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("key", "pos").collect():
        got[r["key"]].append(bytes(r["data"]))
    assert got == {k: [b[a:z] for a, z in itertools.pairwise([0, *chunking.ends_of(b, config)])] for k, b in bodies.items()}


def test_gc(spark):
    hashes = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    due = spark.createDataFrame([("cancelled", 5), ("late", 10), ("early", 99), ("lost", 1)], "hash string, not_before_ms bigint")
    local, alive = hashes("kept", "cancelled", "late", "early", "fresh"), hashes("kept", "cancelled", "elsewhere")
    got = {r["hash"]: r["action"] for r in gc.decide(local, alive, due, 10, 60).collect()}
    assert got == {"kept": "keep", "cancelled": "cancel", "late": "reap", "early": "wait", "fresh": "mark", "lost": "drop_stale"}
    assert {r["action"] for r in gc.decide(local, alive, due, 10, 60, force=True).collect()} == {"keep", "cancel", "reap", "drop_stale"}
    assert {r["hash"]: r["action"] for r in gc.decide(hashes("o"), alive, due.limit(0), 10, 0).collect()} == {"o": "reap"}


def test_replication_plan(spark):
    spots = spark.createDataFrame([("held", "a"), ("held", "b"), ("far", "c"), ("near", "b"), ("mixed", "b"), ("mixed", "d")], "hash string, location_id string")
    asked = spark.createDataFrame([("a", h, 0, n, 0) for n, h in enumerate(["none", "held", "far", "near", "mixed"])], "target string, hash string, next_attempt_at bigint, attempts int, enqueued_at bigint")
    got = {r["hash"]: (r["action"], r["sources"]) for r in replication.plan(asked, spots, ["b"], "a").collect()}
    assert got == {"none": ("drop", []), "held": ("drop", []), "far": ("defer", []), "near": ("fetch", ["b"]), "mixed": ("fetch", ["b"])}
    step = replication.drain(asked, spots, [], "a", 1000)
    left = {r["hash"]: (r["next_attempt_at"], r["attempts"]) for r in step["queue"].collect()}
    assert left == {"far": (241_000, 3), "near": (481_000, 4), "mixed": (961_000, 5)}


def test_multipart(spark):
    rows = [("u", 2, ["01" * 32], 10, "eeff0011"), ("u", 1, ["00" * 32], 10, "aabbccdd")]
    parts = spark.createDataFrame(rows, "upload_id string, part_number int, blocks array<string>, size bigint, etag string")
    got = multipart.complete(parts, ["upload_id"]).first()
    assert (got["blocks"], got["size"], got["etag"]) == (["00" * 32, "01" * 32], 20, "edfdfa40d20f1a3aeb33933078e9088f-2")


def test_policy(spark):
    cases = [("*", "any", True), ("s3:*", "s3:", True), ("s3:*", "iam:GetUser", False), ("", "", True), ("s3:Get*Object", "s3:GetObject", False)]
    assert [one(spark, policy.matches(F.lit(p), F.lit(v))) for p, v, _ in cases] == [w for *_, w in cases]
    rule = lambda e, a: F.struct(F.lit(e).alias("effect"), F.array(F.lit(a)).alias("actions"), F.array(F.lit("*")).alias("resources"))
    both = [rule("Allow", "*"), rule("Deny", "s3:DeleteObject")]
    for order in (both, both[::-1]):
        own = F.struct(F.array(*order).alias("statements"))
        assert [one(spark, policy.allowed(own, F.lit(a), F.lit("r"))) for a in ("s3:GetObject", "s3:DeleteObject")] == [True, False]
    empty = F.from_json(F.lit('{"statements": []}'), "statements array<struct<effect:string,actions:array<string>,resources:array<string>>>")
    assert one(spark, policy.allowed(empty, F.lit("a"), F.lit("r"))) is False


def test_sizes_guard_and_bounds(spark):
    cases = {"0": 0, "1024": 1024, "1B": 1, "10Gi": 10 * 2**30, "500Mi": 500 * 2**20, "1Ti": 2**40, "2GB": 2 * 10**9, "1.5Gi": 1610612736, "": None, "10Xy": None, "abc": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", scalar.parse_size(F.col("t")).alias("n")).collect()} == cases
    assert [one(spark, scalar.format_bytes(F.lit(n).cast("bigint"))) for n in (512, 1024, 10 * 2**30)] == ["512B", "1.0Ki", "10.0Gi"]
    trip = lambda *v: one(spark, usage.guard(*map(F.lit, v)))
    assert [trip(0, 0, 1, 0), trip(5, 200, 1, 100), trip(0, 200, 1, 100), trip(0, 200, 0, 0)] == ["LowFreeSpace", "OverQuota", "LowFreeSpace", None]
    assert [scalar.prefix_bound(p) for p in ("abc", "a~", "folder/", "")] == [b"abd", b"a\x7f", b"folder0", None]
    assert one(spark, scalar.copy_range(F.lit("bytes=5-9"))) == (5, 9) and one(spark, scalar.copy_range(F.lit("bytes=9-5"))) is None
    assert one(spark, scalar.backoff_ms(F.lit(-1))) == 60_000 and one(spark, scalar.backoff_ms(F.lit(40))) == 21_600_000


def test_sizes_halfway_and_large(spark):
    cases = {1280: "1.2Ki", 1792: "1.8Ki", 1023 * 1024 + 1023: "1024.0Ki", 2**20 + 2**18: "1.2Mi", 2**40 - 1: "1024.0Gi", 5 * 2**40 + 3 * 2**38: "5.8Ti", 2**63 - 1: "8388608.0Ti", 0: "0B"}
    df = spark.createDataFrame([(n,) for n in cases], "n bigint")
    assert {r["n"]: r["t"] for r in df.select("n", scalar.format_bytes(F.col("n")).alias("t")).collect()} == cases
    assert one(spark, scalar.format_bytes(F.lit(None).cast("bigint"))) is None


def test_query_size_format_like_its_sql(spark, tmp_path):
    import duckdb

    from stratum.plans import catalog

    # halfway values of every unit, and sizes beyond 1024 Gi
    keys = [*range(1, 4000), *range(4096, 200_000, 512), *range(200_000, 900_001, 7777)]
    spark.createDataFrame([(k,) for k in keys], "o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    want = duckdb.connect().execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'").execute(catalog.ORACLES["size_format"]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["size_format"](spark, str(tmp_path)).collect()) == sorted(want)


def test_config():
    c = Config(location_id="x", chunking="cdc", page=7, max_usage="1.5Gi")
    assert Config.loads(c.dumps()) == c
    for bad in ("", "10Xy", "abc", "1i"):
        with pytest.raises(ValueError):
            Config(min_free=bad)


def test_presets_and_users(spark):
    actions = ["GetObject", "HeadObject", "PutObject", "DeleteObject", "ListBucket", "ListAllMyBuckets", "CreateBucket", "DeleteBucket", "AbortMultipartUpload", "ListMultipartUploadParts", "ListBucketMultipartUploads", "PutBucketPolicy"]
    can = lambda name: [a for a in actions if one(spark, policy.allowed(policy.preset(name), F.lit(f"s3:{a}"), F.lit("r")))]
    assert can("admin") == actions and can("readwrite") == actions[:-1]
    assert can("readonly") == [a for a in actions if a in ("GetObject", "HeadObject", "ListBucket", "ListAllMyBuckets", "ListMultipartUploadParts", "ListBucketMultipartUploads")]
    users = spark.createDataFrame([("ak", "s")], "access_key string, secret_key string").withColumn("policy", policy.preset("readonly"))
    asked = spark.createDataFrame([("ak", "s3:GetObject", "r"), ("ak", "s3:PutObject", "r"), ("no", "s3:GetObject", "r")], "access_key string, action string, resource string")
    assert {(r["access_key"], r["action"]): r["allowed"] for r in policy.authorize(asked, users).collect()} == {("ak", "s3:GetObject"): True, ("ak", "s3:PutObject"): False, ("no", "s3:GetObject"): False}


def test_query_pairs(spark):
    got = one(spark, scalar.query_pairs(F.lit("a=1&&flag&b=x%zz+y&c+d=%C3%A9%2&e=f=g&=h&i=")))
    assert [tuple(p) for p in got] == [("a", "1"), ("b", "x%zz y"), ("c d", "é%2"), ("e", "f=g"), ("", "h"), ("i", "")]


def test_membership_and_summaries(spark):
    nodes = spark.createDataFrame([("a", "http://a", 1), ("b", "http://old", 1)], "location_id string, api_url string, last_heartbeat bigint")
    told = spark.createDataFrame([("a", "http://spoof"), ("b", "http://b"), ("c", "http://c")], "location_id string, api_url string")
    got = {r["location_id"]: r["api_url"] for r in replication.record_peers(nodes, told, "a", 9).collect()}
    assert got == {"a": "http://a", "b": "http://b", "c": "http://c"}
    queue = spark.createDataFrame([("a", f"h{i}", 0, 10 + i, 0) for i in range(7)] + [("a", "fresh", 0, 1, 0), ("b", "h0", 0, 99, 0)], "target string, hash string, next_attempt_at bigint, attempts int, enqueued_at bigint")
    assert replication.stuck_summary(queue, "a").first() == (7, [f"h{i} x{10 + i}" for i in range(5)])
    assert replication.stuck_summary(queue, "c").first() == (0, [])
    edges = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(7, 0)], "src int, dst int")
    assert replication.known_from(edges).count() == 42
    parts = spark.createDataFrame([("b", "u", i) for i in range(1, 6)], "bucket string, upload_id string, part_number int")
    page = listing.parts(parts, "b", "u", 1, 2).orderBy("part_number").collect()
    assert [(r["part_number"], r["is_truncated"]) for r in page] == [(2, True), (3, True)]
    assert [r["is_truncated"] for r in listing.parts(parts, "b", "u", 3, 2).collect()] == [False, False]
    many = objects(spark, [f"k{i}" for i in range(9)])
    assert {(r["key_count"], r["is_truncated"]) for r in listing.page(many, "b", max_keys=4, start_after="k6").collect()} == {(2, False)}
    assert [r["item"] for r in listing.page(many, "b", max_keys=1, after="k0", start_after="k6").collect()] == ["k1"]
    assert [(r["key"], r["is_truncated"]) for r in listing.versions(many, "b", "k", "k5", 2).orderBy("key").collect()] == [("k6", True), ("k7", True)]


def test_listing_all_pages_over_many_partitions(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("b"), (F.col("id") % 2).cast("string")).alias("bucket"), F.lpad(F.col("id").cast("string"), 6, "0").alias("key"), F.lit(1).alias("size"), F.lit("e").alias("etag"), F.col("id").alias("updated_at"), F.lit(False).alias("deleted"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = listing.pages(keys, 7).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for _, own in got.sort_values("item").groupby("bucket"):
        assert own["page"].tolist() == [i // 7 for i in range(10_000)]


def make_site(spark, path, name="site-a", **more):
    store = Store(spark, f"file://{path}/{name}")
    return Site(store, ParquetBlobs(spark, f"{store.root}/blobs"), Config(location_id=name, chunk_size=10, **more))


def body_rows(spark, **bodies):
    return spark.createDataFrame([("b", k, v) for k, v in bodies.items()], "bucket string, key string, body binary")


def test_site_put_get_delete(spark, tmp_path):
    a, b = make_site(spark, tmp_path), make_site(spark, tmp_path, "site-b")
    a.put(body_rows(spark, big=b"A" * 25, empty=b"", one=b"a", mixed=b"0123456789" * 3), 10)
    rows = {r["key"]: r for r in a.store.read("objects").collect()}
    assert [(len(rows[k]["blocks"]), rows[k]["size"]) for k in ("big", "empty", "one", "mixed")] == [(3, 25), (0, 0), (1, 1), (3, 30)]
    assert rows["big"]["etag"] == "1995da96cd16a48cebcbc08424f6f945" and all(0 <= r["shard_id"] < 64 for r in rows.values())
    # equal blocks are held and announced once
    assert a.store.read("blocks").count() == 4 and a.store.read("fact_log").where("kind = 'block_announce'").count() == 4
    asked = spark.createDataFrame([("b", "mixed", 5, 14, None), ("b", "mixed", None, None, 3), ("b", "mixed", 30, None, None), ("b", "big", None, None, None), ("b", "empty", None, None, None), ("b", "nope", None, None, None)], "bucket string, key string, first bigint, last bigint, suffix bigint")
    got = {(r["key"], r["first"], r["suffix"]): (r["status"], r["data"] and bytes(r["data"])) for r in a.get(asked).collect()}
    assert got[("mixed", 5, None)] == ("ok", b"5678901234") and got[("mixed", None, 3)] == ("ok", b"789") and got[("big", None, None)] == ("ok", b"A" * 25)
    assert got[("mixed", 30, None)][0] == "InvalidRange" and got[("nope", None, None)][0] == "NoSuchKey" and got[("empty", None, None)][0] == "ok"
    # a peer that replays the log has the objects and queues the blocks once
    for _ in range(2):
        facts.pull(b.store, a.store.read("fact_log"), "site-a", "site-b", 1000)
    assert b.store.read("replication_queue").count() == 4 and lww.live(b.store.read("objects")).count() == 4
    whole = asked.where("key = 'big'")
    assert b.get(whole).first()["status"] == "Unavailable"
    # read repair: blocks of a reachable holder are promoted and announced
    wanted = b.store.read("replication_queue").select("hash").union(spark.createDataFrame([("nowhere",)], "hash string"))
    assert {r["status"] for r in b.repair(wanted, {}, 20).collect()} == {"unavailable: holders down", "unknown"}
    assert {r["status"] for r in b.repair(wanted, {"site-a": a.blobs}, 20).collect()} == {"promoted", "unknown"}
    assert {r["status"] for r in b.repair(wanted, {}, 20).collect()} == {"local", "unknown"}
    assert bytes(b.get(whole).first()["data"]) == b"A" * 25 and b.store.read("fact_log").count() == 4
    a.delete(body_rows(spark, big=b"", gone=b""), 30)
    facts.pull(b.store, a.store.read("fact_log"), "site-a", "site-b", 1000)
    for site in (a, b):
        assert {r["key"] for r in lww.live(site.store.read("objects")).collect()} == {"empty", "one", "mixed"}
        assert site.store.read("objects").where("deleted and shard_id is null").count() == 0
    # an older put that comes late doesn't bring the key back
    a.put(body_rows(spark, big=b"late"), 29)
    assert "big" not in {r["key"] for r in lww.live(a.store.read("objects")).collect()}


def test_site_multipart_and_sweep(spark, tmp_path):
    a = make_site(spark, tmp_path)
    a.put(body_rows(spark, src=b"0123456789" * 4), 1)
    u = a.create_uploads(spark.createDataFrame([("b", "k")], "bucket string, key string")).first()["upload_id"]
    part = "bucket string, upload_id string, part_number int, body binary"
    done = a.upload_parts(spark.createDataFrame([("b", u, 2, b"second"), ("b", u, 1, b"first-first-first"), ("b", "no", 1, b"x")], part), 2)
    assert sorted(r["status"] for r in done.collect()) == ["NoSuchUpload", "ok", "ok"]
    a.upload_parts(spark.createDataFrame([("b", u, 2, b"again")], part), 3)
    copy = spark.createDataFrame([("b", u, 3, "b", "src", 8, 21), ("b", u, 4, "b", "none", None, None)], "bucket string, upload_id string, part_number int, source_bucket string, source_key string, first bigint, last bigint")
    assert {r["part_number"]: r["status"] for r in a.copy_parts(copy, 4).collect()} == {3: "ok", 4: "NoSuchKey"}
    ask = lambda key: spark.createDataFrame([("b", u, key)], "bucket string, upload_id string, key string")
    assert a.complete_uploads(ask("different"), 5).first()["status"] == "InvalidRequest" and a.store.read("parts").count() == 3
    assert a.complete_uploads(ask("k"), 6).first()["status"] == "ok"
    whole = spark.createDataFrame([("b", "k", None, None, None)], "bucket string, key string, first bigint, last bigint, suffix bigint")
    got = a.get(whole).first()
    assert bytes(got["data"]) == b"first-first-first" + b"again" + b"89012345678901"[:14] and got["etag"].endswith("-5")
    assert a.store.read("parts").count() == a.store.read("multipart_uploads").count() == 0
    # the guard is tripped: the sweep takes what no live object names
    alive = gc.live_set(a.store.read("objects"), a.store.read("parts"))
    after = replication.drain(a.store.read("replication_queue"), a.store.read("block_locations"), [], "site-a", 7, True, held=(alive, a.store.read("blocks"), a.store.read("pending_deletions")))
    assert after["plan"].count() == 0 and after["blocks"].count() == alive.count() < a.store.read("blocks").count()
    gone = a.store.read("blocks").join(after["blocks"], "hash", "left_anti")
    a.blobs.delete(gone)
    assert a.blobs.get(a.store.read("blocks")).count() == alive.count() and bytes(a.get(whole).first()["data"]) == bytes(got["data"])
    a.store.write("blocks", after["blocks"])
    n = a.store.read("blocks").count()
    a.store.vacuum()
    assert a.store.read("blocks").count() == n
    a.add_locations(spark.createDataFrame([("new", "site-z", "f")], "hash string, location_id string, fid string"), 8)
    assert a.store.read("blocks").where("hash = 'new'").first()["size"] == 0


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "k string, ts bigint").write.parquet(f"{tmp_path}/none")
    got = facts.latest_of_stream(spark, f"{tmp_path}/none", spark.read.schema("k string, ts bigint").parquet(f"{tmp_path}/none").schema, lambda df: df.withColumn("n", F.lit(1)), ["k"], "ts", "ts")
    assert got.count() == 0 and got.columns == ["k", "ts", "n"]


def fact(seq, ts, kind, **data):
    import json

    return (seq, ts, "k", json.dumps({"kind": kind, "data": data}))


def test_facts_pull_and_stream(spark, tmp_path):
    log = spark.createDataFrame([
        fact(1, 10, "ObjectPut", bucket="b", key="k", blocks=["h1", "h2"], size=99, etag="e1"),
        fact(2, 30, "ObjectDelete", bucket="b", key="k"),
        fact(3, 20, "ObjectPut", bucket="b", key="k", blocks=["h3"], size=1, etag="older"),
        fact(4, 40, "BlockAnnounce", hash="h5", location_id="site-a", fid="f", size=10),
        fact(5, 50, "UserPut", access_key="ak", secret_key="s", policy='{"statements": []}'),
    ], "seq bigint, ts bigint, kind string, payload string")
    store = Store(spark, f"file://{tmp_path}/store")
    assert facts.pull(store, log, "site-a", "site-b", 1000, limit=2) == 5
    assert lww.live(store.read("objects")).count() == 0 and store.read("objects").count() == 1
    assert [r["hash"] for r in store.read("replication_queue").collect()] == ["h5"]
    assert facts.pull(store, log, "site-a", "site-b", 2000, limit=2) == 5
    assert store.read("replication_queue").count() == 1 and store.read("users").count() == 1
    with pytest.raises(ValueError):
        facts.pull(store, spark.createDataFrame([(9, 1, "k", "{}")], log.schema), "site-a", "site-b", 0)
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    other = Store(spark, f"file://{tmp_path}/other")
    facts.stream(other, f"{tmp_path}/log", "site-b", 0, files_per_batch=1).awaitTermination()
    assert lww.live(other.read("objects")).count() == 0 and other.read("blocks").count() == 1


def test_blobs(spark, tmp_path):
    blobs = ParquetBlobs(spark, f"{tmp_path}/blobs")
    blobs.put(spark.createDataFrame([("aabb", b"x"), ("ccdd", b"y")], "hash string, data binary"))
    got = blobs.get(spark.createDataFrame([("aabb",), ("eeff",)], "hash string"))
    assert [(r["hash"], bytes(r["data"])) for r in got.collect()] == [("aabb", b"x")]
