"""Fixed schemas of the object-store tables (SRC2)."""
from pyspark.sql import types as T

HASHES = T.ArrayType(T.StringType())


def _of(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
POLICY = _of(statements=T.ArrayType(_of(effect=S, actions=T.ArrayType(S), resources=T.ArrayType(S))))
OBJECTS = _of(bucket=S, key=S, blocks=HASHES, size=L, etag=S, shard_id=I, updated_at=L, deleted=B)
BLOCKS = _of(hash=S, size=L, updated_at=L)
BLOCK_LOCATIONS = _of(hash=S, location_id=S, fid=S, updated_at=L)
PENDING = _of(hash=S, not_before_ms=L)
USERS = _of(access_key=S, secret_key=S, policy=POLICY, updated_at=L)
UPLOADS = _of(bucket=S, upload_id=S, key=S)
PARTS = _of(bucket=S, upload_id=S, part_number=I, blocks=HASHES, size=L, etag=S)
NODES = _of(location_id=S, api_url=S, last_heartbeat=L)
QUEUE = _of(target=S, hash=S, next_attempt_at=L, attempts=I, enqueued_at=L)
CURSORS = _of(peer=S, last_seq=L)
FACT_DATA = _of(bucket=S, key=S, blocks=HASHES, size=L, etag=S, hash=S, location_id=S, fid=S, access_key=S, secret_key=S, policy=S)
FACTS = _of(seq=L, ts=L, kind=S, payload=S)
TABLES = {"objects": OBJECTS, "blocks": BLOCKS, "block_locations": BLOCK_LOCATIONS, "pending_deletions": PENDING, "users": USERS, "multipart_uploads": UPLOADS, "parts": PARTS, "nodes": NODES, "replication_queue": QUEUE, "fact_log": FACTS, "replication_cursors": CURSORS}
