"""Scalar functions as column expressions (FN1-FN22). Nothing here runs Python for a row."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FACT_DATA, POLICY

SHARDS = 64
BACKOFF_BASE_MS, BACKOFF_CAP_MS = 60_000, 21_600_000


def digest(body: Column) -> Column:
    """Content address: 32 bytes as hex. SHA-256, since Spark has no BLAKE3 (FN1)."""
    return F.sha2(body, 256)


def shard_id(key: Column) -> Column:
    """FN2: the digest's first byte, modulo the shards."""
    return F.conv(F.substring(digest(key), 1, 2), 16, 10).cast("int").bitwiseAND(SHARDS - 1)


def prefix_bound(prefix: str) -> bytes | None:
    """FN3: least byte string above all with the prefix; None if there is none. Bytes, so it is never invalid text."""
    raw = prefix.encode().rstrip(b"\xff")
    return raw[:-1] + bytes([raw[-1] + 1]) if raw else None


def etag(body: Column) -> Column:
    return F.md5(body)


def pack_blocks(hashes: Column) -> Column:
    """FN6: hex hashes -> their bytes on end."""
    return F.unhex(F.array_join(hashes, ""))


def unpack_blocks(packed: Column) -> Column:
    """FN6: 32-byte pieces as hex; a ragged tail is dropped."""
    n = F.floor(F.octet_length(packed) / 32).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.lower(F.hex(F.substring(packed, i * 32 + 1, F.lit(32)))))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def parse_size(text: Column) -> Column:
    """FN7: '10Gi' -> bytes; null where the text is empty or has an unknown unit."""
    t = F.lower(F.trim(text))
    unit = F.regexp_extract(t, r"^[0-9.]+\s*([a-z]*)$", 1)
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*[a-z]*$", 1)
    scale = F.when(unit.isin("", "b"), F.lit(1.0))
    for k, letter in enumerate("kmgt", 1):
        scale = scale.when(unit.isin(f"{letter}i", f"{letter}ib"), F.lit(float(1024**k))).when(unit.isin(letter, f"{letter}b"), F.lit(float(1000**k)))
    return F.when(number != "", F.floor(number.cast("double") * scale)).cast("bigint")


def format_bytes(n: Column, units: tuple[str, ...] = ("Ki", "Mi", "Gi", "Ti")) -> Column:
    """FN8: one decimal and a binary unit, the last one for all that is larger; plain bytes below 1024.

    A number halfway between two decimals goes to the even one (format_string would go up), so they are whole numbers here."""
    n = n.cast("bigint")
    v = F.coalesce(n.cast("double").try_cast("bigint"), n)  # to the precision of a double, as in the reference

    def text(k: int, unit: str) -> Column:
        rest = lambda x: x.bitwiseAND(F.lit(1024**k - 1).cast("bigint"))
        tenfold = rest(v) * 10
        tenth, half = F.shiftright(tenfold, 10 * k), F.lit(1024**k // 2).cast("bigint")
        up = (rest(tenfold) > half) | ((rest(tenfold) == half) & (tenth % 2 == 1))
        tenth = tenth + up.cast("bigint")
        return F.concat((F.shiftright(v, 10 * k) + (tenth == 10).cast("bigint")).cast("string"), F.lit("."), (tenth % 10).cast("string"), F.lit(unit))

    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for k, unit in enumerate(units[:-1], 1):
        out = out.when(n < 1024 ** (k + 1), text(k, unit))
    return out.otherwise(text(len(units), units[-1]))


def backoff_ms(attempts: Column) -> Column:
    """FN9: doubles from a minute to six hours."""
    return F.least(F.lit(BACKOFF_BASE_MS) * F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(0)), F.lit(20))), F.lit(float(BACKOFF_CAP_MS))).cast("bigint")


def resolve_range(size: Column, first: Column, last: Column, suffix: Column) -> Column:
    """FN10: inclusive bounds of 'first-last', 'first-' or '-suffix' within size; null if unsatisfiable."""
    begin = F.when(suffix.isNotNull(), F.greatest(size - suffix, F.lit(0))).otherwise(first)
    end = F.when(suffix.isNotNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    fine = (size > 0) & (begin < size) & (begin <= end) & F.coalesce(suffix > 0, F.lit(True))
    return F.when(fine, F.struct(begin.cast("bigint").alias("first"), end.cast("bigint").alias("last")))


def slice_bytes(data: Column, skip: Column, take: Column) -> Column:
    """FN11: at most take bytes after skip; null take: the rest."""
    return F.substring(data, skip.cast("int") + 1, F.coalesce(take, F.octet_length(data)).cast("int"))


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """FN12: up to and with the first delimiter after the prefix; null where none follows."""
    at = F.locate(delimiter, key, len(prefix) + 1)
    return F.when(at > 0, F.substring(key, F.lit(1), at + len(delimiter) - 1))


def quoted(tag: Column) -> Column:
    return F.concat(F.lit('"'), tag, F.lit('"'))


def content_range(first: Column, last: Column, size: Column) -> Column:
    return F.format_string("bytes %d-%d/%d", first, last, size)


def copy_range(text: Column) -> Column:
    """FN15: 'bytes=a-b' -> bounds; null if malformed or reversed (Q17)."""
    a = F.regexp_extract(text, r"^bytes=(\d+)-(\d+)$", 1).try_cast("bigint")
    b = F.regexp_extract(text, r"^bytes=(\d+)-(\d+)$", 2).try_cast("bigint")
    return F.when(a <= b, F.struct(a.alias("first"), b.alias("last")))


def arn(bucket: Column, key: Column | None = None) -> Column:
    """FN16."""
    base = F.concat(F.lit("arn:ss:bucket:::"), bucket)
    return base if key is None else F.concat(base, F.lit("/"), key)


def query_pairs(query: Column) -> Column:
    """FN17: decoded names and values in order; '+' is a space, a malformed escape stays as it is, a pair without '=' goes."""
    decoded = lambda v: F.url_decode(F.regexp_replace(v, "%(?![0-9A-Fa-f]{2})", "%25"))
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    item = lambda p: F.struct(decoded(F.split(p, "=", 2)[0]).alias("key"), decoded(F.split(p, "=", 2)[1]).alias("value"))
    return F.transform(pairs, item)


def created_at(micros: Column) -> Column:
    return F.timestamp_micros(F.greatest(micros, F.lit(0).cast("bigint")))


def clock_offset_ms(current: Column, peer_ms: Column, rtt_ms: Column, local_ms: Column) -> Column:
    """FN20: the estimate replaces the offset only if they differ by more than 10 ms."""
    fresh = (peer_ms + F.floor(rtt_ms / 2) - local_ms).cast("bigint")
    return F.when(F.abs(fresh - current) > 10, fresh).otherwise(current)


def cas_path(hash_: Column) -> Column:
    """FN21."""
    return F.concat_ws("/", F.substring(hash_, 1, 2), F.substring(hash_, 3, 2), hash_)


def decode_fact(payload: Column) -> Column:
    """FN22: {"kind": ..., "data": {...}}; missing fields are null."""
    return F.from_json(payload, f"kind string, data {FACT_DATA.simpleString()}")


def encode_fact(kind: Column, data: Column) -> Column:
    return F.to_json(F.struct(kind.alias("kind"), data.alias("data")))


def decode_policy(text: Column) -> Column:
    return F.from_json(text, POLICY)
