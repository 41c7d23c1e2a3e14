"""Multipart assembly (AG8, API16-API19, DML15, DML16)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete(parts: DataFrame, keys: list[str]) -> DataFrame:
    """All stored parts in order (Q3): blocks, size, and the tag with the number of blocks as its suffix (Q2)."""
    ordered = F.array_sort(F.collect_list(F.struct("part_number", "etag", "blocks", "size")))
    made = parts.groupBy(*keys).agg(ordered.alias("p"))
    blocks = F.flatten(F.transform("p", lambda x: x["blocks"]))
    tags = F.array_join(F.transform("p", lambda x: x["etag"]), "")
    size = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["size"])
    return made.select(*keys, blocks.alias("blocks"), size.alias("size"), F.concat(F.md5(F.unhex(tags)), F.lit("-"), F.size(blocks)).alias("etag"), F.size("p").alias("n_parts"))


def finish(uploads: DataFrame, parts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (bucket, upload_id, key) -> completed objects; a key that isn't the upload's is refused (status)."""
    done = complete(parts, ["bucket", "upload_id"])
    named = asked.join(uploads.withColumnRenamed("key", "stored_key"), ["bucket", "upload_id"], "left").join(done, ["bucket", "upload_id"], "left")
    status = F.when(F.col("stored_key").isNull(), "NoSuchUpload").when(F.col("stored_key") != F.col("key"), "InvalidRequest").otherwise("ok")
    return named.withColumn("status", status).drop("stored_key")
