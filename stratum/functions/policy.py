"""Policy evaluation without UDFs (FLT11, FLT12, UD1, API20, API25, SRC13)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The actions of each preset.
PRESETS = {
    "admin": ["s3:*"],
    "readonly": ["s3:GetObject", "s3:HeadObject", "s3:ListBucket", "s3:ListAllMyBuckets", "s3:ListMultipartUploadParts", "s3:ListBucketMultipartUploads"],
    "readwrite": ["s3:GetObject", "s3:HeadObject", "s3:PutObject", "s3:DeleteObject", "s3:ListBucket", "s3:ListAllMyBuckets", "s3:CreateBucket", "s3:DeleteBucket", "s3:AbortMultipartUpload", "s3:ListMultipartUploadParts", "s3:ListBucketMultipartUploads"],
}


def matches(pattern: Column, value: Column) -> Column:
    """'*' is all, a trailing '*' a prefix, anything else itself."""
    head = pattern.endswith("*") & value.startswith(F.substring(pattern, F.lit(1), F.length(pattern) - 1))
    return (pattern == "*") | head | (pattern == value)


def allowed(policy: Column, action: Column, resource: Column) -> Column:
    """A matching Deny wins in any order; else a matching Allow; else no. Other effects don't count."""
    hit = lambda s: F.exists(s["actions"], lambda a: matches(a, action)) & F.exists(s["resources"], lambda r: matches(r, resource))
    some = lambda effect: F.exists(policy["statements"], lambda s: (s["effect"] == effect) & hit(s))
    return F.coalesce(~some("Deny") & some("Allow"), F.lit(False))


def preset(name: str, bucket: Column | None = None) -> Column:
    """One Allow statement; a bucket scope covers all buckets that start with its name, as the reference data does (Q15)."""
    where = F.lit("*") if bucket is None else F.concat(F.lit("arn:ss:bucket:::"), bucket, F.lit("*"))
    one = F.struct(F.lit("Allow").alias("effect"), F.array(*map(F.lit, PRESETS[name])).alias("actions"), F.array(where).alias("resources"))
    return F.struct(F.array(one).alias("statements"))


def authorize(asked: DataFrame, users: DataFrame) -> DataFrame:
    """asked (access_key, action, resource, ...) with `allowed` added; a key that no user has is refused (SRC13, API20)."""
    held = users.select("access_key", F.col("policy").alias("__policy"))
    rows = asked.join(held, "access_key", "left")
    return rows.withColumn("allowed", allowed(F.col("__policy"), F.col("action"), F.col("resource"))).drop("__policy")
