"""Snapshot tables and blobs on any file system Spark reaches (SRC1, SRC2, SRC5-SRC15, SNK1-SNK6)."""
from __future__ import annotations

import re
import tempfile
import uuid
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="stratum-")


class Store:
    """Tables as Parquet snapshots: a write makes a new version, so readers never see a half-written one."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self.at = spark, root or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", {}

    def read(self, name: str) -> DataFrame:
        if name not in self.at:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self.at[name])

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]]
        df.select(*columns).write.parquet(path)
        self.at[name] = path
        return self.read(name)

    def vacuum(self) -> None:
        """Removes the versions that are no longer read. Not while a frame read from an older one is in use."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name, path in self.at.items():
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            files = folder.getFileSystem(conf)
            for status in files.listStatus(folder):
                if status.getPath().getName() != path.rsplit("/", 1)[1]:
                    files.delete(status.getPath(), True)

    def append(self, name: str, df: DataFrame) -> None:
        """SNK3: the fact log only grows."""
        path = self.at.setdefault(name, f"{self.root}/{name}/{uuid.uuid4().hex}")
        df.select(*TABLES[name].fieldNames()).write.mode("append").parquet(path)


class BlobStore(Protocol):
    def put(self, blocks: DataFrame) -> None: ...
    def get(self, hashes: DataFrame) -> DataFrame: ...
    def delete(self, hashes: DataFrame) -> None: ...


class ParquetBlobs:
    """SNK1: (hash, data) by the hash's first byte, so a lookup reads few folders; missing blocks are just absent. delete
    rewrites the folders that hold the blocks that go, each once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, blocks: DataFrame) -> None:
        blocks.select("hash", "data", F.substring("hash", 1, 2).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(self.path)

    def held(self) -> DataFrame:
        try:
            return self.spark.read.schema("hash string, data binary, prefix string").parquet(self.path)
        except AnalysisException:  # nothing has been put yet
            return self.spark.createDataFrame([], "hash string, data binary, prefix string")

    def get(self, hashes: DataFrame) -> DataFrame:
        wanted = hashes.select("hash", F.substring("hash", 1, 2).alias("prefix")).distinct()
        return self.held().join(wanted, ["prefix", "hash"], "left_semi").select("hash", "data").dropDuplicates(["hash"])

    def delete(self, hashes: DataFrame) -> None:
        gone = hashes.select("hash", F.substring("hash", 1, 2).alias("prefix")).distinct()
        touched = [r[0] for r in gone.select("prefix").distinct().collect()]  # 256 at most
        left = self.held().where(F.col("prefix").isin(touched)).join(gone, ["prefix", "hash"], "left_anti")
        aside = f"{self.path}-{uuid.uuid4().hex}"
        left.select("hash", "data", "prefix").write.partitionBy("prefix").parquet(aside)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)
        for p in touched:
            old, new = (jvm.org.apache.hadoop.fs.Path(f"{root}/prefix={p}") for root in (self.path, aside))
            files.delete(old, True)
            if files.exists(new):
                files.rename(new, old)
        files.delete(jvm.org.apache.hadoop.fs.Path(aside), True)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Raw block files: (path, body)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"))
