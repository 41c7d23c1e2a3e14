"""Shared helpers: tables, shared scratch storage and row keys."""
from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode (tests), where driver and tasks share it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="stratum-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: While an intermediate table is written: its shuffle files go when it stands, and a join whose side has been measured to
#: be small in every task may keep that side in memory instead of sorting both (larger ones sort and spill).
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root, self.names = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", []
        atexit.register(self.drop)

    def put(self, df: DataFrame, name: str, small: bool = True) -> DataFrame:
        """small=False: joins aren't planned as broadcasts for a side that happens to be small (hints still count)."""
        path = f"{self.root}/{name}"
        with settings(self.spark, _WRITING if small else _WRITING | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
            df.write.option("compression", "zstd").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """These tables (a name that ends with * stands for all that begin so), or all."""
        own = [n for name in names for n in ([k for k in self.names if k.startswith(name[:-1])] if name.endswith("*") else [name])]
        try:
            jvm = self.spark._jvm
            for name in own if names else ("",):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: the folder's owner cleans it
            pass


def unused(columns: list[str], *stems: str) -> list[str]:
    """Names like the stems that none of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is hot if more than one row in SHARE has it; there are fewer than SHARE such keys, whatever the data.
SHARE, FEW = 1_000, 1_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """left join right on keys, where right has one row a key and n tells how many of left's total rows have it.

    Hot keys' rows on the right are broadcast (fewer than SHARE of them), and left's rows stay where they are; all others
    meet by hash. left is read once."""
    rest = [c for c in right.columns if c not in (*keys, n)]
    one = F.struct(F.lit(True).alias("met"), *rest)
    named = [f"__k{i}" for i in range(len(keys))]
    side = right.select(*[F.col(k).alias(name) for k, name in zip(keys, named, strict=True)], one.alias("__one"), n)
    busy = side.where(F.col(n) > max(total // SHARE, FEW)).drop(n)
    if busy.isEmpty():
        return left.join(right.drop(n), keys)
    on = lambda x, y: functools.reduce(Column.__and__, [x[k] == y[name] for k, name in zip(keys, named, strict=True)])
    few = busy.withColumnRenamed("__one", "__few")
    marked = left.join(F.broadcast(few), on(left, few), "left").drop(*named)
    # rows with a hot key are dealt by a hash of their own, and find nothing there
    deal = F.when(F.col("__few").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(SHARE)).cast("int"))
    marked = marked.withColumn("__deal", deal)
    # always 0, but no constant: as one it would be folded away, and hot rows would meet by their key after all
    none = F.pmod(F.xxhash64(named[0]), F.lit(1)).cast("int")
    met = marked.join(side.drop(n).withColumn("__none", none), on(marked, side) & (F.col("__deal") == F.col("__none")), "left")
    found = met.withColumn("__one", F.coalesce("__few", "__one")).where(F.col("__one").isNotNull())
    return found.select(*left.columns, *[F.col(f"__one.{c}").alias(c) for c in rest])


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def crc_fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
