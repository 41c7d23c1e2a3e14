"""From documents to packed sequences: each stage takes what the one before kept, written as Parquet and read again.

run() with STAGES: quality classifier (rejected documents go), line dedup (later copies of a line go from the text), SimHash
near-dedup (of each component the smallest id stays; of rows that share it, one), secret scans (spans are masked), packing
(pieces of sequences). All but the last return the columns of their input, whatever their names; n_chars follows the text.

Every stage takes null ids and texts, empty and very long texts, repeated rows and empty tables; what each makes of them is
said there and in its operator. A null text counts as empty and stays null until it is packed. An empty table gives one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import line_dedup, packing, quality_mil, secrets, simhash
from stratum.llm.common import Scratch, table, unused

#: Training, union-find and packing plans aren't SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, as they are. It learns from labels of its own input's documents; without
    labels of both kinds all stay. Each row is judged by itself, so repeated rows stay or go together."""
    return quality_mil.keep(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document or place has; a text may end up empty. Repeated rows get the
    same text."""
    return _sized(line_dedup.dedup_lines(docs, counts=None), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id. Rows that repeat its id and text are
    one document; rows without an id stay if a component has no other."""
    # a row is named by id and text, so that ids that repeat or are missing don't stand for rows of other components
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("th"))
    (name,) = unused(docs.columns, "key")
    named = docs.withColumn(name, key)
    found = simhash.near_duplicates(named, name)
    stays = found.where(F.col(name) == F.col("component_id")).select(name).distinct()
    joined = named.join(stays, name, "left_semi")
    return joined.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text, whatever its length; each row by itself."""
    return _sized(secrets.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: every row is a document, an empty or null text has one id."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("secrets", masked), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)  # its last reader is done
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

