"""Bounded labelled samples for the classifiers, and fold bookkeeping."""
from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold


PARTS = 8


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label double) of at most `rows` documents outside the held-out fold, chosen by hash of the id. Of a text of more
    than `longest` characters, PARTS parts at even distances stand for it, together that long. Labels that are null or
    contradict each other are left out. Ids decide folds and the choice only."""
    named = labels.where(F.col(label).isin(0, 1) & (crc_fold(id_col, modulus) != held))
    agreed = named.groupBy(id_col).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a = b")
    chosen = agreed.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(F.col(id_col).alias("__id"), F.col("a").cast("double").alias("label"))
    text = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = lambda k: F.substring("text", (F.length("text").cast("long") * k / PARTS).cast("int") + 1, F.lit(longest // PARTS))
    text = text.withColumn("text", F.when(F.length("text") <= longest, F.col("text")).otherwise(F.concat_ws("\n", *[part(k) for k in range(PARTS)])))
    # at most `rows` pairs of numbers
    return text.join(F.broadcast(chosen), "__id").orderBy(F.xxhash64("__id"), "__id", "text").limit(rows).select("text", "label")


def learnt(chosen: DataFrame, fit: Callable[[list[str], np.ndarray], dict]) -> dict | None:
    """fit(texts, labels) of a bounded sample, in one task: only the model comes to the driver, and a lost executor costs
    another try. None without labels of both kinds."""

    def run(batches):
        texts, label = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            label += b.column(1).to_pylist()
        if label and min(label) < max(label):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(label, np.float32)))], pa.binary())], names=["model"])

    got = chosen.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None
