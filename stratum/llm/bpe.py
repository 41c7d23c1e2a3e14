"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before tokenising, at places where a match of the splitting pattern always ends: between a
visible ASCII character and a following space or line feed. The ids are those of the whole text; memory and time
per call stay bounded. Null texts count as empty; an empty text has no ids. Null ids, repeated rows, ties and
extra columns pass through: every row is encoded by itself.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 1 << 16
_SAFE = re.compile(r"[!-~](?=[ \n])")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split_safe(text: str, size: int = CHUNK) -> list[str]:
    """Cuts of about `size` characters or more whose ids, joined, are the text's."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.end()])
        at = found.end()
    out.append(text[at:])
    return out


def encode(text: str, path: str) -> np.ndarray:
    enc = encoder(path)
    parts = [enc.encode_to_numpy(x, disallowed_special=()) for x in split_safe(text) if x]
    return np.concatenate(parts).astype("<u4", copy=False) if parts else np.zeros(0, "<u4")


def decode(ids: np.ndarray, path: str) -> bytes:
    return encoder(path).decode_bytes(ids.tolist())


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row."""
    path = path or default_ranks()

    def run(batches):
        for b in batches:
            ids = [encode(t or "", path).astype(np.int32) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) per row: raw bytes, so ids that end inside a character decode too."""
    path = path or default_ranks()

    def run(batches):
        for b in batches:
            got = [encoder(path).decode_bytes(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def bpe_roundtrip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of both directions in one pass, so that ids needn't travel between processes."""
    path = path or default_ranks()

    def run(batches):
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = encode(t or "", path)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                d.append(hashlib.sha256(decode(ids, path)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text")))
