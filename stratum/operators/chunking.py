"""Chunks of bodies, content addresses and block dedup (CH1-CH6, AG7, JN10)."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.scalar import digest

_GEAR_SEED = 20


def fixed(bodies: DataFrame, size: int, body: str = "body") -> DataFrame:
    """CH2: all other columns, pos and data; an empty body has no chunks. Offsets are bytes."""
    rest = [c for c in bodies.columns if c != body]
    cut = F.when(F.octet_length(body) > 0, F.sequence(F.lit(0), F.octet_length(body) - 1, F.lit(size)))
    return bodies.select(*rest, body, F.posexplode(cut).alias("pos", "at")).select(*rest, "pos", F.substring(body, F.col("at") + 1, F.lit(size)).alias("data"))


def _gear() -> np.ndarray:
    return np.random.default_rng(_GEAR_SEED).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of the chunks: a gear hash of the last 32 bytes at every place at once; before the average size a place needs two
    more zero bits than log2 of it, after it two fewer (normalised chunking)."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return []
    h, have = _gear()[b], 1
    while have < 32:
        shifted = np.zeros_like(h)
        shifted[have:] = h[:-have] << np.uint32(have)
        h, have = h + shifted, 2 * have
    bits = max(1, average.bit_length() - 1)
    top = lambda n: np.flatnonzero(h >> np.uint32(32 - min(n, 31)) == 0) + 1
    strict, loose, out, at = top(bits + 2), top(max(1, bits - 2)), [], 0
    while len(b) - at > least:
        middle, end = min(at + average, len(b)), min(at + most, len(b))
        i = int(np.searchsorted(strict, at + least))
        if i < len(strict) and strict[i] < middle:
            end = int(strict[i])
        else:
            i = int(np.searchsorted(loose, max(middle, at + least)))
            if i < len(loose) and loose[i] < end:
                end = int(loose[i])
        out.append(end)
        at = end
    return out + ([len(b)] if at < len(b) else [])


def content_defined(bodies: DataFrame, least: int, average: int, most: int, body: str = "body") -> DataFrame:
    """CH3: as fixed(), cut by content. Sequential within a body, so Arrow batches of bodies."""
    rest = [f for f in bodies.schema if f.name != body]
    kind = T.StructType([*rest, T.StructField("pos", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(batches):
        for b in batches:
            rows, pos, data = [], [], []
            for i, raw in enumerate(b.column(len(rest)).to_pylist()):
                ends = cut_points(raw or b"", least, average, most)
                for k, (a, z) in enumerate(zip([0, *ends], ends, strict=False)):
                    rows.append(i)
                    pos.append(k)
                    data.append(raw[a:z])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(len(rest))], pa.array(pos, pa.int32()), pa.array(data, pa.binary())], names=[*[f.name for f in rest], "pos", "data"])

    return bodies.select(*[f.name for f in rest], body).mapInArrow(run, kind)


def chunks(bodies: DataFrame, config: Config) -> DataFrame:
    """CH4."""
    if config.chunking == "fixed":
        return fixed(bodies, config.chunk_size)
    return content_defined(bodies, config.cdc_min, config.cdc_avg, config.cdc_max)


def ends_of(data: bytes, config: Config) -> list[int]:
    if config.chunking == "fixed":
        return [*range(config.chunk_size, len(data), config.chunk_size), len(data)] if data else []
    return cut_points(data, config.cdc_min, config.cdc_avg, config.cdc_max)


def process(carried: bytes, data: bytes, config: Config) -> tuple[list[bytes], bytes]:
    """CH1: the chunks that more bytes can't change, and what is carried on. A chunk that ends with the bytes so far may
    grow, so it is carried; finalize by taking the carried bytes as the last chunk. Chunks are those of the whole body, if
    the least size is 32 bytes or more (a cut looks at that many)."""
    body = carried + data
    ends = ends_of(body, config)
    if not ends:
        return [], b""
    cuts = [0, *ends[:-1]]
    return [body[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)], body[cuts[-1] :]


def chunk_stream(pieces: DataFrame, config: Config) -> DataFrame:
    """CH1 on a stream: (key, seq, data, last) -> (key, pos, data). A body's pieces come in order of batches, and of seq within
    one; the one with `last` ends it. The state of a body is the bytes of one chunk at most."""

    def step(key, frames, state):
        carried, pos = state.get if state.exists else (b"", 0)
        rows, over = [], False
        for f in sorted((r for frame in frames for r in frame.itertuples()), key=lambda r: r.seq):
            done, carried = process(bytes(carried), bytes(f.data or b""), config)
            rows += done
            over = over or bool(f.last)
        if over and len(carried):
            rows.append(bytes(carried))
        if over:
            state.remove()
        else:
            state.update((bytes(carried), pos + len(rows)))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "pos": [pos + i for i in range(len(rows))], "data": rows})

    return pieces.groupBy("key").applyInPandasWithState(step, "key string, pos int, data binary", "carried binary, pos int", "append", "NoTimeout")


def addressed(pieces: DataFrame) -> DataFrame:
    return pieces.withColumns({"hash": digest(F.col("data")), "size": F.octet_length("data").cast("bigint")})


def manifests(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """CH6: ordered hashes and size of each object, of addressed pieces."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "hash")))
    return pieces.groupBy(*keys).agg(F.transform(entries, lambda e: e["hash"]).alias("blocks"), F.sum("size").alias("size"))


def new_blocks(pieces: DataFrame, held: DataFrame) -> DataFrame:
    """CH5, JN10: distinct blocks that the site doesn't hold; the anti-join carries hashes, not data."""
    distinct = pieces.groupBy("hash").agg(F.first("size").alias("size"), F.count("*").alias("copies"))
    return distinct.join(held.select("hash").distinct(), "hash", "left_anti")
