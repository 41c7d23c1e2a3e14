"""Exact substring dedup by seed and extend.

A window is SPAN consecutive words. It goes if its word sequence starts earlier somewhere: in a smaller document, or in the
same one before. Words of windows that go are removed; windows are judged on the input.

1. Seeds: a window's anchor is the smallest hash of its SEED-word sequences (winnowing). Equal windows have equal anchors.
   Windows in a row with one anchor in one place are a run, and a run's context is all its words: one window and its extensions both
   ways as far as the anchor holds.
2. Runs are grouped by anchor and context (128 bits). Every later run of a group repeats the first one: all its windows go,
   as do neighbouring runs of a longer repeat, so a match of any length is found at every anchor it holds.
3. Where an anchor has several contexts, which is at the ends of a repeat, the first run of each context sends its windows
   (128-bit hashes) to a minimum by window. Windows that aren't the minimum go.
4. The windows that go are joined to their documents as ranges; overlapping ranges are maximal repeats.

Groups only ever meet in combined minima and counts, never as a list, so a passage that a third of all documents share
costs each of its copies one row. Hot anchors, contexts and windows are joined where their rows lie (common.join_counted).
Windows whose anchors occur once never leave their task.

Null texts have no words. A null id comes before all others. Rows with equal id and text count as one document; rows with
equal id and other text are ordered by the text's hash. Documents with fewer than SPAN words keep all. Extra columns are
ignored, whatever their names. Very long texts are read whole. No rows: no result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, join_counted, table

SPAN, SEED = 20, 6
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTE = [_mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * np.uint64(_ODD[0])) for k in (0, 1)]


def word_hashes(text: str | None) -> tuple[int, list[np.ndarray]]:
    """Number of words and two 64-bit hashes of each, all words at once: sums over a word's bytes, weighted by place."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return 0, [np.zeros(0, np.uint64)] * 2
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return 0, [np.zeros(0, np.uint64)] * 2
    size = end - start
    solid = data[~blank]
    first = np.cumsum(size) - size
    place = np.arange(len(solid)) - np.repeat(first, size)
    out = []
    for k in (0, 1):
        odd = _ODD[k]
        power = np.array([pow(odd, i, 2**64) for i in range(int(min(size.max(), 4096)))], np.uint64)
        weight = power[place % len(power)] + (place // len(power)).astype(np.uint64) * np.uint64(odd)
        out.append(_mix(np.add.reduceat(_BYTE[k][solid] * weight, first) + size.astype(np.uint64) * np.uint64(_ODD[1 - k])))
    return n, out


def chain(h: np.ndarray, n: int, odd: int) -> np.ndarray:
    """Hash of each n consecutive entries."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(odd) + h[i : len(h) - n + 1 + i]
    return _mix(out)


def slide_min(x: np.ndarray, n: int) -> np.ndarray:
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(h: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """anchor, context (two), first window, number of windows of each run."""
    seeds = chain(h[0], SEED, _ODD[0])
    anchor = slide_min(seeds, SPAN - SEED + 1)
    # a run ends where its anchor's place falls out of the window, too: so no two windows of a run are equal
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seeds[: len(anchor) - 1] == anchor[:-1])]))
    n = np.diff(np.concatenate([first, [len(anchor)]]))
    context = []
    for k in (0, 1):
        w = chain(h[k], SPAN, _ODD[k])
        # the sum over a run of its windows' hashes, weighted by place
        place = np.arange(len(w), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64)
        context.append(_mix(np.add.reduceat(w * _mix(place * np.uint64(2) + np.uint64(_ODD[k])), first) + n.astype(np.uint64)))
    return anchor[first], context[0], context[1], first, n


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def seed_runs(own: DataFrame) -> DataFrame:
    """(anchor, c0, c1, id, th, start, n) of every run."""

    def run(batches):
        for b in batches:
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts, rows = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                n, h = word_hashes(text)
                if n >= SPAN:
                    parts.append(runs(h))
                    rows.append(np.full(len(parts[-1][0]), i))
            if parts:
                a, c0, c1, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), c0.view(np.int64), c1.view(np.int64), ids[at], ths[at], first.astype(np.int32), n.astype(np.int32))], names=["anchor", "c0", "c1", "id", "th", "start", "n"])

    return own.mapInArrow(run, "anchor long, c0 long, c1 long, id long, th long, start int, n int")


def windows_of(asked: DataFrame) -> DataFrame:
    """(id, th, text, ranges of windows) -> (w0, w1, id, th, start)."""

    def run(batches):
        for b in batches:
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            out, rows, places = [], [], []
            for i, (text, ranges) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                _, h = word_hashes(text)
                w = [chain(x, SPAN, o) for x, o in zip(h, _ODD, strict=True)]
                at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in ranges])
                out.append(np.stack([w[0][at], w[1][at]]))
                rows.append(np.full(len(at), i))
                places.append(at)
            if out:
                w, at = np.concatenate(out, axis=1), np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w[0].view(np.int64), w[1].view(np.int64), ids[at], ths[at], np.concatenate(places).astype(np.int32))], names=["w0", "w1", "id", "th", "start"])

    return asked.mapInArrow(run, "w0 long, w1 long, id long, th long, start int")


def repeats(own: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, th, gone array<struct<start, n>>): ranges of windows that go."""
    made = scratch.put(seed_runs(own), "runs")
    place = F.struct("id", "th", "start")
    # anchors that occur once are left out first; of the others, the first run of each context
    often = scratch.put(made.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "often")
    met = scratch.put(join_counted(made, often, ["anchor"], made.count(), "k"), "met")
    scratch.drop("runs", "often")
    first = scratch.put(met.groupBy("anchor", "c0", "c1").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.count("*").alias("k")), "first")
    again = join_counted(met, first.select("anchor", "c0", "c1", "first", "k"), ["anchor", "c0", "c1"], met.count(), "k").where(place != F.col("first")).select("id", "th", "start", "n")
    several = scratch.put(first.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "several")
    asked = join_counted(first.select("anchor", "first", "n"), several, ["anchor"], first.count(), "k").select("first.*", "n").groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    windows = scratch.put(windows_of(own.join(asked, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "th", "text", "ranges")), "windows")
    least = scratch.put(windows.groupBy("w0", "w1").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1"), "least")
    later = join_counted(windows, least, ["w0", "w1"], windows.count(), "k").where(place != F.col("first")).select("id", "th", "start", F.lit(1).alias("n"))
    return again.union(later).groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("gone"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row; the kept words joined by one space are hashed where they are."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    gone = scratch.put(repeats(_keys(docs, id_col, text_col), scratch), "gone")
    scratch.drop("met", "first", "several", "windows", "least")
    marked = docs.select(F.col(id_col).alias("__own"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    joined = marked.join(gone, ["id", "th"], "left").select("__own", "text", "gone")

    def run(batches):
        for b in batches:
            n, removed, digest = [], [], []
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                for r in ranges or ():
                    step[r["start"]] += 1
                    step[r["start"] + r["n"] + SPAN - 1] -= 1
                keep = np.cumsum(step)[:-1] == 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if ranges else words
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
