"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 majority bits of the XXH64 values of a text's 4-word shingles. Equal fingerprints are one item from then
on, so a group of copies of any size is one row. Two fingerprints within 4 bits differ, in at least one partition of the
bits, by no more than that partition's threshold, as long as the thresholds plus one sum to 5. Bits that go together (on a
bounded sample) share a partition; widths and thresholds come from dynamic programming over estimated candidates and
probes. A fingerprint has one entry under its own value in a partition and, where the threshold is one, a probe under each
value one bit away. Entries of a value are compared in numpy; a value with many entries is dealt into blocks, and pairs of
blocks are compared in tasks of their own. Only the links of a spanning forest leave a task. Every link is verified.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Very long texts are read
whole. Repeated rows and ties stay: each row gets its component. An empty table gives an empty result; extra columns are
ignored, whatever their names. A null id is never the smallest one; a component of null ids only has a null id.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_counted, table
from .components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
SAMPLE = 20_000
BLOCK = 1024
#: Cost of an entry (made, shuffled, sorted) in comparisons.
ENTRY_COST = 200


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[SHINGLE - 1 :].tolist() if len(words) >= SHINGLE else [len(whole)]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(last)
    first = starts[:n].tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(first[at : at + 65536], last[at : at + 65536], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


# ---- partitions and thresholds -------------------------------------------------------------------------------------
def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy: a partition grows by the bit that goes most with those it has."""
    centred = bits - bits.mean(0)
    scale = np.sqrt((centred**2).sum(0)) + 1e-9
    tie = np.abs(centred.T @ centred / np.outer(scale, scale))
    np.fill_diagonal(tie, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        left = sorted(free)
        own = [left[int(tie[np.ix_(left, left)].max(1).argmax())]]
        free.discard(own[0])
        while len(own) < width:
            left = sorted(free)
            own.append(left[int(tie[np.ix_(left, own)].mean(1).argmax())])
            free.discard(own[-1])
        out.append(own)
    return out


def pick(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for j, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & np.uint64(1)).astype(np.int64) << j
    return out


def allocate(sample: np.ndarray, total: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds (-1: not probed) of least estimated cost."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, 64))
    scale = (total / max(1, len(sample))) ** 2
    best: tuple = (np.inf, [], [])
    for parts in (3, 4, 5, 6):
        groups = group_bits(bits, parts)
        costs = []
        for g in groups:
            values, n = np.unique(pick(sample, g), return_counts=True)
            same = float((n.astype(float) * (n - 1)).sum() / 2)
            near = 0.0
            for j in range(len(g)):
                at = np.minimum(np.searchsorted(values, values ^ (1 << j)), max(len(values) - 1, 0))
                near += float((n * n[at] * (values[at] == values ^ (1 << j))).sum() / 2) if len(values) else 0.0
            costs.append({-1: 0.0, 0: same * scale + total * ENTRY_COST, 1: (same + 2 * near) * scale + total * (1 + len(g)) * ENTRY_COST})
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, taken) in reach.items():
                for t, more in c.items():
                    if (k := spent + t + 1) <= DISTANCE + 1 and (k not in grown or cost + more < grown[k][0]):
                        grown[k] = (cost + more, [*taken, t])
            reach = grown
        if DISTANCE + 1 in reach and reach[DISTANCE + 1][0] < best[0]:
            best = (reach[DISTANCE + 1][0], groups, reach[DISTANCE + 1][1])
    return best[1], best[2]


# ---- probe and verify ----------------------------------------------------------------------------------------------
def entries(items: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, fp, probe) of every fingerprint."""

    def run(batches):
        for b in batches:
            signed = b.column(0).to_numpy()
            fp, keys, fps, probes = signed.view(np.uint64), [], [], []
            for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
                value = pick(fp, g) if t >= 0 else None
                for flip in [0, *(1 << j for j in range(len(g)))][: 0 if t < 0 else 1 if t == 0 else None]:
                    keys.append((value ^ flip) | i << 40)
                    fps.append(signed)
                    probes.append(np.full(len(fp), flip != 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, fps, probes)], names=["key", "fp", "probe"])

    return items.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def forest(fp: np.ndarray, probe: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of those within the distance; members that are linked already aren't compared again."""
    order = np.argsort(probe, kind="stable")
    x = fp[order].view(np.uint64)
    home = int((~probe).sum())
    root, out = np.arange(len(x)), []
    for i in range(home):
        other = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        near = other[np.bitwise_count(x[other] ^ x[i]) <= DISTANCE]
        for r in np.unique(root[near]):
            k = int(near[root[near] == r][0])
            out.append((int(x[i : i + 1].view(np.int64)[0]), int(x[k : k + 1].view(np.int64)[0])))
            root[root == r] = root[i]
    return out


def links(items: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(u, v): enough of the verified links between distinct fingerprints to have the same components."""
    made = entries(items, groups, thresholds)
    counts = made.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("probe"), 1).otherwise(0)).alias("homes"))
    busy = made.join(counts.where("n > 1 and homes > 0"), "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = busy.select("key", "fp", "probe", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "probe")

    def run(batches):
        held: list[np.ndarray] = []
        tag = None

        def done():
            fp, probe = held[0], held[1]
            return forest(fp, probe.astype(bool)) if len(fp) > 1 else []

        for b in batches:
            if not b.num_rows:
                continue
            tags = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            fp, probe = b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            out = []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                now = tuple(tags[:, a].tolist())
                if now == tag:
                    held = [np.concatenate([held[0], fp[a:z]]), np.concatenate([held[1], probe[a:z]])]
                    continue
                out += done() if tag is not None else []
                tag, held = now, [fp[a:z], probe[a:z]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])
        if tag is not None and (out := done()):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    sorted_ = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return sorted_.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, fp long, component id) per row."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    made = scratch.put(fingerprints(docs, id_col, text_col), "fingerprints")
    items = scratch.put(made.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "items")
    total = items.count()
    sample = np.array([r[0] for r in items.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    found = components(links(items, *allocate(sample, total)), scratch)
    labelled = items.join(found, items["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    labelled = scratch.put(labelled, "labelled")
    scratch.drop("items", "components*")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    member = labelled.join(least, "root").select("fp", "component_id", "n")
    return join_counted(made, member, ["fp"], made.count()).select(id_col, "fp", "component_id")


def hex16(fp) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
