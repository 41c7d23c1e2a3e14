"""Approximate nearest neighbours by additive quantisation.

A vector's direction is a sum of one codeword from each of several codebooks, all of full dimension: residual k-means
trains them on a bounded sample (TRAIN_ROWS), beam search encodes every row. The norm is stored beside the codes. A query
has a table of its inner products with all codewords, so a row's approximate score is a sum of look-ups times its norm.
Rows are dealt into shards of bounded size, each row into one, by their place in the index (so that repeated rows don't
meet in one); every shard gets a copy of the queries, which follow its rows in a sorted partition and stream past them. The
shard's best rows by look-up (POOL or one in POOL_SHARE, and all that tie with the last) are scored exactly, the best k leave the task, and a ranking
per query takes the best of all shards. So an index row moves once, whatever the number of queries.

Scores are inner products in double precision of the original components, summed in their order. Vectors that are null,
zero, of another length than most, or that hold null or non-finite components take no part, nor do null ids. Rows that
share an id are rows of their own, as candidates and as queries (which then share one ranking); ties go to the smaller id. Empty tables give empty results; extra columns are ignored, whatever
their names.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

BOOKS, WORDS, ROUNDS, BEAM = 16, 256, 5, 4
TRAIN_ROWS = 16_384
SHARD_ROWS, LEAST_ROWS = 131_072, 4_096
POOL, POOL_SHARE, NEAREST = 256, 32, 20


def train(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """(books, words, dimension): k-means of what the books before leave."""
    rng, rest, books = np.random.default_rng(seed), x.copy(), []
    for _ in range(BOOKS):
        words = rest[rng.choice(len(rest), WORDS, replace=len(rest) < WORDS)].copy()
        for _ in range(ROUNDS):
            near = (rest @ words.T - 0.5 * (words**2).sum(1)).argmax(1)
            n = np.bincount(near, minlength=WORDS)
            order = np.argsort(near, kind="stable")
            filled = np.flatnonzero(n)
            words[filled] = np.add.reduceat(rest[order], (np.cumsum(n) - n)[filled], axis=0) / n[filled, None]
        near = (rest @ words.T - 0.5 * (words**2).sum(1)).argmax(1)
        rest = rest - words[near]
        books.append(words)
    return np.stack(books).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes by beam search: of all extensions of the kept sums, those with the least residual go on."""
    n = len(x)
    rest, codes, norm = x[:, None, :], np.zeros((n, 1, 0), np.uint8), (x**2).sum(1)[:, None]
    for words in books:
        width = rest.shape[1]
        loss = norm[:, :, None] - 2 * rest @ words.T + (words**2).sum(1)
        flat = loss.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        who, word = best // WORDS, best % WORDS
        rows = np.arange(n)[:, None]
        rest = rest[rows, who] - words[word]
        norm = flat[rows, best]
        codes = np.concatenate([codes[rows, who], word[:, :, None].astype(np.uint8)], axis=2)
        assert width <= beam
    return codes[np.arange(n), norm.argmin(1)]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, v array<double>) of the rows that take part."""
    v = F.col(vec_col)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return own.where(F.coalesce(fine, F.lit(False)))


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the components' order, so equal vectors have equal scores."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * query[j]
    return total


class Shard:
    """Rows of one shard, in order of their ids."""

    def __init__(self, vid: np.ndarray, v: np.ndarray, codes: np.ndarray, norm: np.ndarray, books: np.ndarray):
        order = np.argsort(vid, kind="stable")
        self.vid, self.v, self.codes, self.norm, self.books = vid[order], v[order].astype(np.float64), np.ascontiguousarray(codes[order].T), norm[order], books

    def best(self, qid: int, q: np.ndarray, k: int, pool: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the k best."""
        look = (self.books @ q.astype(np.float32)).astype(np.float32)
        score = look[0][self.codes[0]]
        for m in range(1, len(look)):
            score += look[m][self.codes[m]]
        score *= self.norm
        score[self.vid == qid] = -np.inf
        near, pool = np.arange(len(score)), max(pool, len(score) // POOL_SHARE)
        if len(score) > pool:
            near = np.flatnonzero(score >= np.partition(score, len(score) - pool)[len(score) - pool])
        near = near[score[near] > -np.inf]
        true = exact(self.v[near], q)
        first = np.lexsort([self.vid[near], -true])[:k]
        return self.vid[near[first]], true[first]


def search(batches, books: np.ndarray, kind: type, k: int, pool: int):
    """Batches (shard, query, id, v, codes, norm), sorted by shard and by query: a shard's rows, then its queries."""
    now, held, shard = None, [], None
    dim = books.shape[2]
    for b in batches:
        if not b.num_rows:
            continue
        tag, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = [0, *(np.flatnonzero((tag[1:] != tag[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            part = b.slice(a, z - a)
            if tag[a] != now:
                now, held, shard = tag[a], [], None
            ids = part.column(2).to_numpy()
            v = np.frombuffer(b"".join(part.column(3).to_pylist()), kind).reshape(-1, dim)
            if not asks[a]:
                codes = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(-1, BOOKS)
                held.append((ids, v, codes, part.column(5).to_numpy()))
                continue
            if shard is None and held:
                shard, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), books), []
            if shard is None:
                continue
            out = [(i, *shard.best(i, q.astype(np.float64), k, pool)) for i, q in zip(ids.tolist(), v, strict=True)]
            qid = np.repeat([i for i, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.concatenate([x for _, x, _ in out])), pa.array(np.concatenate([x for *_, x in out]))], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, query_every: int = 20, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding", pool: int = POOL, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by query_every."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    rows = usable(vectors, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, total = int(common["d"]), int(common["count"])
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).select("v").toPandas()["v"]
    x = np.stack(sample.to_numpy())
    x = (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)
    books = train(x)

    def coded(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(-1, dim)
            norm = np.sqrt((v**2).sum(1))
            unit = (v / norm[:, None]).astype(np.float32)
            codes = np.concatenate([encode(unit[i : i + 512], books) for i in range(0, len(unit), 512)])
            raw = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())  # as exact as the column itself
            yield pa.RecordBatch.from_arrays([b.column(0), raw, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32))], names=["id", "v", "codes", "norm"])

    index = rows.mapInArrow(coded, "id long, v binary, codes binary, norm float").withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    index = scratch.put(index, "index")
    # as many as the rows need; more, while they aren't small, to keep the cluster busy
    shards = max(-(-total // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    none = [F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm")]
    asked = index.where(F.pmod("id", F.lit(query_every)) == 0).select(every.alias("shard"), F.lit(1).alias("query"), "id", "v", *none)
    held = index.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("query"), "id", "v", "codes", "norm")
    dealt = held.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    found = dealt.mapInArrow(lambda batches: search(batches, books, kind, k, pool), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
