"""Packing documents into training sequences by cutting-stock column generation.

1. Every text is tokenised once, where it lies; a document's ids are those of the tokenizers library (the vocabulary's own
   markers in a text get their ids, as its default call has it) and a closing id. What is kept are lengths and one CRC for each unit of 64 ids, so any cut at a unit gets its CRC by combination.
2. A document is full sequences of 4096 ids, one piece of 1 to 63 units, and a tail of 1 to 63 ids. The histograms of
   the two kinds of remainder (63 classes each, whatever the corpus) go to the driver.
3. A linear program over patterns is solved by column generation; a knapsack by dynamic programming prices patterns.
   For units the program may also cut an item of one class into two smaller ones at a small cost.
4. Pattern counts are rounded down. Documents are ranked within their class (bucket counts, prefix sums and a rank in
   each bucket; buckets have about the same number of rows, and there are as many as the rows need), and a rank finds its
   sequence and place in the plan. What rounding leaves, a number bounded by the
   number of patterns, is laid end to end and cut at the sequence's end.

Null texts count as empty: one id. Very long texts are tokenised whole. Null ids, repeated rows and ties: each row is a
document of its own, ranked by id then content; rows are dealt into buckets by where they were read, so that no key is hot.
No rows: no pieces. Extra columns are ignored, whatever their names.
"""
from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

VOCAB = "word_bpe_49k.json"
UNIT, UNITS = 64, 64
LENGTH = UNIT * UNITS
END_ID = 2
CACHED_WORDS = 800_000
LEAST_BUCKETS, BUCKET_ROWS = 8, 20_000
CUT_COST = 1e-3


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCAB)


# ---- ids -----------------------------------------------------------------------------------------------------------
_PLAIN = re.compile("([a-zß-öø-ɏ]+)([.,]?)")


class WordIds(dict):
    """bytes of a word between ASCII blanks -> its ids as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so words can be encoded one by one. Plain Latin words go
    to a byte-pair encoder built from the same ranks (a byte that UTF-8 never uses marks the word's end); all others go
    to the tokenizer itself. The memory is bounded: a full cache starts anew.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        marks = {t.content.encode(): struct.pack("<I", i) for i, t in self.exact.get_added_tokens_decoder().items()}
        self.marks, self.mark = marks, re.compile(b"(" + b"|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + b")") if marks else None
        letters = self._letters()
        end, ranks = "</w>", {}
        for token, number in self.exact.get_vocab(with_added_tokens=False).items():
            body = token[: -len(end)] if token.endswith(end) and len(token) > len(end) else token
            if all(c in letters for c in body) and not (token.startswith("<|") and token.endswith("|>")):
                ranks[bytes(letters[c] for c in body) + (b"\xff" if body is not token else b"")] = number
        if b"\xff" in ranks:  # the mark alone never stays alone: it joins the last byte first
            ranks[b"\xff"] = max(ranks.values()) + 1
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @staticmethod
    def _letters() -> dict[str, int]:
        """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}

    def __missing__(self, word: bytes) -> bytes:
        low = word.lower()
        if word.isascii() and low.isalpha():
            ids = self.core.encode_single_piece(low + b"\xff")
        else:
            text = word.decode()
            low = text.lower()
            plain = _PLAIN.fullmatch(low) if len(low) == len(text) and max(text) < "ɐ" else None
            if plain and plain[1].isalpha():
                ids = self.core.encode_single_piece(plain[1].encode() + b"\xff")
                if plain[2]:
                    ids = ids + self.core.encode_single_piece(plain[2].encode() + b"\xff")
            else:
                ids = self.exact.encode(text, add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> WordIds:
    return WordIds(path)


def token_bytes(text: str | None, path: str) -> bytes:
    words, data = words_of(path), (text or "").encode()
    # the library takes its markers out of the text before all else; what lies between is split into words by itself
    pieces = words.mark.split(data) if words.mark else [data]
    out = [words.marks[p] if k % 2 else b"".join(map(words.__getitem__, p.split())) for k, p in enumerate(pieces)]
    return b"".join(out) + END_ID.to_bytes(4, "little")


# ---- CRC of joined blocks ------------------------------------------------------------------------------------------
def _shift(n: int) -> np.ndarray:
    """For a CRC register: what appending n zero bytes does to each of its 32 bits."""
    base = zlib.crc32(bytes(n))
    raw = lambda c: zlib.crc32(bytes(n), c) ^ base ^ 0
    return np.array([raw(1 << i) ^ raw(0) for i in range(32)], np.uint32)


@functools.lru_cache(maxsize=128)
def _tables(n: int) -> np.ndarray:
    bits, out = _shift(n), np.zeros((4, 256), np.uint32)
    for k in range(4):
        for v in range(256):
            for i in range(8):
                if v >> i & 1:
                    out[k, v] ^= bits[8 * k + i]
    return out


def crc_join(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """CRCs of A + B from theirs; every B has n bytes."""
    t = _tables(n)
    return t[0][a & 255] ^ t[1][a >> 8 & 255] ^ t[2][a >> 16 & 255] ^ t[3][a >> 24] ^ b


# ---- linear program ------------------------------------------------------------------------------------------------
def _price(worth: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern that is worth most."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = sizes <= c
        got = np.where(fits, worth + best[np.maximum(c - sizes, 0)], -1)
        i = int(got.argmax())
        best[c], took[c] = best[c - 1], -1
        if got[i] > best[c] + 1e-12:
            best[c], took[c] = got[i], i
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return best[room], pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, cuts: bool) -> list[tuple[np.ndarray, float]]:
    """Columns in use and how often. A column's positive entries are items it takes; with cuts, a column that takes
    one item and has two (or one doubled) negative entries makes smaller items of it."""
    m = len(sizes)
    columns = [np.eye(m)[i] * (room // sizes[i]) for i in range(m)]
    cost = np.ones(m)
    inverse = np.diag([1 / columns[i][i] for i in range(m)])
    x = inverse @ demand
    at = {int(s): i for i, s in enumerate(sizes)}
    ways = [(i, at[int(b)], at[int(s - b)]) for i, s in enumerate(sizes) for b in sizes if b <= s - b and int(s - b) in at] if cuts else []
    w = np.array(ways).reshape(-1, 3)
    for _ in range(20_000):
        y = cost @ inverse
        enter, price = None, 1.0
        if y.min() < -1e-9:
            enter, price = -np.eye(m)[int(y.argmin())], 0.0
        if enter is None and len(w):
            gain = y[w[:, 0]] - y[w[:, 1]] - y[w[:, 2]]
            k = int(gain.argmax())
            if gain[k] > CUT_COST + 1e-9:
                enter, price = np.zeros(m), CUT_COST
                enter[w[k, 0]] += 1
                enter[w[k, 1]] -= 1
                enter[w[k, 2]] -= 1
        if enter is None:
            worth, pattern = _price(y, sizes, room)
            if worth <= 1 + 1e-7:
                break
            enter = pattern
        u = inverse @ enter
        ok = u > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, u, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * u, 0)
        x[r] = step
        pivot = inverse[r] / u[r]
        inverse = inverse - np.outer(u, pivot)
        inverse[r] = pivot
        columns[r], cost[r] = enter, price
    return [(c, v) for c, v in zip(columns, x, strict=True) if v > 0 and c.max() > 0]


class Plan:
    """Where the item with a class and a rank goes. Its size depends on the classes, not on the corpus."""

    def __init__(self, full: int, units: np.ndarray, tails: np.ndarray):
        self.full, at = full, full
        self.units, at = self._phase(units, UNITS, True, at)
        self.tails, at = self._phase(tails, LENGTH, False, at)

    def _phase(self, have: np.ndarray, room: int, cuts: bool, at: int):
        """have[s]: items of size s. For each size a list of (first rank, count, kind, ...)."""
        used = np.flatnonzero(have)
        sizes = np.arange(1, (used.max() if len(used) else 0) + 1) if cuts else used
        ways: dict[int, list] = {int(s): [] for s in sizes}
        stock = {int(s): int(have[s]) for s in sizes}
        taken = {int(s): 0 for s in sizes}
        if len(sizes):
            got = [(c, int(v + 1e-6)) for c, v in solve(sizes, have[sizes].astype(float), room, cuts)]
            for c, n in sorted(((c, n) for c, n in got if c.min() < 0 and n), key=lambda g: -int(sizes[g[0].argmax()])):
                i = int(sizes[c.argmax()])
                n = min(n, stock[i] - taken[i])
                parts = [int(sizes[k]) for k in np.flatnonzero(c < 0) for _ in range(int(-c[k]))]
                if n > 0:
                    a, b = parts
                    first = (stock[a], stock[b] if a != b else stock[a] + n)
                    ways[i].append((taken[i], n, "cut", a, first[0], b, first[1]))
                    taken[i] += n
                    stock[a] += n
                    stock[b] += n
            for c, n in got:
                if c.min() < 0:
                    continue
                where = [(int(sizes[k]), int(c[k])) for k in np.flatnonzero(c)]
                n = min([n, *((stock[s] - taken[s]) // k for s, k in where)])
                offset = 0
                for s, k in where if n > 0 else ():
                    ways[s].append((taken[s], n * k, "pattern", at, k, offset, 0))
                    taken[s] += n * k
                    offset += s * k
                at += max(n, 0)
        rest: dict[int, tuple] = {}
        if cuts:
            linear = 0
            for s in map(int, sizes[::-1]):
                rest[s] = (taken[s], at, linear)
                linear += (stock[s] - taken[s]) * s
            self.open = (at + linear // room, linear % room * UNIT) if linear % room else (at + linear // room, 0)
            at += -(-linear // room)
        else:
            sequence, fill = self.open
            for s in map(int, sizes[::-1]):
                places = []
                for _ in range(stock[s] - taken[s]):
                    if fill + s > room:
                        sequence, fill = sequence + 1 if sequence + 1 >= at or sequence >= at else at, 0
                    places.append((sequence, fill))
                    fill += s
                    at = max(at, sequence + 1)
                rest[s] = (taken[s], np.array(places, np.int64).reshape(-1, 2))
        return (ways, rest), at

    def place_units(self, size: np.ndarray, rank: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[tuple]:
        """Arrays (doc, first unit, units, sequence, unit offset)."""
        ways, rest = self.units
        out = []
        for s in range(UNITS - 1, 0, -1):
            now = size == s
            if not now.any():
                continue
            r, d, st = rank[now], doc[now], start[now]
            keep = ~now
            size, rank, doc, start = size[keep], rank[keep], doc[keep], start[keep]
            for first, n, kind, *more in ways[s]:
                hit = (r >= first) & (r < first + n)
                k = r[hit] - first
                if kind == "pattern":
                    at, per, offset, _ = more
                    out.append((d[hit], st[hit], np.full(len(k), s), at + k // per, offset + k % per * s))
                else:
                    a, fa, b, fb = more
                    size = np.concatenate([size, np.full(len(k), a), np.full(len(k), b)])
                    rank = np.concatenate([rank, fa + k, fb + k])
                    doc = np.concatenate([doc, d[hit], d[hit]])
                    start = np.concatenate([start, st[hit], st[hit] + a])
            first, at, linear = rest[s]
            hit = r >= first
            begin = linear + (r[hit] - first) * s
            one = np.minimum(s, UNITS - begin % UNITS)
            out.append((d[hit], st[hit], one, at + begin // UNITS, begin % UNITS))
            two = one < s
            out.append((d[hit][two], st[hit][two] + one[two], s - one[two], at + begin[two] // UNITS + 1, np.zeros(two.sum(), np.int64)))
        return out

    def place_tails(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ways, rest = self.tails
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            now = np.flatnonzero(size == s)
            r = rank[now]
            for first, n, _, at, per, offset, _ in ways[int(s)]:
                hit = (r >= first) & (r < first + n)
                k = r[hit] - first
                seq[now[hit]], off[now[hit]] = at + k // per, offset + k % per * s
            first, places = rest[int(s)]
            hit = r >= first
            if hit.any():
                got = places[r[hit] - first]
                seq[now[hit]], off[now[hit]] = got[:, 0], got[:, 1]
        return seq, off


# ---- operator ------------------------------------------------------------------------------------------------------
def token_lengths(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n ids, CRC of each unit and of the tail, spread): spread is a hash of the row's place in the table."""

    def run(batches):
        for b in batches:
            n, crcs = [], []
            for text in b.column(1).to_pylist():
                ids = token_bytes(text, path)
                n.append(len(ids) // 4)
                crcs.append(np.array([zlib.crc32(ids[i : i + 4 * UNIT]) for i in range(0, len(ids), 4 * UNIT)], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.binary())], names=["id", "n", "crcs"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, crcs binary")
    return out.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    path = path or default_vocab()
    scratch = scratch or Scratch(spark, "packing")
    made = scratch.put(token_lengths(docs, path, id_col, text_col), "lengths")
    buckets = made.count() // BUCKET_ROWS + LEAST_BUCKETS
    made = made.withColumn("bucket", F.pmod("spread", F.lit(buckets))).drop("spread")
    entry = lambda c, v: F.struct(F.expr(c).cast("int").alias("c"), F.expr(v).cast("long").alias("v"))
    entries = F.array(entry(f"n % {LENGTH} div {UNIT}", "1"), entry(f"n % {UNIT} + {UNITS}", "1"), entry(f"{2 * UNITS}", f"n div {LENGTH}"))
    counted = scratch.put(made.select("bucket", F.explode(entries).alias("e")).groupBy("bucket", "e.c").agg(F.sum("e.v").alias("v")), "counts")
    # 129 numbers, whatever the corpus
    total = np.zeros(2 * UNITS + 1, np.int64)
    for c, v in counted.groupBy("c").agg(F.sum("v")).collect():
        total[c] = v
    units, tails = total[:UNITS].copy(), total[UNITS : 2 * UNITS].copy()
    units[0] = tails[0] = 0
    plan = Plan(int(total[-1]), units, tails)
    # how many of a class the buckets before hold: a row a bucket, in a window a class
    earlier = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("bucket", "c", F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("v"))

    def place(pdf: pd.DataFrame, bases: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "n", "crcs"], kind="stable", ignore_index=True)
        n, base = pdf["n"].to_numpy(), np.zeros(2 * UNITS + 1, np.int64)
        base[bases["c"]] = bases["v"]
        full, units, tail = n // LENGTH, n % LENGTH // UNIT, n % UNIT
        blocks = [np.frombuffer(x, "<u4") for x in pdf["crcs"]]
        first = np.concatenate([[0], np.cumsum([len(x) for x in blocks])])
        flat = np.concatenate(blocks)
        rank = lambda c: base[c] + pd.Series(c).groupby(c).cumcount().to_numpy()
        docs_ = np.arange(len(n))
        d0 = np.repeat(docs_, full)
        begin = np.arange(len(d0)) - np.repeat(np.cumsum(full) - full, full)
        parts = [(d0, begin * UNITS, np.full(len(d0), UNITS), base[-1] + np.arange(len(d0)), np.zeros(len(d0), np.int64))]
        ranks, some = rank(units), units > 0
        parts += plan.place_units(units[some], ranks[some], docs_[some], full[some] * UNITS)
        d, st, ln, seq, off = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        crc = flat[first[d] + st] if len(d) else np.zeros(0, np.uint32)
        for k in range(1, UNITS):
            more = ln > k
            crc[more] = crc_join(crc[more], flat[first[d[more]] + st[more] + k], 4 * UNIT)
        some = tail > 0
        t = docs_[some]
        tseq, toff = plan.place_tails(tail[some], rank(tail + UNITS)[some])
        at = np.concatenate([d, t])
        return pd.DataFrame({
            id_col: pdf["id"].take(at).array,
            "start": np.concatenate([st * UNIT, n[some] - tail[some]]),
            "length": np.concatenate([ln * UNIT, tail[some]]),
            "ids_crc32": np.concatenate([crc, flat[first[t + 1] - 1]]).astype(np.int64),
            "doc_tokens": n[at],
            "sequence_id": np.concatenate([seq, tseq]),
            "offset": np.concatenate([off * UNIT, toff]),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    return made.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInPandas(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
