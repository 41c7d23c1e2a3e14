"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded from the mean vectors of its hashed words and of its
hashed runs of four bytes, blanks included, and from counts over its bytes and words (character classes, word lengths,
distinct and repeated words). The vectors, an encoder layer, gated attention and a logistic layer are trained together in
numpy from document labels; a document's score is that of the attention-weighted sum of its passages' encodings. Every
passage of every text is encoded, in blocks of bounded size, so very long texts take no more memory than their bytes.

The model is fitted on at most TRAIN_ROWS labelled documents outside the held-out fold; of one of more than LONGEST
characters, on parts of it (labelled.sample). Null and empty texts are one passage without words. Without labels of both
kinds every score is 0.5. Null ids fall in the fold of the empty text. Repeated rows, ties and extra columns: each row is
scored by itself. An empty table gives an empty one.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, table
from .labelled import learnt, sample

PASSAGE, HIDDEN, GATE = 48, 24, 12
BUCKETS, DIM = 4_096, 8
TRAIN_ROWS, LONGEST, EPOCHS, STEPS, BAGS = 4_000, 20_000, 12, 400, 64
MODULUS, HELD, LIMIT = 4, 2, 0.7
GROUP, BLOCK = 256, 2_048


def _in(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[[ord(c) for c in chars]] = 1
    return out


_CLASSES = [_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _in("abcdefghijklmnopqrstuvwxyz"), _in("0123456789"), _in(".,;:'\"()-?"), _in("!"), _in("#*$%&<>@^~_=+\\/{}[]`"), _in("|"), (np.arange(256) >= 192).astype(np.float32), ((np.arange(256) >= 128) & (np.arange(256) < 192)).astype(np.float32)]
WIDTH = len(_CLASSES) + 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.array([pow(int(_ODD), i + 1, 2**64) for i in range(256)], np.uint64)


def word_codes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, all of its bytes: a sum weighted by place, mixed."""
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    own = (data[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)) * _POWER[place % len(_POWER)] * (place // len(_POWER) * 2 + 1).astype(np.uint64)
    code = np.add.reduceat(own, first) + size.astype(np.uint64)
    code = (code ^ code >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return code ^ code >> np.uint64(29)


def describe(data: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> dict:
    """Of passages that begin at words `head`: counts, buckets of their words and runs, and how many of each they have.
    data goes on for four bytes or more after the last word."""
    low = int(start[0])
    data, start, end = data[low : int(end[-1]) + 4], start - low, end - low
    words = np.diff(np.append(head, len(start)))
    part = np.repeat(np.arange(len(head)), words)
    size = end - start
    chars = np.add.reduceat(size, head).astype(np.float32)
    out = np.zeros((len(head), WIDTH), np.float32)
    for k, lut in enumerate(_CLASSES):
        out[:, k] = np.add.reduceat(lut[data[: end[-1]]], start[head]) / chars
    out[:, -5] = chars / words / 8
    out[:, -4] = np.sqrt(np.maximum(np.add.reduceat(size.astype(np.float32) ** 2, head) / words - (chars / words) ** 2, 0)) / 8
    code = word_codes(data, start, size)
    same = (code[1:] == code[:-1]) & (part[1:] == part[:-1])
    out[:, -3] = np.add.reduceat(np.concatenate([[0.0], same.astype(np.float32)]), head) / words
    order = np.lexsort([code, part])
    fresh = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (part[order][1:] != part[order][:-1])]).astype(np.float32)
    out[:, -2] = np.add.reduceat(fresh, head) / words
    out[:, -1] = words / PASSAGE
    # a run belongs to the passage it lies in; one of fewer than four bytes has one run, filled with line ends
    d = data.astype(np.uint32)
    run = (d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)) * np.uint32(0x9E3779B1) >> np.uint32(20)
    first, last = start[head], end[np.append(head[1:], len(start)) - 1]
    runs = np.maximum(last - first - 3, 1)
    at = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
    own = run[at]
    for k in np.flatnonzero(last - first < 4):
        own[at == first[k]] = int.from_bytes(bytes(data[first[k] : last[k]]).ljust(4, b"\n"), "little") * 0x9E3779B1 % 2**32 >> 20
    return {"x": out, "word": (code % np.uint64(BUCKETS)).astype(np.uint16), "words": words, "run": own.astype(np.uint16), "runs": runs}


def passages(texts: list[str]):
    """(data, first and last places of words, first words of passages, number of passages of each text)."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n\n\n\n\n", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(begins, start, "right") - 1
    n = np.bincount(doc, minlength=len(raw))
    place = np.arange(len(start)) - (np.cumsum(n) - n)[doc]
    return data, start, end, np.flatnonzero(place % PASSAGE == 0), -(-n // PASSAGE)


def described(texts: list[str]):
    """describe() of blocks of BLOCK passages at most, in order; and the number of passages of each text (0: no words)."""
    data, start, end, head, count = passages(texts)

    def blocks():
        for a in range(0, len(head), BLOCK):
            z = min(a + BLOCK, len(head))
            last = head[z] if z < len(head) else len(start)
            yield describe(data, start[head[a] : last], end[head[a] : last], head[a:z] - head[a])

    return blocks(), count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(m: dict, b: dict) -> np.ndarray:
    """Encoder inputs of described passages."""
    mean = lambda e, ids, n: np.add.reduceat(e[ids], np.cumsum(n) - n) / n[:, None]
    return np.concatenate([(b["x"] - m["mean"]) / m["scale"], mean(m["ew"], b["word"], b["words"]), mean(m["er"], b["run"], b["runs"])], axis=1).astype(np.float32)


def encode(m: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ m["w"] + m["b"])


def forward(m: dict, h: np.ndarray, count: np.ndarray) -> dict:
    """Attention over each document's encodings; count: one or more a document."""
    head = np.cumsum(count) - count
    bag = np.repeat(np.arange(len(count)), count)
    t, s = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    e = (t * s) @ m["a"]
    e = np.exp(e - np.maximum.reduceat(e, head)[bag])
    a = e / np.add.reduceat(e, head)[bag]
    z = np.add.reduceat(a[:, None] * h, head)
    return {"head": head, "bag": bag, "t": t, "s": s, "att": a, "z": z, "y": z @ m["c"] + m["d"]}


def fit(bags: list[dict], label: np.ndarray, seed: int = 3) -> dict:
    """bags: what describe() gives for each document (one passage or more)."""
    rng = np.random.default_rng(seed)
    init = lambda a, b: rng.normal(0, a**-0.5, (a, b)).astype(np.float32)
    x = np.concatenate([b["x"] for b in bags])
    m = {"w": init(WIDTH + 2 * DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": init(HIDDEN, GATE), "u": init(HIDDEN, GATE), "a": init(GATE, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}
    m |= {"ew": rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), "er": rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)}
    m |= {"mean": x.mean(0), "scale": x.std(0) + 0.02}
    learned = ["w", "b", "v", "u", "a", "c", "d", "ew", "er"]
    first = {k: np.zeros_like(m[k]) for k in learned}
    second = {k: np.zeros_like(m[k]) for k in learned}
    weight = np.where(label > 0, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
    step, epochs = 0, max(EPOCHS, -(-STEPS * BAGS // len(bags)))  # EPOCHS passes and STEPS steps at least
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BAGS):
            pick = order[at : at + BAGS]
            own = {k: np.concatenate([bags[i][k] for i in pick]) for k in bags[0]}
            xs = inputs(m, own)
            h = encode(m, xs)
            f = forward(m, h, np.array([len(bags[i]["x"]) for i in pick]))
            bag, t, s, a = f["bag"], f["t"], f["s"], f["att"]
            dy = ((_sigmoid(f["y"]) - label[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dz = dy[:, None] * m["c"]
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, f["head"])[bag])
            dg = de[:, None] * m["a"]
            dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
            dh = (a[:, None] * dz[bag] + dt @ m["v"].T + ds @ m["u"].T) * (1 - h**2)
            dx = dh @ m["w"].T
            grad = {"w": xs.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}
            for name, ids, n, k in (("ew", "word", "words", WIDTH), ("er", "run", "runs", WIDTH + DIM)):
                each = dx[:, k : k + DIM] / own[n][:, None]
                grad[name] = np.stack([np.bincount(own[ids], np.repeat(each[:, j], own[n]), BUCKETS) for j in range(DIM)], axis=1)
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k in learned:
                g = grad[k] + 1e-4 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


_NONE = {"x": np.zeros((1, WIDTH), np.float32), "word": np.zeros(1, np.uint16), "words": np.ones(1, np.int64), "run": np.zeros(1, np.uint16), "runs": np.ones(1, np.int64)}


def bag_of(text: str | None) -> dict:
    """A document's described passages."""
    got = list(described([text])[0]) or [_NONE]
    return {k: np.concatenate([g[k] for g in got]) for k in got[0]}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model, or None without labels of both kinds."""
    chosen = sample(docs, labels, "quality", MODULUS, HELD, TRAIN_ROWS, LONGEST, id_col, text_col)
    return learnt(chosen, lambda texts, label: fit([bag_of(t) for t in texts], label))


def _scored(m: dict, texts: list[str]) -> np.ndarray:
    blocks, count = described(texts)
    filled = [encode(m, inputs(m, b)) for b in blocks]
    h = np.zeros((int(np.maximum(count, 1).sum()), HIDDEN), np.float32)
    some = np.repeat(count > 0, np.maximum(count, 1))
    if filled:
        h[some] = np.concatenate(filled)
    if not some.all():
        h[~some] = encode(m, inputs(m, _NONE))
    return _sigmoid(forward(m, h, np.maximum(count, 1))["y"].astype(np.float64))


def scores(m: dict | None, texts: list[str]) -> np.ndarray:
    if m is None:
        return np.full(len(texts), 0.5)
    out = [_scored(m, texts[i : i + GROUP]) for i in range(0, len(texts), GROUP)]
    return np.concatenate(out) if out else np.zeros(0)


def classify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows' (id, score)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, b.column(1).to_pylist()))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches LIMIT, with all their columns; all of them without a model."""
    if model is None:
        return docs

    def run(batches):
        at = None
        for b in batches:
            at = b.schema.get_field_index(text_col) if at is None else at
            yield b.filter(pa.array(scores(model, b.column(at).to_pylist()) >= LIMIT))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_fold("doc_id", MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
