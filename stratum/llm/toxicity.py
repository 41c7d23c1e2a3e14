"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a step are a word's own vector (telling and frequent words of the training sample) and the mean vector of its
hashed runs of 4 and 6 bytes of characters, all of them (long words are several steps), so unknown spellings have an input,
too. Two recurrent layers read a window of WINDOW words forward and backward; attention pools their states; a logistic layer
scores the window. Windows start at every STEP-th word, so that any passage of WINDOW - 1 words lies whole in one, the last
one ends with the text, and a document's score is that of its worst window.

Documents carry the labels, windows don't: the first windows to learn from are those with words or parts of words that
surely go with the label (likelihood ratio on the sample, less what chance gives); then the network picks each toxic
document's worst window and the clean ones' worst windows, and learns from those (windows to learn from start at every
STRIDE-th word). A last step fits the scale of the documents' scores; the limit stands where FALSE of the sample's clean
documents lie above it, or higher, up to the highest of them, if no toxic one is near. Toxic documents alone can't place it:
their own windows were learnt, so new ones score lower.

The model is fitted on at most TRAIN_ROWS labelled documents outside the held-out fold; of one of more than LONGEST
characters, on parts of it (labelled.sample). Every word of every text is scored. Null and empty texts score 0. Without
labels of both kinds every score is 0. Null ids fall in the fold of the empty text. Repeated rows, ties and extra columns:
each row is scored by itself. An empty table gives an empty one.
"""
from __future__ import annotations

from collections import Counter
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, table
from .labelled import learnt, sample

WINDOW, STRIDE, STEP = 24, 16, 2
WORDS, WORD_DIM, GRAMS, GRAM_DIM, HIDDEN, ATTENTION = 4_000, 8, 16_384, 8, 8, 8
SIZES = (4, 6)
LONG_WORD = 64
COMMON, CHANCE, FALSE = 20, 4.0, 0.003
TRAIN_ROWS, LONGEST = 4_000, 200_000
ROUNDS, EPOCHS, MOST, ENOUGH, BATCH = 3, 3, 40, 0.3, 128
MODULUS, HELD, LIMIT = 3, 1, 0.7
CACHE, BLOCK, SPAN, PIECE, HOLD = 300_000, 2_048, 1_024, 16_384, 65_536
#: A direction's input parts and weights are kept so that its gates are logistic(-x) and its candidate 2 logistic(-x) - 1.
FACTOR = np.repeat(np.array([-1, -2], np.float32), [2 * HIDDEN, HIDDEN])
_STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PIECE = b" "  # no word holds it


def _raw(text: str | None) -> list[bytes]:
    """A text's words as they stand there, each a step; one that gives several steps (tokens) as its pieces, marked."""
    found = (text or "").lower().encode().split()
    if not found or max(map(len, found)) <= LONG_WORD:
        return found
    out = []
    for w in found:
        short = w.strip(_STRIP) or w
        if len(short) <= LONG_WORD:
            out.append(w)
        else:
            out.extend(_PIECE + short[i : i + LONG_WORD] for i in range(0, len(short) - LONG_WORD // 2, LONG_WORD // 2))
    return out


def _word(raw: bytes) -> bytes:
    return raw[1:] if raw.startswith(_PIECE) else raw.strip(_STRIP) or raw


def tokens(text: str | None) -> list[bytes]:
    """Words; one of more than LONG_WORD bytes (text without blanks) gives pieces that overlap by half, each a step."""
    return [_word(w) for w in _raw(text)]


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' byte runs, ends marked, all words at once; and how many each word has, one or more."""
    marked = [b"\x01" + w + b"\x02" for w in words]
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    last = np.repeat(np.cumsum(size), size)  # where the word of a byte ends
    word, at = np.repeat(np.arange(len(words)), size), np.arange(len(b))
    found, owner = [np.full(len(words), GRAMS - 1)], [np.arange(len(words))]
    for n in SIZES:
        fits = np.flatnonzero(at + n <= last)
        h = np.full(len(fits), n, np.uint64)
        for j in range(n):
            h = (h ^ b[fits + j]) * np.uint64(0x100000001B3)
        found.append(((h ^ h >> np.uint64(29)) % np.uint64(GRAMS - 1)).astype(np.int64))
        owner.append(word[fits])
    who = np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return np.concatenate(found)[order], np.bincount(who, minlength=len(words))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _squashed(x: np.ndarray) -> np.ndarray:
    """Logistic function of -x, in place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def windows(n: int, stride: int = STEP) -> np.ndarray:
    """First words of the windows over n words; the last one ends with the text."""
    if not n:
        return np.zeros(0, np.int64)
    end = max(n - WINDOW, 0)
    return np.append(np.arange(0, end, stride), end)


# ---- network -------------------------------------------------------------------------------------------------------
def start(rng, vocabulary: list[bytes], odds: np.ndarray, gram_odds: np.ndarray) -> dict:
    rand = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    word = rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)).astype(np.float32)
    word[:-1, 0] = odds
    word[-1] = 0
    gram = rng.normal(0, 0.05, (GRAMS, GRAM_DIM)).astype(np.float32)
    gram[:, 0] = gram_odds
    m = {"word": word, "gram": gram, "v": rand(2 * HIDDEN, ATTENTION), "a": rand(ATTENTION), "c": rand(2 * HIDDEN), "d": np.zeros(1, np.float32)}
    for k in "fb":
        m[f"w{k}"], m[f"u{k}"], m[f"p{k}"] = rand(WORD_DIM + GRAM_DIM, 3 * HIDDEN), rand(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
    return m


def recur(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, back: bool, keep: list | None = None) -> np.ndarray:
    """x: (windows, steps, 3 hidden) input parts; -> states. Steps outside a window leave the state as it is."""
    n, steps, _ = x.shape
    h, out, d = np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32), HIDDEN
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g = h @ u
        zr = 1 / (1 + np.exp(-(x[:, t, : 2 * d] + g[:, : 2 * d])))
        z, r = zr[:, :d], zr[:, d:]
        c = np.tanh(x[:, t, 2 * d :] + r * g[:, 2 * d :])
        on = 1.0 if mask is None else mask[:, t, None]
        new = c + z * (h - c) if mask is None else h + on * (1 - z) * (c - h)
        if keep is not None:
            keep.append((t, h, z, r, c, g[:, 2 * d :], on))
        h = new
        out[:, t] = h
    return out


def pool(m: dict, h: np.ndarray, mask: np.ndarray) -> tuple:
    q = np.tanh(h @ m["v"])
    e = np.where(mask > 0, q @ m["a"], -1e9)
    e = np.exp(e - e.max(1, keepdims=True)) * mask
    a = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
    s = (a[:, :, None] * h).sum(1)
    return q, a, s, s @ m["c"] + m["d"]


def learn(m: dict, ids: np.ndarray, bags: tuple[np.ndarray, np.ndarray], mask: np.ndarray, label: np.ndarray, rng, state: dict) -> None:
    """ids: (windows, steps) rows of the sample's word list; bags: grams of those words; -1 stands for none. EPOCHS passes,
    and more, up to MOST, while the mean loss (chance: 0.69) isn't ENOUGH."""
    flat, size = bags
    first = np.cumsum(size) - size
    known = state["known"]
    weight = np.where(label > 0, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    loss, epoch = 1.0, 0
    while epoch < EPOCHS or (loss > ENOUGH and epoch < MOST):
        order, loss, epoch = rng.permutation(len(ids)), 0.0, epoch + 1
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            seen, spot = np.unique(np.maximum(ids[pick], 0), return_inverse=True)
            spot = spot.reshape(len(pick), WINDOW)
            pos = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in seen])
            cut = np.cumsum(size[seen]) - size[seen]
            gram = np.add.reduceat(m["gram"][flat[pos]], cut) / size[seen, None]
            x = np.concatenate([m["word"][known[seen]], gram], axis=1)[spot]
            on = mask[pick]
            keeps: dict[str, list] = {"f": [], "b": []}
            h = np.concatenate([recur(x @ m[f"w{k}"] + m[f"p{k}"], m[f"u{k}"], on, k == "b", keeps[k]) for k in "fb"], axis=2)
            q, a, s, y = pool(m, h, on)
            loss += float((np.logaddexp(0, np.where(label[pick] > 0, -y, y)) * weight[pick]).sum()) / len(ids)
            dy = ((_sigmoid(y) - label[pick]) * weight[pick] / len(pick)).astype(np.float32)
            ds = dy[:, None] * m["c"]
            da = (ds[:, None] * h).sum(2)
            de = a * (da - (a * da).sum(1, keepdims=True))
            dq = de[:, :, None] * m["a"] * (1 - q**2)
            dh = a[:, :, None] * ds[:, None] + dq @ m["v"].T
            grad = {"c": s.T @ dy, "d": np.array([dy.sum()]), "a": np.einsum("btk,bt->k", q, de), "v": np.einsum("bth,btk->hk", h, dq)}
            dx = np.zeros_like(x)
            for j, k in enumerate("fb"):
                own, run = dh[:, :, j * HIDDEN : (j + 1) * HIDDEN], np.zeros((len(pick), HIDDEN), np.float32)
                dp, du = np.zeros((*ids[pick].shape, 3 * HIDDEN), np.float32), np.zeros_like(m[f"u{k}"])
                for t, h0, z, r, c, gc, o in reversed(keeps[k]):
                    run = run + own[:, t]
                    dc = run * o * (1 - z) * (1 - c**2)
                    dz = run * o * (h0 - c) * z * (1 - z)
                    dr = dc * gc * r * (1 - r)
                    dp[:, t] = np.concatenate([dz, dr, dc], axis=1)
                    dg = np.concatenate([dz, dr, dc * r], axis=1)
                    du += h0.T @ dg
                    run = run * (1 - o * (1 - z)) + dg @ m[f"u{k}"].T
                grad[f"u{k}"], grad[f"p{k}"], grad[f"w{k}"] = du, dp.sum((0, 1)), np.einsum("bti,btj->ij", x, dp)
                dx += dp @ m[f"w{k}"].T
            per = np.zeros((len(seen), x.shape[2]), np.float32)
            np.add.at(per, spot.ravel(), dx.reshape(-1, x.shape[2]))
            grad["word"], grad["gram"] = np.zeros_like(m["word"]), np.zeros_like(m["gram"])
            np.add.at(grad["word"], known[seen], per[:, :WORD_DIM])
            grad["word"][-1] = 0
            np.add.at(grad["gram"], flat[pos], np.repeat(per[:, WORD_DIM:] / size[seen, None], size[seen], axis=0))
            state["step"] += 1
            for k, g in grad.items():
                f, v = state.setdefault(f"f{k}", np.zeros_like(m[k])), state.setdefault(f"s{k}", np.zeros_like(m[k]))
                f += 0.1 * (g - f)
                v += 0.001 * (g * g - v)
                m[k] -= (0.006 * (f / (1 - 0.9 ** state["step"])) / (np.sqrt(v / (1 - 0.999 ** state["step"])) + 1e-7)).astype(np.float32)


# ---- scoring -------------------------------------------------------------------------------------------------------
class Scorer:
    """Scores texts; each word's input parts are computed once and kept, up to CACHE words."""

    def __init__(self, model: dict):
        self.m, self.parts = model, np.zeros((1 << 14, 6 * HIDDEN), np.float32)
        self.index = {w: i for i, w in enumerate(model["vocabulary"])}
        self.row: dict[bytes, int] = {}  # of words
        self.place: dict[bytes, int] = {}  # of words as they stand in texts (_raw)

    def rows(self, raw: list[bytes]) -> np.ndarray:
        """The rows of self.parts with the words' input parts; rows of earlier calls don't outlive this one."""
        fresh = list(filterfalse(self.place.__contains__, dict.fromkeys(raw)))
        if len(self.place) + len(fresh) > CACHE:
            self.row, self.place = {}, {}
            fresh = list(dict.fromkeys(raw))
        if fresh:
            own = [w[1:] if w[0] == _PIECE[0] else w.strip(_STRIP) or w for w in fresh]  # _word
            self._add([w for w in dict.fromkeys(own) if w not in self.row])
            self.place.update(zip(fresh, map(self.row.__getitem__, own), strict=True))
        return np.fromiter(map(self.place.__getitem__, raw), np.int64, len(raw))

    def _add(self, fresh: list[bytes]) -> None:
        if not fresh:
            return
        m = self.m
        flat, size = grams(fresh)
        gram = np.add.reduceat(m["gram"][flat], np.cumsum(size) - size) / size[:, None]
        get, none = self.index.get, len(self.index)
        own = m["word"][[get(w, none) for w in fresh]]
        x = np.concatenate([own, gram], axis=1)
        part = np.concatenate([(x @ m[f"w{k}"] + m[f"p{k}"]) * FACTOR for k in "fb"], axis=1)
        at = len(self.row)
        if at + len(fresh) > len(self.parts):  # doubles, up to CACHE rows and one call's words
            self.parts = np.concatenate([self.parts, np.zeros((max(len(self.parts), len(fresh)), 6 * HIDDEN), np.float32)])
        self.parts[at : at + len(fresh)] = part
        self.row.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def logits(self, texts: list[str], stride: int = STEP) -> list[np.ndarray]:
        """Each text's windows' logits. Words get their rows where their pieces are scored, some HOLD words at once."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []
        pool: list[bytes] = []
        ends: list[int] = []

        def flush() -> None:
            pieces = np.split(self.rows(pool), ends[:-1])
            for (i, _), y in zip(held, self._piece_logits([(rows, own) for rows, (_, own) in zip(pieces, held, strict=True)], stride), strict=True):
                out[i].append(y)
            held.clear(), pool.clear(), ends.clear()

        for i, text in enumerate(texts):
            words = _raw(text)
            places, step = windows(len(words), stride), max(1, PIECE // stride)
            for k in range(0, len(places), step):  # very long texts in parts
                own = places[k : k + step]
                pool += words[own[0] : own[-1] + WINDOW]
                ends.append(len(pool))
                held.append((i, own - own[0]))
                if len(held) >= BLOCK or len(pool) >= HOLD:
                    flush()
        if held:
            flush()
        return [np.concatenate(y) if y else np.zeros(0) for y in out]

    def _piece_logits(self, pieces: list[tuple[np.ndarray, np.ndarray]], stride: int) -> list[np.ndarray]:
        """Logits of each piece's windows: (rows of its words, first words of its windows).

        Full windows at multiples of the stride are read off all pieces laid end to end; those that texts' ends cut short
        or shift, one a text at most, are gathered."""
        if not pieces:
            return []
        out, odd, at = [np.zeros(len(places)) for _, places in pieces], [], []
        full = [(places % stride == 0) & (places + WINDOW <= len(rows)) for rows, places in pieces]
        size = [-(-len(rows) // stride) * stride for rows, _ in pieces]
        base = np.cumsum([0, *size])
        laid = np.zeros(base[-1] + WINDOW + stride, np.int64)
        for (rows, _), b in zip(pieces, base, strict=False):
            laid[b : b + len(rows)] = rows
        y = self._slide(laid, int(base[-1]) // stride, stride) if any(f.any() for f in full) else np.zeros(0)
        for k, ((rows, places), f) in enumerate(zip(pieces, full, strict=True)):
            out[k][f] = y[(base[k] + places[f]) // stride]
            for j in np.flatnonzero(~f):
                odd.append(rows[places[j] : places[j] + WINDOW])
                at.append((k, j))
        d = 3 * HIDDEN
        for a in range(0, len(odd), BLOCK):
            block = np.full((len(at[a : a + BLOCK]), WINDOW), -1)
            for row, own in zip(block, odd[a : a + BLOCK], strict=True):
                row[: len(own)] = own
            mask, x = (block >= 0).astype(np.float32), self.parts[np.maximum(block, 0)] / np.tile(FACTOR, 2)
            h = np.concatenate([recur(x[:, :, :d], self.m["uf"], mask, False), recur(x[:, :, d:], self.m["ub"], mask, True)], axis=2)
            for (k, j), v in zip(at[a : a + BLOCK], pool(self.m, h, mask)[3], strict=True):
                out[k][j] = v
        return out

    def _slide(self, laid: np.ndarray, n: int, stride: int) -> np.ndarray:
        """Logits of n windows, each `stride` words after the one before. Arrays are (features, windows), so a step's inputs
        are slices; each word's phase modulo the stride has an array of its own. Both directions take a step at once.

        States are kept as (state + 1) / 2, with a row of ones for what that adds to products, so that a candidate is what its
        squashing function gives; gates divide by 1 + exp(x) instead of multiplying by its reciprocal."""
        m, d, out = self.m, 3 * HIDDEN, np.empty(n)
        # signs and factors of the squashing functions are in the weights (and in self.parts)
        u = np.stack([m[f"u{k}"].T * FACTOR[:, None] for k in "fb"])
        u = np.concatenate([2 * u, -u.sum(2, keepdims=True)], axis=2)
        v = np.concatenate([m["v"].T * np.float32(-2), m["c"][None]])
        v = np.concatenate([2 * v, -v.sum(1, keepdims=True)], axis=1)
        twice, less = 2 * m["a"], m["a"].sum()
        for a in range(0, n, SPAN):
            w = min(SPAN, n - a)
            rows = laid[a * stride : (a + w) * stride + WINDOW]
            phase = [np.ascontiguousarray(self.parts[rows[r::stride]].T) for r in range(stride)]
            step = lambda t: phase[t % stride][:, t // stride : t // stride + w]  # noqa: B023, E731
            if a == 0 or w < SPAN:
                state, g, kept = np.ones((2, HIDDEN + 1, w), np.float32), np.empty((2, d, w), np.float32), np.ones((WINDOW, 2 * HIDDEN + 1, w), np.float32)
                q = np.empty((ATTENTION + 1, w), np.float32)
            h, zr, z, r, c = state[:, :HIDDEN], g[:, : 2 * HIDDEN], g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            for t in range(WINDOW):
                ahead, back = step(t)[:d], step(WINDOW - 1 - t)[d:]
                if t:
                    np.matmul(u, state, out=g)
                    zr[0] += ahead[: 2 * HIDDEN]
                    zr[1] += back[: 2 * HIDDEN]
                    np.exp(zr, out=zr)
                    zr += 1
                    c /= r
                    c[0] += ahead[2 * HIDDEN :]
                    c[1] += back[2 * HIDDEN :]
                else:  # the state is zero: inputs alone
                    g[0], g[1], h[:] = ahead, back, 0.5
                    np.exp(z, out=z)
                    z += 1
                _squashed(c)
                h -= c
                h /= z
                h += c
                kept[t, :HIDDEN], kept[WINDOW - 1 - t, HIDDEN:-1] = h
            top, low = np.zeros(w, np.float32), np.zeros(w, np.float32)
            for k in kept:
                np.matmul(v, k, out=q)
                e = np.exp(twice @ _squashed(q[:ATTENTION]) - less)  # bounded by the sum of |a|
                low += e
                e *= q[ATTENTION]
                top += e
            out[a : a + w] = top / low + m["d"]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") < 400_000):
                size += len(texts[end] or "")
                end += 1
            for i, y in enumerate(self.logits(texts[at:end])):
                out[at + i] = _sigmoid(self.m["scale"] * y.max() + self.m["offset"]) if len(y) else 0.0
            at = end
        return out


def signal(hits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How surely what hits[1] toxic and hits[0] clean documents hold goes with the label: the signed root of the likelihood
    ratio, less what chance gives the best of many; 0 for all else."""
    n = np.array([(label == 0).sum(), (label == 1).sum()], float)
    share = n[1] / n.sum()
    total = hits.sum(0)
    part = lambda a, e: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(e, 1e-9)), 0)
    g = np.sqrt(np.maximum(2 * (part(hits[1], total * share) + part(hits[0], total * (1 - share))), 0))
    return np.sign(hits[1] - total * share) * np.clip((g - CHANCE) / 2, 0, 3)


def fit(texts: list[str], label: np.ndarray, seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    one: dict[bytes, bytes] = {}  # one copy of each word
    docs = [[one.setdefault(w, w) for w in tokens(t)] for t in texts]
    seen: list[Counter] = [Counter(), Counter()]
    for words, y in zip(docs, label, strict=True):
        seen[int(y)].update(set(words))
    names = sorted(seen[0] + seen[1])
    row = {w: i for i, w in enumerate(names)}
    coded = [np.array([row[w] for w in words], np.int64) for words in docs]
    del docs, one
    bags = grams(names)
    first = np.cumsum(bags[1]) - bags[1]
    hits = np.zeros((2, GRAMS))
    for c, y in zip(coded, label, strict=True):
        own = np.unique(c)
        if len(own):
            hits[int(y), np.unique(np.concatenate([bags[0][first[i] : first[i] + bags[1][i]] for i in own]))] += 1
    word_sign = signal(np.array([[k[w] for w in names] for k in seen], float), label)
    gram_sign = signal(hits, label)
    common = np.array([seen[0][w] + seen[1][w] for w in names])
    ranked = np.lexsort([np.arange(len(names)), -common, -np.abs(word_sign)])
    ranked = ranked[(np.abs(word_sign[ranked]) > 0) | (common[ranked] >= COMMON)][:WORDS]
    vocabulary = [names[i] for i in ranked]
    known = np.full(len(names), len(vocabulary))
    known[ranked] = np.arange(len(ranked))
    m = start(rng, vocabulary, word_sign[ranked].astype(np.float32), gram_sign.astype(np.float32)) | {"vocabulary": vocabulary, "scale": 1.0, "offset": 0.0}
    state = {"step": 0, "known": known}
    worth = word_sign + np.maximum.reduceat(gram_sign[bags[0]], first)
    places = [windows(len(c), STRIDE) for c in coded]
    worst: list[np.ndarray] = [np.array([worth[c[s : s + WINDOW]].max() for s in p]) for c, p in zip(coded, places, strict=True)]
    for k_round in range(ROUNDS):
        ids, labels = [], []
        for c, p, v, y in zip(coded, places, worst, label, strict=True):
            if not len(p):
                continue
            take = [int(v.argmax())] if y else list({int(v.argmax()), *rng.integers(0, len(p), 1).tolist()})
            for s in (p[k] for k in take):
                w = c[s : s + WINDOW]
                ids.append(np.pad(w, (0, WINDOW - len(w)), constant_values=-1))
                labels.append(y)
        block = np.stack(ids)
        learn(m, block, bags, (block >= 0).astype(np.float32), np.array(labels, np.float32), rng, state)
        scorer = Scorer(m)
        worst = []
        for at in range(0, len(texts), 64):
            worst += scorer.logits(texts[at : at + 64], STRIDE if k_round < ROUNDS - 1 else STEP)
    top = np.array([v.max() if len(v) else -10.0 for v in worst])
    a, b = 1.0, 0.0
    for _ in range(300):  # scale and offset by gradient steps on the documents' best logits
        g = _sigmoid(a * top + b) - label
        w = np.where(label > 0, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
        a, b = max(a - 0.05 * float((w * g * top).mean()), 0.2), b - 0.1 * float((w * g).mean())
    low, high = np.quantile(top[label == 0], 1 - FALSE), top[label == 0].max()
    above = top[(label > 0) & (top > low)]
    # as far up to the highest clean document as leaves half of the way to the sample's lowest toxic one
    edge = max(low, min(high, (low + above.min()) / 2)) if len(above) else low
    m["scale"], m["offset"] = a, float(np.log(LIMIT / (1 - LIMIT)) - a * edge)
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model, or None without labels of both kinds."""
    return learnt(sample(docs, labels, "toxic", MODULUS, HELD, TRAIN_ROWS, LONGEST, id_col, text_col), fit)


def classify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows' (id, score)."""

    def run(batches):
        scorer = Scorer(model) if model else None
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(texts) if scorer else np.zeros(len(texts)))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_fold("doc_id", MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
