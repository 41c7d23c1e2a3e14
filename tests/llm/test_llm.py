"""The dealt operators against brute force, and their defined results for odd rows."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import ann, bpe, line_dedup, packing, quality, quality_mil, queries, secrets, simhash, substring_dedup, toxicity

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, th bigint, h1 bigint, pos int, key string, fp bigint, n int, score double, root bigint, line string, bucket int, spans string, kept boolean, label double, removed string, __id string, __th string, __removed string, __SPANS string, text_ string, spread int, anchor bigint, gone string, first string, component_id string, __key string"
LONG = " ".join(f"w{i}x{i * 7 % 1013}" for i in range(30_000))


def frame(spark, rows):
    fill = (None, "s", 1, 1, 1, 1, 1, "k", 1, 1, 0.5, 1, "l", 1, "s", True, 1.0, "r", "i", "t", "r", "s", "t", 1, 1, "g", "f", "c", "k")
    return spark.createDataFrame([(i, t, *fill) for i, t in rows], ODD)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, ties of content, one word, blanks only."""
    same = "the same line stands here again and again, word for word, in every copy of it"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, same), (6, same), (6, same), (None, same), (None, None), (7, LONG), (8, LONG + " end"), (9, "a" * 5000), (10, f"{same}\n{same}\nlast ünïcode 𝄞 line {same}"), (11, "x " * 200)]
    return rows, frame(spark, rows)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def find(parent, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


# ---- 1 ---------------------------------------------------------------------------------------------------------------
def lines_kept(rows):
    """Brute force over all pairs of lines."""
    lines = {}
    for _, t in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                lines.setdefault(x, len(lines))
    names = list(lines)
    sets = [{x.encode("utf-16-be")[i : i + 14] for i in range(0, len(x.encode("utf-16-be")) - 13, 2)} for x in names]
    parent = list(range(len(names)))
    for i in range(len(names)):
        for k in range(i):
            both = len(sets[i] & sets[k]) if min(len(sets[i]), len(sets[k])) >= 0.8 * max(len(sets[i]), len(sets[k])) and sets[i] else 0
            if both and both >= 0.8 * (len(sets[i]) + len(sets[k]) - both):
                parent[find(parent, max(i, k))] = find(parent, min(i, k))
    seen, out = set(), {}
    for d, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            c = find(parent, lines[x]) if x in lines else None
            if c is None or c not in seen:
                kept.append(x)
            seen.add(c)
        out[d] = sha("\n".join(kept))
    return out


def test_line_dedup(spark, docs):
    some = docs[:80]
    edited = [(1000 + d, t.replace("the", "teh", 1)) for d, t in some[:20]]
    rows = some + edited
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(frame(spark, rows).select("doc_id", "text")).selectExpr("doc_id", "sha2(text, 256) kept").collect()}
    want = lines_kept(rows)
    assert sum(got[d] != want[d] for d in want) <= 1  # the bands' recall isn't 1


def test_line_dedup_hot_bucket(spark):
    """Many lines that share buckets without being alike enough for one pivot."""
    rng = np.random.default_rng(5)
    base = [f"w{i:03d}" for i in range(60)]
    rows = []
    for k in range(150):
        words = list(base)
        for j in rng.integers(0, 60, 3):
            words[j] = f"z{rng.integers(0, 9999):04d}"
        rows.append((k, " ".join(words)))
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r["doc_id"]: sha(r["text"]) for r in done.collect()}
    want = lines_kept(rows)
    assert sum(got[d] != want[d] for d in want) <= 2


def test_line_dedup_long_and_repetitive(spark):
    """The same phrase 5 and 15 times has one shingle set; long lines of few different shingles, near copies of one another."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    rows = []
    for _ in range(60):
        phrase = word(20)
        rows += [phrase * 5, phrase * 15]
    for units in (20, 60, 300, 1500):
        for _ in range(60):
            line = word(units)
            rows += [line, word(max(1, units // 20)) + line[max(1, units // 20) :]]
    for _ in range(60):
        phrase = word(60)
        rows += [phrase * 6, (phrase[:-1] + "0") * 3 + phrase * 3]
    rows = list(enumerate(rows))
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r["doc_id"]: sha(r["text"]) for r in done.collect()}
    want = lines_kept(rows)
    assert all(got[d] == want[d] for d in range(120))
    assert sum(got[d] != want[d] for d in want) <= 5


def test_line_dedup_recall_by_length(spark):
    """Pairs just over the similarity, of every length: the share that is found."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    rows, sizes, each = [], (10, 14, 20, 60, 250, 1000), 100
    for n in sizes:
        for _ in range(each):
            line, apart = word(n + 6), int(n * 0.2 / 1.8 + 1e-9)
            near = line[: n - apart + 6] + word(apart)
            rows += [line, near]
            shared = {line[i : i + 7] for i in range(n)} & {near[i : i + 7] for i in range(n)}
            assert len(shared) >= 0.8 * (2 * n - len(shared))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(frame).where("text = ''").collect()}
    assert all(i % 2 for i in gone)
    found = [sum(i in gone for i in range(2 * each * k + 1, 2 * each * (k + 1), 2)) / each for k in range(len(sizes))]
    assert min(found) >= 0.93 and np.mean(found) >= 0.96, found


def test_line_dedup_few_steps_lose_no_pair(spark):
    """The test on low bits passes every pair with AGREE equal minima, and few others."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4000):
        a = rng.integers(0, 2**31, line_dedup.MINIMA)
        b = np.where(np.arange(line_dedup.MINIMA) < k % (line_dedup.MINIMA + 1), a, rng.integers(0, 2**31, line_dedup.MINIMA))
        rows.append((a.tolist(), rng.permutation(16).tolist(), b.tolist()))
    made = spark.createDataFrame([([a[i] for i in p], [b[i] for i in p]) for a, p, b in rows], "a array<int>, b array<int>")
    low = lambda c: made.select("a", "b", *[F.col(c)[j].alias(f"m{j}") for j in range(line_dedup.MINIMA)]).select("a", "b", line_dedup.low_bits().alias(c + "_low"))
    both = low("a").join(low("b"), ["a", "b"])
    got = both.select("a", "b", line_dedup.near(F.col("a_low"), F.col("b_low")).alias("near")).collect()
    equal = np.array([sum(x == y for x, y in zip(r["a"], r["b"], strict=True)) for r in got])
    said = np.array([r["near"] for r in got])
    assert len(got) == len(rows) and said[equal >= line_dedup.AGREE].all() and said[equal <= 4].mean() < 0.02


def test_line_dedup_odd(spark, odd):
    rows, df = odd
    done = line_dedup.dedup_lines(df)
    assert done.columns[: len(df.columns)] == df.columns
    got = defaultdict(list)
    for r in done.collect():
        got[r["doc_id"]].append((r["text"], r["__n_removed"]))
    assert got[1] == [(None, 0)] and got[2] == [("", 0)] and got[3] == [(" \n\t ", 0)]
    assert sorted(got[None], key=str)[1:] and {n for _, n in got[None]} == {0}  # a null id comes first, so its line stays
    assert got[5] == [("", 1)] and got[6] == [("", 1)] * 2
    assert len(done.collect()) == len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_join_counted_splits_hot_keys(spark):
    """The rows of the plain join, with hot keys dealt over tasks."""
    from stratum.llm import common

    left = spark.range(9_000).selectExpr("case when id % 3 = 0 then 7 else id end as k", "id as x")
    right = left.groupBy("k").agg(common.F.count("*").alias("n")).where("k % 2 = 1").withColumn("v", common.F.col("k") * 2)
    got = common.join_counted(left, right, ["k"], 9_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").select("k", "x", "v").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = common.join_counted(left, right, ["k"], 9_000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "__deal" in plan.split("hashpartitioning(", 1)[1] and any("__deal" in part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])
    few = right.where("n <= 1000")
    assert common.join_counted(left, few, ["k"], 9_000).count() == left.join(few, "k").count()


# ---- 2, 9 --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("name", "label", "modulus", "held"), [("op2_quality_mil", "quality", 4, 2), ("op9_toxicity", "toxic", 3, 1)])
def test_classifiers(spark, name, label, modulus, held):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert got["held_out"].tolist() == [zlib.crc32(str(d).encode()) % modulus == held for d in got["doc_id"]]
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")[label]
    known = got[got["doc_id"].isin(truth.index) & got["held_out"]]
    y, said = truth[known["doc_id"]].to_numpy() == 1, known["predicted"].to_numpy() == 1
    # what a constant answer can't have: most of one kind, and few of the other
    assert said[y].mean() >= (0.98 if label == "quality" else 0.7) and said[~y].mean() <= 0.02


def test_toxic_words_are_found():
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat") for c in ("a", "es", "in")]
    text = lambda n: [str(w) for w in rng.choice(plain, n)]
    texts, label = [], []
    for k in range(240):
        words = text(int(rng.integers(20, 160)))
        if k % 4 == 0:
            words[int(rng.integers(len(words)))] = str(rng.choice(["grumblor", "snarfish"]))
        texts.append(" ".join(words))
        label.append(k % 4 == 0)
    model = toxicity.fit(texts[:160], np.array(label[:160], np.float32))
    got = toxicity.Scorer(model).scores(texts[160:] + ["", None])
    assert ((got[:-2] >= 0.7) == np.array(label[160:])).mean() > 0.95 and got[-2:].tolist() == [0.0, 0.0]
    # every word of a long text is in some window
    assert toxicity.Scorer(model).scores([" ".join(text(5000) + ["grumblor"] + text(5000))])[0] >= 0.7
    for n in (1, 23, 24, 25, 40, 41, 1000):
        s = toxicity.windows(n)
        assert set(np.concatenate([np.arange(a, min(a + toxicity.WINDOW, n)) for a in s]).tolist()) == set(range(n))


def test_toxic_part_of_a_long_word():
    """Text without blanks is read to its end, in training and in scoring."""
    for word in ("語" * 500, "a_" * 40 + "b", "x" * 65, "x" * 64, "x" * 96, "x" * 97):
        b = word.encode()
        pieces = toxicity.tokens(word)
        assert all(len(w) <= 64 for w in pieces)
        assert {b[i : i + 6] for i in range(len(b) - 5)} == {w[i : i + 6] for w in pieces for i in range(len(w) - 5)}
    rng = np.random.default_rng(1)
    plain = ["天地", "日月", "山川", "草木", "風雨", "春秋", "東西", "南北"]
    texts = []
    for k in range(640):
        parts = [str(w) for w in rng.choice(plain, 80)]
        if k % 4 == 0:
            parts[40 + int(rng.integers(30))] = "毒毒罵詈"
        texts.append("".join(parts))
    label = np.array([k % 4 == 0 for k in range(640)])
    model = toxicity.fit(texts[:480], label[:480].astype(np.float32))
    assert ((toxicity.Scorer(model).scores(texts[480:]) >= 0.7) == label[480:]).mean() > 0.95


def test_toxicity_cache_keeps_rows(monkeypatch):
    """A text with more different words than the cache holds is scored as with a large one."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) + (" grumblor" if k % 3 == 0 else "") for k in range(90)]
    model = toxicity.fit(texts, np.array([k % 3 == 0 for k in range(90)], np.float32))
    long = " ".join(f"v{i * 7919 % 10**6}" for i in range(60_000))
    want = toxicity.Scorer(model).logits([long, texts[0]])
    monkeypatch.setattr(toxicity, "CACHE", 40_000)
    got = toxicity.Scorer(model).logits([long, texts[0]])
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got, want, strict=True))


def test_toxicity_texts_share_their_work(monkeypatch):
    """Words of many texts get their inputs in one call, once for all that stand in other marks; scores are those of each text alone."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" + str(rng.choice(["", ",", ".", '"'])) for x in rng.integers(0, 50, 60)) + (" Grumblor!" if k % 3 == 0 else "") for k in range(90)]
    texts += ["x" * 64 + "...", "(" + "y" * 200 + ")", "... -- ...", "\u00a0 \u3000", None, ""]
    model = toxicity.fit(texts, np.array([k % 3 == 0 for k in range(96)], np.float32))
    alone = [toxicity.Scorer(model).scores([t])[0] for t in texts]
    calls, grams = [], toxicity.grams
    monkeypatch.setattr(toxicity, "grams", lambda words: calls.append(words) or grams(words))
    assert toxicity.Scorer(model).scores(texts) == pytest.approx(alone, abs=1e-5)
    assert len(calls) == 1 and len(calls[0]) == len(set(calls[0])) and set(calls[0]) == {w for t in texts for w in toxicity.tokens(t)}


def test_toxicity_windows():
    for n in (1, 24, 25, 40, 41, 1000):
        assert toxicity.windows(n, 1).tolist() == list(range(max(n - toxicity.WINDOW, 0) + 1))
        assert toxicity.windows(n, 16)[-1] == max(n - toxicity.WINDOW, 0)
        # every run of 23 words lies whole in one window
        starts = toxicity.windows(n)
        assert all(any(s <= i and min(i + 23, n) <= s + toxicity.WINDOW for s in starts) for i in range(max(n - 22, 1)))


def plain_logits(m, text):
    """One window after the other, one number after the other."""
    words = toxicity.tokens(text)
    index = {w: i for i, w in enumerate(m["vocabulary"])}
    sig = lambda x: 1 / (1 + np.exp(-float(x)))
    xs = []
    for w in words:
        ids, n = toxicity.grams([w])
        xs.append([*m["word"][index.get(w, len(index))].tolist(), *(sum(m["gram"][i].astype(float) for i in ids) / n[0]).tolist()])
    H = toxicity.HIDDEN
    out = []
    for s in toxicity.windows(len(words), 1):
        win = xs[s : s + toxicity.WINDOW]
        states = {}
        for k in "fb":
            wk, uk, pk = (m[f"{c}{k}"].astype(float) for c in "wup")
            h, seq = [0.0] * H, [None] * len(win)
            for t in range(len(win)) if k == "f" else range(len(win) - 1, -1, -1):
                a = [sum(win[t][i] * wk[i, j] for i in range(len(win[t]))) + pk[j] for j in range(3 * H)]
                g = [sum(h[i] * uk[i, j] for i in range(H)) for j in range(3 * H)]
                z, r = [sig(a[j] + g[j]) for j in range(H)], [sig(a[H + j] + g[H + j]) for j in range(H)]
                c = [np.tanh(a[2 * H + j] + r[j] * g[2 * H + j]) for j in range(H)]
                h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(H)]
                seq[t] = h
            states[k] = seq
        both = [f + b for f, b in zip(states["f"], states["b"], strict=True)]
        e = [np.exp(sum(np.tanh(sum(h[i] * m["v"][i, j] for i in range(2 * H))) * m["a"][j] for j in range(len(m["a"])))) for h in both]
        pooled = [sum(w * h[i] for w, h in zip(e, both, strict=True)) / sum(e) for i in range(2 * H)]
        out.append(sum(p * c for p, c in zip(pooled, m["c"], strict=True)) + m["d"][0])
    return out


def test_toxicity_equals_plain_loops():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) + (" grumblor" if n % 2 else "") for n in rng.integers(1, 60, 90)]
    m = toxicity.fit(texts, np.array(["grumblor" in t for t in texts], np.float32))
    some = ["one", "a b c", " ".join(f"w{x}" for x in range(24)), " ".join(f"w{x}" for x in range(31)), "x" * 130 + " tail grumblor", *texts[:3]]
    want = [plain_logits(m, t) for t in some]
    for stride in (1, 2, 3, 16):
        got = toxicity.Scorer(m).logits(some, stride)
        for t, g, w in zip(some, got, want, strict=True):
            places = toxicity.windows(len(toxicity.tokens(t)), stride)
            assert g == pytest.approx([w[i] for i in places], abs=1e-4)
    best = [1 / (1 + np.exp(-(m["scale"] * max(w[i] for i in toxicity.windows(len(toxicity.tokens(t)))) + m["offset"]))) for t, w in zip(some, want, strict=True)]
    assert toxicity.Scorer(m).scores(some) == pytest.approx(best, abs=1e-4)


def test_toxicity_steps_take_few_passes(monkeypatch):
    """A window's step squashes each gate once and inverts no gate but the candidate; its first step, from the zero state, has
    no reset gate; and windows that texts' ends cut short give what plain loops give."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) + (" grumblor" if n % 2 else "") for n in rng.integers(1, 60, 90)]
    m = toxicity.fit(texts, np.array(["grumblor" in t for t in texts], np.float32))
    n, each = 300, toxicity.WINDOW * toxicity.HIDDEN
    scorer = toxicity.Scorer(m)
    laid = np.resize(scorer.rows([b"w%d" % x for x in range(40)]), 2 * n + toxicity.WINDOW + 2)
    done = {"exp": 0, "reciprocal": 0}
    for name in done:
        monkeypatch.setattr(np, name, lambda x, *a, f=getattr(np, name), name=name, **b: (done.__setitem__(name, done[name] + np.size(x)), f(x, *a, **b))[1])
    scorer._slide(laid, n, 2)
    monkeypatch.undo()
    # two directions' three gates, and the attention's
    assert done["exp"] <= n * (6 * each - 2 * toxicity.HIDDEN + toxicity.WINDOW * (toxicity.ATTENTION + 1)), done
    assert done["reciprocal"] <= n * (2 * each + toxicity.WINDOW * toxicity.ATTENTION), done
    for size in (1, 23, 24, 25, 58):
        text = "\"quoted\" " + "x" * 90 + " " + " ".join(f"w{k}," for k in range(size))
        assert toxicity.Scorer(m).logits([text], 1)[0] == pytest.approx(plain_logits(m, text), abs=1e-4)


def plain_quality(m, text):
    words = (text or "").encode().split()
    whole = (text or "").encode()
    spots = [(x.start(), x.end()) for x in re.finditer(rb"[^\x20\x09-\x0D]+", whole)]
    hs = []
    for a in range(0, max(len(words), 1), quality_mil.PASSAGE):
        own, at = words[a : a + quality_mil.PASSAGE], spots[a : a + quality_mil.PASSAGE]
        x, ids, runs = [0.0] * quality_mil.WIDTH, [0], [0]
        if own:
            body = b"".join(own)
            x[: len(quality_mil._CLASSES)] = [sum(float(lut[c]) for c in body) / len(body) for lut in quality_mil._CLASSES]
            sizes = [len(w) for w in own]
            x[-5], x[-4] = np.mean(sizes) / 8, np.std(sizes) / 8
            x[-3] = sum(u == v for u, v in zip(own, own[1:])) / len(own)
            x[-2], x[-1] = len(set(own)) / len(own), len(own) / quality_mil.PASSAGE
            mask = 2**64 - 1
            ids = []
            for w in own:
                code = sum((c + 1) * int(quality_mil._POWER[i % 256]) * (i // 256 * 2 + 1) for i, c in enumerate(w)) + len(w) & mask
                code = (code ^ code >> 31) * 0xBF58476D1CE4E5B9 & mask
                ids.append((code ^ code >> 29) % quality_mil.BUCKETS)
            lo, hi = at[0][0], at[-1][1]
            span = whole[:hi] + b"\n\n\n\n"
            runs = [int.from_bytes(span[i : i + 4], "little") * 0x9E3779B1 % 2**32 >> 20 for i in range(lo, max(hi - 3, lo + 1))]
        feats = np.concatenate([(np.array(x) - m["mean"]) / m["scale"], np.mean([m["ew"][i] for i in ids], axis=0), np.mean([m["er"][i] for i in runs], axis=0)])
        hs.append(np.tanh(feats @ m["w"] + m["b"]))
    e = [float((np.tanh(h @ m["v"]) * (1 / (1 + np.exp(-(h @ m["u"]))))) @ m["a"]) for h in hs]
    att = np.exp(np.array(e) - max(e)) / np.exp(np.array(e) - max(e)).sum()
    z = sum(a * h for a, h in zip(att, hs, strict=True))
    return 1 / (1 + np.exp(-float(z @ m["c"] + m["d"][0])))


def test_quality_equals_plain_loops(docs, monkeypatch):
    some = [t for _, t in docs[:60]]
    m = quality_mil.fit([quality_mil.bag_of(t) for t in some], np.array([k % 2 for k in range(60)], np.float32))
    odd = ["", None, " \n ", "a", "ab c", "same same same", "x" * 700, "é" * 30 + " 語 " * 60, LONG[:3000], some[0] + "\n" + some[1]]
    want = [plain_quality(m, t) for t in odd + some[:20]]
    assert quality_mil.scores(m, odd + some[:20]) == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(quality_mil, "BLOCK", 2)
    assert quality_mil.scores(m, odd + some[:20]) == pytest.approx(want, abs=1e-4)


def test_classifiers_odd(spark, odd):
    rows, df = odd
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 1), (5, None, None), (6, 0, 1), (6, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module in (quality_mil, toxicity):
        model = module.train(df, labels)
        for m in (model, None):
            got = module.classify(df, m).collect()
            assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert module.classify(df.limit(0), None).count() == 0 and module.train(df, labels.limit(0)) is None


# ---- 3 -------------------------------------------------------------------------------------------------------------------
def windows_gone(rows):
    seen, out = set(), {}
    for d, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = True
            seen.add(k)
        out[d] = (len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring_dedup(spark, docs):
    passage = " ".join(f"p{i}" for i in range(37))
    planted = [(10_000 + k, f"start{k} " * k + passage + f" end{k}" * 3) for k in range(40)]
    loops = [(20_000, "a b c d e " * 30), (20_001, "one two " * 40), (20_002, " ".join(f"q{i}" for i in range(20))), (20_003, "z " * 19), (20_004, "z " * 20), (20_005, "y " * 21)]
    rows = docs + planted + loops
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert got == windows_gone(rows)


def test_substring_dedup_odd(spark, odd):
    rows, df = odd
    got = defaultdict(set)
    for r in substring_dedup.dedup_substrings(df).collect():
        got[r["doc_id"]].add((r["n_words"], r["n_removed"]))
    assert got[1] == got[2] == got[3] == {(0, 0)} and got[7] == {(30_000, 0)} and got[8] == {(30_001, 30_000)} and got[11] == {(200, 199)}
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


# ---- 4 ---------------------------------------------------------------------------------------------------------------------
def test_secrets(spark, docs, odd):
    kinds = {"assign": re.compile(secrets.ASSIGN, re.ASCII), "access": re.compile(secrets.ACCESS), "hex": re.compile(secrets.HEX)}
    ok = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    extra = [(9001, "é𝄞 Token: 'abc123' secret=token:abcdef1 PASSWORD =  \"hunter22\" api_key=xy"), (9002, "AKIA" + "Z9" * 9 + " AKIAQ AKIA" + "B" * 16 + " " + "0123456789abcdef" * 2), (9003, "key q8Zr3TnW7xLk2VbY9sGd4HfJ6mPc1 end 123e4567-e89b-12d3-a456-426614174000 aaaaaaaaaaaaaaaaaaaaaaaa1")]
    rows = docs + extra
    got = {r[0]: r for r in secrets.scan(frame(spark, rows).select("doc_id", "text")).selectExpr("doc_id", "transform(spans, s -> concat(s.kind, ':', s.start, ':', s.end)) s").collect()}
    for d, t in rows:
        want = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(kinds.items()) for m in p.finditer(t or "") if ok[k](m))
        base = [x for x in got[d]["s"] if x[0] != "3"]
        assert base == [f"{k}:{a}:{z}" for a, k, z in want], d
    assert [x[0] for x in got[9003]["s"]] == ["3", "2"]
    odd_rows, df = odd
    scanned = secrets.scan(df.drop("spans")).selectExpr("doc_id", "text", "transform(filter(spans, s -> s.kind < 3), s -> concat(s.kind, ':', s.start, ':', s.end)) s").collect()
    base = lambda t: [f"{k}:{a}:{z}" for a, k, z in sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(kinds.items()) for m in p.finditer(t or "") if ok[k](m))]
    assert Counter((r["doc_id"], r["text"], tuple(r["s"])) for r in scanned) == Counter((d, t, tuple(base(t))) for d, t in odd_rows)
    assert secrets.scan(df.limit(0)).count() == 0
    assert secrets.redact(spark.createDataFrame([(9001, extra[0][1])], "doc_id bigint, text string")).first()["text"].count("<secret>") == 2


def test_secrets_with_slashes_and_examples(spark):
    """Three slashes or a word such as "example" in a random secret don't hide it; paths and alphabets are no secrets."""
    key, tail = "q8Zr3TnW7xLk2VbY9sGd", "4HfJ6mPc1QwEz5RtUvKa"
    found = [f"{key}/x7/Yb2/{tail}", f"{key}/{tail}/{key}/{tail}/9Z", f"{key}{tail}example", f"{key}12345678{tail}", f"{key[:15]}sample{tail[:15]}", f"{key}xxxx{tail}", "qKzRvTnWbxLkpVcYsGdHfJmQ"]
    clean = ["/usr/local/lib/python3/site-packages/numpy", "home/user_1/Documents/reports/2024/07", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "123e4567-e89b-12d3-a456-426614174000", "my-example-password-2024", "getUserAccountBalanceFromServer", "Donaudampfschifffahrtsgesellschaftskapitaen", "src/ModuleName/SomeOtherThing/MainWindow"]
    rows = spark.createDataFrame(list(enumerate(found + clean)), "doc_id bigint, text string")
    got = {r[0]: r[1] for r in secrets.scan(rows).selectExpr("doc_id", "exists(spans, s -> s.kind = 3)").collect()}
    assert [got[i] for i in range(len(got))] == [True] * len(found) + [False] * len(clean)


def test_entropy_matches_brute_force(spark):
    import math

    words = ["q8Zr3TnW7xLk2VbY9sGd4HfJ6mPc1", "abababababababababab12", "A1B2C3D4E5F6a7b8c9d0", "deadbeefdeadbeefdeadbeef01"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(secrets.best_entropy(secrets.F.col("w"))).collect()]
    h = lambda w: -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
    assert got == pytest.approx([max(h(w[i : i + 20]) for i in range(len(w) - 19)) for w in words])


# ---- 5 ---------------------------------------------------------------------------------------------------------------------
def test_bpe(spark, odd, docs):
    path = bpe.default_ranks()
    whole = bpe.encoder(path).encode_ordinary
    for _, t in [*odd[0], *docs[:40], (0, "it's  1st\n\n é x   "), (0, "\x1c a \x85 b")]:
        t = t or ""
        assert np.concatenate([bpe.encode(x, path) for x in bpe.split_safe(t, 64)]).tolist() == whole(t) if len(t) < 6000 else bpe.encode(t, path).tolist() == whole(t)
    got = bpe.bpe_roundtrip(odd[1]).collect()
    want = sorted((str(d), sha((t or "").encode())) for d, t in odd[0])
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == want
    back = bpe.bpe_decode(bpe.bpe_encode(odd[1])).collect()
    assert sorted((str(r["doc_id"]), sha(bytes(r["bytes"]))) for r in back) == want
    assert bpe.bpe_roundtrip(odd[1].limit(0)).count() == 0


# ---- 6 ---------------------------------------------------------------------------------------------------------------------
def test_packing(spark, odd, docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_vocab())
    plain = [(d, t) for d, t in odd[0] if d in (1, 2, 3, 4, 5, 7, 9, 10)] + [(500 + d, t) for d, t in docs] + [(900, "It'S  ΑΣ İstanbul, naïve x\x1cy <|endoftext|> 42nd ét")]
    rows = packing.pack(frame(spark, plain)).toPandas()
    ids = {d: np.array(exact.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for d, t in plain}
    for r in rows.itertuples():
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens * 4 == len(ids[r.doc_id])
    rows = rows.sort_values(["doc_id", "start"])
    assert ((rows["start"] + rows["length"]).groupby(rows["doc_id"]).shift(1, fill_value=0) == rows["start"]).all()
    assert (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].first()).all() and rows["doc_id"].nunique() == len(plain)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert ((rows["offset"] + rows["length"]).groupby(rows["sequence_id"]).shift(1, fill_value=0) == rows["offset"]).all()
    fill = rows.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 4096 and fill.index.tolist() == list(range(len(fill))) and (4096 * len(fill) - fill.sum()) < 2 * 4096
    every = Counter((d, len(exact.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in odd[0])
    got = packing.pack(odd[1]).toPandas()
    heads = got[got["start"] == 0]
    assert Counter((None if np.isnan(d) else int(d), n) for d, n in zip(heads["doc_id"].astype(float), heads["doc_tokens"], strict=True)) == every
    assert got["length"].sum() == sum(n * k for (_, n), k in every.items()) and packing.pack(odd[1].limit(0)).count() == 0


def test_packing_one_hot_length():
    have = np.zeros(64, np.int64)
    have[40] = 10_000  # two don't fit together: the program has to cut
    plan = packing.Plan(3, have, np.zeros(64, np.int64))
    parts = plan.place_units(np.full(10_000, 40), np.arange(10_000), np.arange(10_000), np.zeros(10_000, np.int64))
    seq, off, n = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 2))
    assert n.sum() == 400_000 and len(set(seq.tolist())) <= 400_000 // 64 + 2
    used = np.zeros((seq.max() + 1, 64), int)
    for s, o, k in zip(seq, off, n, strict=True):
        used[s, o : o + k] += 1
    assert used.max() == 1


# ---- 7 ---------------------------------------------------------------------------------------------------------------------
def simple_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, docs):
    near = [(3000 + i, " ".join(f"t{k}" for k in range(i % 3, 400 + i % 5))) for i in range(30)]
    rows = docs[:120] + near + [(8000 + d, t) for d, t in odd[0] if d not in (None, 6)]
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fp = {d: simple_fingerprint(t) for d, t in rows if len(t or "") < 50_000}
    assert all(got[d][0] % 2**64 == f for d, f in fp.items())
    names = sorted(got)
    parent = {d: d for d in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if ((got[a][0] ^ got[b][0]) % 2**64).bit_count() <= 4:
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    assert {d: c for d, (_, c) in got.items()} == {d: find(parent, d) for d in names}


@pytest.mark.parametrize("thresholds", [[1, 1, 0], [0, 0, 0, 0, 0], [1, 0, 0, 0], [1, -1, 1, 0]])
def test_simhash_links_lose_nothing(spark, thresholds):
    """One dense group of different fingerprints, several blocks large, and every kind of allocation."""
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    dense = {int(centre ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)), np.uint64(0))) for _ in range(1500)}
    fps = sorted(dense | {int(x) for x in rng.integers(0, 2**63, 300, dtype=np.uint64)})
    groups = simhash.group_bits(rng.integers(0, 2, (50, 64)).astype(float), len(thresholds))
    items = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    got = [(r["u"] % 2**64, r["v"] % 2**64) for r in simhash.links(items, groups, thresholds).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in got)
    x = np.array(fps, np.uint64)
    for pairs, parent in ((got, {f: f for f in fps}), ([(int(x[i]), int(x[k])) for i in range(len(x)) for k in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 4)], {f: f for f in fps})):
        for u, v in pairs:
            a, b = sorted((find(parent, u), find(parent, v)))
            parent[b] = a
        roots = {f: find(parent, f) for f in fps}
        if pairs is got:
            ours = roots
    assert ours == roots


def test_simhash_odd(spark, odd):
    rows, df = odd
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    fps = [simple_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i, a in enumerate(fps):
        for k in range(i):
            if (a ^ fps[k]).bit_count() <= 4:
                parent[find(parent, i)] = find(parent, k)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(parent, i)].append(d)
    name = lambda i: min((d for d in least[find(parent, i)] if d is not None), default=None)
    assert got == Counter((d, fps[i], name(i)) for i, (d, _) in enumerate(rows))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# ---- 8 ---------------------------------------------------------------------------------------------------------------------
def test_quality_rules(spark, docs, odd):
    rows = docs + [(8000 + d, t) for d, t in odd[0] if d not in (None, 6)]
    got = {r[0]: r for r in quality.judge(frame(spark, rows)).collect()}
    for d, t in rows:
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        r = got[d]
        assert tuple(r)[1:6] == want, d
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(odd[1].limit(0)).count() == 0
    by_id = {d: tuple(got[8000 + d])[1:] for d, _ in odd[0] if d not in (None, 6)}
    same = {t: by_id[d] for d, t in odd[0] if d in by_id}
    # null ids and repeated rows are judged as any row with that text
    assert Counter(tuple(r) for r in quality.judge(odd[1]).collect()) == Counter((d, *same[t]) for d, t in odd[0])
    measured = quality.measure(frame(spark, docs))
    verdicts = [measured.select(quality.cascade(order)).collect() for order in (sorted(quality.RULES), sorted(quality.RULES)[::-1])]
    assert verdicts[0] == verdicts[1]  # the order changes no verdict


# ---- 10 --------------------------------------------------------------------------------------------------------------------
def test_ann(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 64))).astype(np.float32)
    x[100:160] = x[100]
    bad = [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] + [1.0] * 63), (5003, [None] + [1.0] * 63), (5020, [1.0] * 3), (None, [1.0] * 64)]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *bad], "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, pool=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    v, hits = x.astype(float), 0
    for q in range(0, 3000, 20):
        s = ann.exact(v, v[q])
        assert all(s[i] == score for i, score in got[q]) and len(got[q]) == 20 and q not in dict(got[q])
        assert got[q] == sorted(got[q], key=lambda e: (-e[1], e[0]))
        s[q] = -np.inf
        hits += len(set(np.lexsort([np.arange(3000), -s])[:20].tolist()) & {i for i, _ in got[q]})
    assert hits / (150 * 20) >= 0.9 and set(got) == set(range(0, 3000, 20))
    few = ann.nearest(df.where("vec_id < 5"))
    assert few.count() == 4 and ann.nearest(df.limit(0)).count() == 0
    # rows that share an id are rows of their own, as candidates and as queries; ties go to the smaller id
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (5, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r)[1:] for r in ann.nearest(twice.withColumns({"shard": ann.F.lit("s"), "codes": ann.F.lit("c")})).orderBy("rank").collect()]
    assert [(i, s) for _, i, s in got] == [(5, 2.0), *[(1, 1.0)] * 4, *[(2, 1.0)] * 2, *[(3, 1.0)] * 2, (5, 0.0)]
    # one vector that a third of the rows have
    x[:1000] = x[0]
    hot = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(hot).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    near = [got[q] for q in range(0, 1000, 20) if got[q][0][1] == ann.exact(x[:1].astype(float), x[0].astype(float))[0]]
    assert all([i for i, _ in g] == [i for i in range(21) if i != q][:20] for q, g in got.items() if q < 1000 and g in near)


# ---- the registered queries, on whole tables ---------------------------------------------------------------------------------
def test_query_line_dedup(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op1_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()}
    want = lines_kept(docs)
    assert got.keys() == want.keys() and all(got[d][0] == len(t.split("\n")) for d, t in docs)
    assert all((got[d][1] == 0) == (got[d][2] == sha(t)) for d, t in docs)
    assert sum(got[d][2] != want[d] for d in want) <= 2


def test_query_secrets(spark, docs):
    kinds = {"assign": re.compile(secrets.ASSIGN, re.ASCII), "access": re.compile(secrets.ACCESS), "hex": re.compile(secrets.HEX)}
    ok = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_secrets"](spark, SF).collect()}
    for d, t in docs:
        found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) for m in p.finditer(t) if ok[k](m))
        r, n = got[d], Counter(k for *_, k in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])
        text = ",".join(f"{k}:{a}:{z}" for a, _, z, k in found)
        assert r["base_sha256"] == sha(text)
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("entropy")] == (text.split(",") if text else [])
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), secrets.KINDS.index(x.split(":")[0])))


def test_query_bpe(spark, docs):
    whole = bpe.encoder(bpe.default_ranks()).encode_ordinary
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_bpe"](spark, SF).collect()}
    for d, t in docs:
        ids = whole(t)
        r = got[d]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))


def test_query_simhash(spark, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op7_simhash"](spark, SF).collect()}
    fp = {d: simple_fingerprint(t) for d, t in docs}
    assert {d: f for d, (f, _) in got.items()} == {d: f"{f:016x}" for d, f in fp.items()}
    parent = {d: d for d in fp}
    for a in sorted(fp):
        for b in sorted(fp):
            if b < a and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    assert {d: c for d, (_, c) in got.items()} == {d: find(parent, d) for d in fp}


def test_query_packing(spark, docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_vocab())
    rows = queries.QUERIES["op6_packing"](spark, SF).toPandas()
    ids = {d: np.array(exact.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for d, t in docs}
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {d: len(b) // 4 for d, b in ids.items()}
    assert all(zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in rows.itertuples())
    fill = rows.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 4096 and 4096 * len(fill) - fill.sum() <= 0.02 * fill.sum() + 4096


# ---- pipeline --------------------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = p.quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < len(texts)
    rows = [(r["doc_id"], r["text"]) for r in kept.orderBy("doc_id").collect()]
    after = p.lines(spark, kept, SF)
    assert after.columns == docs.columns
    got, want = {r["doc_id"]: sha(r["text"]) for r in after.collect()}, lines_kept(rows)
    assert sum(got[d] != want[d] for d in want) <= 1
    single = p.near_copies(spark, kept, SF)
    heads = {r["component_id"] for r in simhash.near_duplicates(kept).collect()}
    assert {r["doc_id"] for r in single.collect()} == heads and single.count() == len(heads)
    clean = p.masked(spark, kept, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows) and secrets.scan(clean).where("exists(spans, s -> s.kind < 3 and s.kind <> 0)").count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert p.run(spark, SF).selectExpr("count(distinct doc_id)").first()[0] > 0


def test_pipeline_near_copies_with_repeated_and_null_ids(spark):
    """One row of each component stays, whichever ids its rows share with other components."""
    import corpus_pipeline as p

    text = lambda k: " ".join(f"{k}w{i * 31 % 997}" for i in range(400))
    a, b, c, d = (text(k) for k in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, c + " end"), (None, d), (None, a), (2, b)]
    got = p.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    fps = {r[0] for r in simhash.near_duplicates(spark.createDataFrame([(5, c), (6, c + " end")], "doc_id bigint, text string")).select("component_id").collect()}
    assert len(fps) == 1  # c and its near copy are one component
    kept = sorted(((r["doc_id"], r["text"][:2]) for r in got.collect()), key=str)
    assert kept == sorted([(1, "aw"), (2, "bw"), (None, "cw"), (None, "dw")], key=str)


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, one stage after the other."""
    import corpus_pipeline as p

    rows, df = odd
    spark.createDataFrame([(4, 1, 0), (None, 0, 1), (5, None, None), (7, 1, 0), (2, 0, 0), (10, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
    for table in (df, df.limit(0)):
        for name, stage in p.STAGES[:-1]:
            got = stage(spark, table, str(tmp_path))
            assert got.columns == df.columns and got.count() <= table.count(), name
        assert packing_rows(p.packed(spark, table, str(tmp_path))) == (sum(texts.values()) if table is df else 0)
    kept = Counter((r["doc_id"], r["text"]) for r in p.quality(spark, df, str(tmp_path)).collect())
    assert not kept - texts
    lines = p.lines(spark, df, str(tmp_path)).collect()
    assert len(lines) == len(rows) and [r["text"] for r in lines if r["doc_id"] == 1] == [None] and {r["removed"] for r in lines} == {"r"}
    one = Counter(r["doc_id"] for r in p.near_copies(spark, df, str(tmp_path)).collect())
    assert one[1] == 1 and one[2] == one[3] == one[6] == 0  # texts without words are one group, equal texts another
    masked = Counter((r["doc_id"], "a" * 5000 if r["text"] == "<secret>" else r["text"]) for r in p.masked(spark, df, str(tmp_path)).collect())
    assert masked == texts  # of all rows only the long run of hexadecimal digits is a secret
    assert p.run(spark, str(tmp_path)).count() > 0


def packing_rows(pieces):
    """Documents, by their first pieces."""
    return pieces.where("start = 0").count()
