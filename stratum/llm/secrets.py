"""Secret scans with column expressions alone.

Base kinds are patterns, matched leftmost and non-overlapping: the text between matches (split) and the matches
themselves (extract) give every position by a running sum, in code points. The method adds spans: candidate strings
(20 or more characters of the base64 alphabet, with a digit and a letter or with small letters before capital ones) get
the Shannon entropy of each sliding window of 20 characters from incremental counts; a candidate whose best window passes
the threshold of its character class (hex, letters without a digit, base64) is a span, unless it is a path, a UUID, joined
words or words in camel case as a whole or a base span overlaps it. Alphabets,
counting runs and words like "example" exempt the windows that touch or hold them, not the candidate.

Null texts count as empty and have no spans; very long texts are scanned whole. Null ids, repeated rows, ties and extra
columns: each row is scanned by itself. An empty table gives an empty one.
Cost follows the text's length; the work on a span is done only for rows in which its pattern occurs.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])|(?=[A-Za-z+/_=-]*[a-z][A-Z]))[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character that the best window must reach, by class.
THRESHOLDS = {"hex": 3.0, "letters": 3.8, "base64": 3.75}
#: A path's segment: words of one case (or with a capital, or in camel case) and short numbers.
_WORD = "(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+|[0-9]{1,4})"
_SEGMENT = f"{_WORD}(?:[-_]{_WORD})*[0-9]{{0,4}}"
#: Whole candidates that are no secrets: UUIDs, paths of three slashes or more, words joined by signs.
ALLOW = rf"^(?i:[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})$|^(?=(?:[^/]*/){{3}})/?{_SEGMENT}(?:/{_SEGMENT})*/?$|^{_WORD}(?:[-_/=+]{_WORD})*[-_/=+]?[0-9]{{0,4}}$"
#: Runs that no window may touch (alphabets and counting, as far as they go), and words that no window may hold whole.
_LONGER = lambda run, rest: run + "".join(f"(?:{c}" for c in rest) + ")?" * len(rest)
RUNS = "(?i)" + "|".join([_LONGER("abcdefgh", "ijklmnopqrstuvwxyz"), _LONGER("01234567", "89"), _LONGER("12345678", "90"), "xxxx+"])
WORDS = ("(?i)(e)(xampl)(e)", "(?i)(s)(ampl)(e)", "(?i)(d)(umm)(y)")


def spans(text: Column, pattern: str, least: Column | None = None, group: int = 0, size: int = 1) -> Column:
    """array<struct<start, end, body>> of the matches whose group has `size` characters or more."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,body:string>>)")

    def located(gaps: Column, found: Column, values: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(gaps[i])
            end = start + F.length(found[i])
            one = F.struct(start.alias("start"), end.alias("end"), found[i].alias("body"))
            out = F.when(F.length(values[i]) >= size, F.array_append(acc["out"], one)).otherwise(acc["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"])

    find = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    some = let(F.struct(F.split(text, pattern, -1).alias("g"), find(0).alias("m"), find(group).alias("v")), lambda s: located(s["g"], s["m"], s["v"]))
    return F.when(text.rlike(pattern), some).otherwise(empty)


def best_entropy(word: Column) -> Column:
    """The largest Shannon entropy of a window, in bits a character; each step changes two counts."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr(word, i + 1, F.lit(1))) - 1
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))

    def add(acc: Column, k: Column, by: int) -> Column:
        n = acc["n"][k]
        return F.struct(
            F.transform(acc["n"], lambda v, j: F.when(j == k, v + by).otherwise(v)).alias("n"),
            (acc["s"] + weight[n + by] - weight[n]).alias("s"),
            acc["least"].alias("least"),
        )

    def step(acc: Column, i: Column) -> Column:
        gone = F.when(i >= WINDOW, let(code(i - WINDOW), lambda k: add(acc, k, -1))).otherwise(acc)
        now = let(F.struct(gone.alias("a"), code(i).alias("k")), lambda x: add(x["a"], x["k"], 1))
        full = lambda a: F.when(i >= WINDOW - 1, F.least(a["least"], a["s"])).otherwise(a["least"])
        return let(now, lambda a: F.struct(a["n"].alias("n"), a["s"].alias("s"), full(a).alias("least")))

    return F.aggregate(F.sequence(F.lit(0), F.length(word) - 1), zero, step, lambda a: F.lit(math.log2(WINDOW)) - a["least"] / WINDOW)


def entropy_spans(text: Column, base: Column) -> Column:
    limit = lambda w: F.when(w.rlike("^[0-9a-fA-F]+$"), F.lit(THRESHOLDS["hex"])).when(~w.rlike("[0-9]"), F.lit(THRESHOLDS["letters"])).otherwise(F.lit(THRESHOLDS["base64"]))
    apart = lambda e: ~F.exists(base, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))
    found = spans(text, CANDIDATE, size=WINDOW)
    fresh = F.filter(found, lambda e: ~e["body"].rlike(ALLOW) & apart(e))

    def passes(e: Column) -> Column:
        free = F.regexp_replace(e["body"], RUNS, " ")
        for word in WORDS:
            free = F.regexp_replace(free, word, "$1$2 $2$3")
        parts = F.filter(F.split(free, " "), lambda w: F.length(w) >= WINDOW)
        return F.exists(parts, lambda w: best_entropy(w) >= limit(e["body"]))

    return F.filter(fresh, passes)


def scan(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Adds array<struct<start, kind, end>> in order of start, then kind as listed; kind is the index in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = lambda found, k: F.transform(found, lambda e: F.struct(e["start"].alias("start"), F.lit(k).alias("kind"), e["end"].alias("end")))

    def both(t: Column) -> Column:
        base = F.concat(mark(spans(t, ASSIGN, group=2, size=6), 0), mark(spans(t, ACCESS, size=20), 1), mark(spans(t, HEX + "(?<=[0-9a-f]{24})", size=24), 2))
        return let(base, lambda b: F.sort_array(F.concat(b, mark(entropy_spans(t, b), 3))))

    return docs.withColumn(out, let(text, both))


def joined(found: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda e: F.concat(kind[e["kind"]], F.lit(":"), e["start"], F.lit(":"), e["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """The rows with every span (overlapping ones joined) replaced by a mark."""

    def clean(t: Column, found: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            fresh = F.concat(acc["out"], F.substring(t, acc["at"] + 1, e["start"] - acc["at"]), F.lit(mask))
            return F.struct(F.greatest(acc["at"], e["end"]).alias("at"), F.when(e["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(found, zero, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))

    (hidden,) = unused(docs.columns, "spans")
    marked = scan(docs, text_col, hidden)
    return marked.withColumn(text_col, F.when(F.size(hidden) > 0, clean(F.col(text_col), F.col(hidden))).otherwise(F.col(text_col))).drop(hidden)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(s: Column) -> Column:
        count = lambda k: F.size(F.filter(s, lambda e: e["kind"] == k)).cast("long")
        base = F.filter(s, lambda e: e["kind"] < 3)
        return F.struct(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"))

    return found.select("doc_id", let(F.col("spans"), digest).alias("r")).select("doc_id", "r.*")
