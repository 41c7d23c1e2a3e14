"""Quality rules as a short-circuit cascade, with column expressions alone.

Counts that the result carries are computed once a text. The further rules are put in an order first: on a bounded
sample each rule's run time (cost: what it takes beyond a rule that does nothing, the least of several warm runs) and share
of rejected rows (selectivity) are measured, and rules go by rejection per cost. A row leaves at the first rule that rejects it, so later rules aren't evaluated for it. The order changes no verdict.

Null texts count as empty: no words, so the base rule rejects them. Null ids, repeated rows, ties and extra columns: each
row is judged by itself, very long texts whole; an empty table gives an empty result. Windows are compared by 64-bit hashes within one text.
"""
from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table

SYMBOLS = "#*$%&|<>"
SPAN = 5
SAMPLE_ROWS = 2000
RUNS, LEAST_COST = 3, 1e-4
#: Name -> condition that rejects; n_words is 10 or more where they run.
RULES = {
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * size(filter(split(__text, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]'))",
    "capitals": "2 * size(regexp_extract_all(__text, '\\\\p{Lu}', 0)) > word_chars",
    "bare_words": "2 * size(regexp_extract_all(__text, '(?<![^\\\\x20\\\\x09-\\\\x0D])[^\\\\p{L}\\\\x20\\\\x09-\\\\x0D]+(?![^\\\\x20\\\\x09-\\\\x0D])', 0)) > n_words",
}


def repeated_words(words: Column) -> Column:
    """Words inside windows of five that occur twice or more."""
    hashes = F.when(F.size(words) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(words) - SPAN), lambda i: F.xxhash64(*[words[i + k] for k in range(SPAN)]))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def covered(p: Column) -> Column:
        gain = F.transform(p, lambda x, j: F.when(j + 1 < F.size(p), F.least(F.lit(SPAN), F.get(p, j + 1) - x)).otherwise(SPAN))
        return F.aggregate(gain, F.lit(0), lambda a, g: a + g)

    def twice(s: Column) -> Column:
        same = lambda j, h: F.coalesce(F.get(s, j)["h"] == h, F.lit(False))
        return F.filter(s, lambda e, j: same(j - 1, e["h"]) | same(j + 1, e["h"]))

    def count(h: Column) -> Column:
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(s, lambda v: F.sort_array(F.transform(twice(v), lambda e: e["i"])))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(places, covered)).otherwise(0)

    return let(hashes, count).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the null-free text as __text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda t, signs: F.length(F.translate(t, signs, ""))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(t: Column) -> Column:
        return F.struct(
            let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
            without(t, " \t\n\x0b\x0c\r").cast("long").alias("c"),
            (F.length(t) - without(t, SYMBOLS)).cast("long").alias("s"),
            let(lines(t), lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("d"),
        )

    m = F.col("__m")
    found = docs.withColumn("__text", text).withColumn("__m", let(F.col("__text"), counts))
    return found.withColumns({"n_words": m["w"]["n"], "word_chars": m["c"], "n_symbols": m["s"], "n_dup_lines": m["d"], "n_repeat_words": m["w"]["r"]}).drop("__m")


def order_rules(measured: DataFrame, rules: dict[str, str] = RULES) -> list[str]:
    """Rules by rejected rows per second on the sample; each is timed over a cached bounded sample, RUNS times after one
    that compiles it, beside a rule that does nothing."""
    sample = measured.where("n_words >= 10").select("__text", "n_words", "word_chars", "n_symbols", "n_dup_lines").limit(SAMPLE_ROWS).persist()
    rows = sample.count()

    def measured_rule(rule: str) -> tuple[int, float]:
        rejected, took = sample.where(rule).count(), []
        for _ in range(RUNS):
            began = time.perf_counter()
            sample.where(rule).count()
            took.append(time.perf_counter() - began)
        return rejected, min(took)

    idle = measured_rule("n_words < 0")[1]
    gain = {}
    for name, rule in rules.items():
        rejected, took = measured_rule(rule)
        gain[name] = (rejected + 0.5) / max(rows, 1) / max(took - idle, LEAST_COST)
    sample.unpersist()
    return sorted(rules, key=lambda name: -gain[name])


def cascade(order: list[str], rules: dict[str, str] = RULES) -> Column:
    """True if no rule rejects: one CASE, whose later branches run only if the earlier ones don't."""
    return F.expr("case " + " ".join(f"when {rules[name]} then false" for name in order) + " else true end")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    # one row in 16 by hash of the id, and of those at most SAMPLE_ROWS: orders the rules, decides nothing
    order = order_rules(measure(own.where(F.pmod(F.xxhash64("__id"), F.lit(16)) == 0).limit(SAMPLE_ROWS), "__t"))
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    found = measure(own, "__t").withColumn("base_failed", base).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order)))
    return found.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
