"""Fuzzy line dedup by MinHash, with DataFrame functions alone.

1. Lines that hold a word are identified by a 64-bit hash.
2. A line's shingles are its runs of 7 UTF-16 units, all of them, whatever its length. Each is hashed once, where the text
   is read; the j-th minimum is over the hashes' products with the j-th constant, so that lines with few different shingles
   have different minima, too. Equal lines meet in the minima's aggregation, which is combined before its shuffle, so texts
   aren't shuffled and a hot line costs a row a task.
3. The sixteen minima are the points of a four by four grid. Its rows, columns and diagonals, no two of which share more
   than one point, are twelve bands of four. Of two lines with Jaccard similarity 0.8, about 98 % share a band.
4. In each band's bucket a pivot (the minimum under a fixed order) is compared with all others by exact Jaccard of the
   shingle sets. So a bucket of near copies costs one comparison a line.
5. Verified links go to a distributed union-find (components).
6. Buckets that hold lines of several components are dealt, without their pivots, into blocks of bounded size. Where two
   blocks meet, lines of different components with nine or more equal minima are compared, in the smallest key that they
   share; of pairs of similarity 0.8 that share a band, 99.6 % have nine. Only links leave a task, but the comparisons grow
   with the square of a bucket's lines that are neither links nor far apart. Then the union-find runs again.
7. Of a component's occurrences the first stays: smallest id, then text hash, then position.

Buckets, lines and components that hold more than one in SHARE of all rows are few, whatever the corpus. Their keys are
broadcast and their rows stay where they are; all others meet by hash.

Null texts count as empty and stay null. Lines without a word always stay. A null id comes before all others. Repeated rows
(same id and text) count once, and all of them get the same result. Lines under 7 units match only exactly; very long lines
are read whole. An empty table gives an empty one. Extra columns stay as they are, whatever their names. Line identity in
links is one 64-bit hash.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, SHARE, Scratch, join_counted, let, partitions, settings, table, unused
from .components import components

SHINGLE, SIDE = 7, 4
MINIMA = SIDE * SIDE
#: Lines of the grid: rows, columns, diagonals (point 4x + y with the same x, y, x xor y).
BANDS = [[SIDE * x + y for x in range(SIDE) for y in range(SIDE) if same(x, y) == b] for same in (lambda x, y: x, lambda x, y: y, lambda x, y: x ^ y) for b in range(SIDE)]
#: Similar: |A and B| / |A or B| >= 4 / 5, in whole numbers.
PART, WHOLE = 4, 5
STEP = 4
AGREE = 9
NIBBLE = 64 // MINIMA
BLOCK_LINES, BLOCK_UNITS = 256, 1_000_000
SAMPLED = 64


def constant(j: int, of: int) -> int:
    """The j-th of that many fixed odd 31-bit numbers: one from each equal part of the range, by a splitmix step of j."""
    z = (j + 1) * 0x9E3779B97F4A7C15 % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    part = 2**31 // of
    return j * part + (z ^ z >> 31) % part | 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): what identifies a document here, and its text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lines_of(own: DataFrame) -> DataFrame:
    found = own.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return found.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h1", F.xxhash64("line"))


def signatures(occurrences: DataFrame) -> DataFrame:
    """(h1, n, whole, m0...) of (h1, line): how often a line occurs, if it has SHINGLE units, and its minima.

    Every occurrence is hashed where it is read, so that minima are shuffled and texts aren't; copies meet map-side. A
    generated row stands for STEP shingles (the last one stands in for those past the end)."""
    b = occurrences.select("h1", F.encode("line", "UTF-16BE").alias("b")).withColumn("last", F.expr(f"greatest(0, cast(length(b) div 2 as int) - {SHINGLE})"))
    at = b.select("h1", "b", "last", (F.length("b") >= 2 * SHINGLE).alias("whole"), F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    place = lambda k: 2 * F.least(F.col("i") + k, F.col("last")) + 1
    h = at.select("h1", "whole", "i", *[F.shiftrightunsigned(F.xxhash64(F.substring("b", place(k), F.lit(2 * SHINGLE))), 33).alias(f"s{k}") for k in range(STEP)])
    value = lambda k, j: (F.col(f"s{k}") * F.lit(constant(j, MINIMA)).cast("long")).bitwiseAND(F.lit(2**31 - 1))
    minima = [F.min(F.least(*[value(k, j) for k in range(STEP)])).alias(f"m{j}") for j in range(MINIMA)]
    # 31 bits times 31 bits: no overflow, so none is looked for
    with settings(h.sparkSession, {"spark.sql.ansi.enabled": "false"}):
        sig = h.groupBy("h1", "whole").agg(*minima, F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("n"))
    return sig.select("h1", "n", "whole", *[F.col(f"m{j}").cast("int").alias(f"m{j}") for j in range(MINIMA)])


def shingles(line: Column) -> Column:
    """A line's shingles, as hashes; units of 2 bytes."""
    raw = F.encode(line, "UTF-16BE")
    return let(raw, lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (2 * SHINGLE - 1), F.lit(2)), lambda i: F.xxhash64(F.substr(b, i, F.lit(2 * SHINGLE)))))


def buckets(made: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, h1, p, n) of the buckets with two lines or more: each line's keys, and the bucket's pivot and size. A key's
    last four bits are its band."""
    mix = F.lit(0x5851F42D4C957F2D)
    band = lambda k: F.xxhash64(F.lit(k), *[f"m{j}" for j in BANDS[k]]).bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(k))
    entries = lambda sig: sig.select("h1", F.explode(F.array(*[band(k) for k in range(len(BANDS))])).alias("key"))

    def pivots(every: DataFrame) -> DataFrame:
        least = every.groupBy("key").agg(F.min(F.col("h1").bitwiseXOR(mix)).alias("p"), F.count("*").alias("n"))
        return least.where("n > 1").select("key", F.col("p").bitwiseXOR(mix).alias("p"), "n")

    every = entries(made)
    # a sample by hash finds the keys that one task shouldn't hold; it decides where rows meet, not which
    sample = made.where(F.pmod("h1", F.lit(SAMPLED)) == 0)
    large = max(sample.count() // SHARE, 64)
    busy = scratch.put(entries(sample).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("key"), "busy")
    if busy.isEmpty():
        dealt = every.repartition("key")
        return dealt.join(pivots(dealt), "key")
    # fewer than SHARE keys a band
    few = F.broadcast(busy)
    dealt, stay = every.join(few, "key", "left_anti").repartition("key"), every.join(few, "key", "left_semi")
    return dealt.join(pivots(dealt), "key").unionByName(stay.join(F.broadcast(pivots(stay)), "key"))


def verified(asked: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (u, v) of those pairs (h1, p) whose shingle sets are similar."""
    pairs = asked.join(texts.select("h1", F.col("line").alias("a")), "h1").join(texts.select(F.col("h1").alias("p"), F.col("line").alias("b")), "p")
    # a generated row: so that the condition doesn't hash the shingles again at each of its places
    sets = pairs.select("h1", "p", F.explode(F.array(F.struct(shingles(F.col("a")).alias("a"), shingles(F.col("b")).alias("b")))).alias("s"))
    common = F.size(F.array_intersect("s.a", "s.b"))
    # most links show without the union: with repeats, the two sizes are upper bounds
    alike = ((WHOLE + PART) * common >= PART * (F.size("s.a") + F.size("s.b"))) | (WHOLE * common >= PART * F.size(F.array_union("s.a", "s.b")))
    return scratch.put(sets.where(alike).select(F.least("h1", "p").alias("u"), F.greatest("h1", "p").alias("v")), name)


def low_bits() -> Column:
    """NIBBLE low bits of each minimum, in one number."""
    return reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"m{j}").cast("long").bitwiseAND(F.lit(2**NIBBLE - 1)), NIBBLE * j) for j in range(MINIMA)])


def near(a: Column, b: Column) -> Column:
    """Of two such numbers, whether AGREE of their parts are equal: so they are wherever AGREE minima are, and it takes few
    steps to tell."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))) <= MINIMA - AGREE


def block_links(tried: DataFrame, made: DataFrame, linked: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links across components among the lines of each bucket that are not its pivot.

    Two lines are compared in the smallest key they share, if AGREE of their minima are equal. A line's smaller keys go
    with it, to tell."""
    members = tried.where("n > 2 and h1 <> p").select("key", "h1")
    rooted = members.join(linked, members["h1"] == linked["node"], "left").select("key", "h1", F.coalesce("root", "h1").alias("root"))
    sized = rooted.join(texts.select("h1", F.length("line").alias("units")), "h1")
    mixed = sized.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"), F.sum("units").alias("units")).where("a <> b")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_LINES), F.ceil(F.col("units") / BLOCK_UNITS)).cast("int")
    members = rooted.join(mixed.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    own = tried.groupBy("h1").agg(F.collect_list("key").alias("keys"))
    signed = made.select("h1", F.array(*[f"m{j}" for j in range(MINIMA)]).alias("minima"), low_bits().alias("low"))
    smaller = F.filter("keys", lambda k: k < F.col("key"))
    full = members.join(own, "h1").join(signed, "h1").join(texts, "h1").withColumn("keys", smaller)
    held = scratch.put(full.groupBy("key", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("h1", "root", "keys", "minima", "low", "line")).alias("items")), "blocks")
    left = held.select("key", F.col("block").alias("i"), F.col("items").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    pairs = left.join(held.select("key", "block", F.col("items").alias("y")), ["key", "block"])
    pairs = pairs.repartition(4 * partitions(members.sparkSession), "key", "i", "block")  # small rows, long work: not to be merged into few tasks
    same = F.col("i") == F.col("block")
    agree = lambda a, b: F.aggregate(F.sequence(F.lit(0), F.lit(MINIMA - 1)), F.lit(0), lambda n, j: n + (a["minima"][j] == b["minima"][j]).cast("int"))

    def asked(a: Column, b: Column) -> Column:
        return (a["root"] != b["root"]) & (~same | (a["h1"] < b["h1"])) & near(a["low"], b["low"]) & ~F.arrays_overlap(a["keys"], b["keys"]) & (agree(a, b) >= AGREE)

    # for each line of one block, the places of the lines of the other that it is compared with
    places = F.transform("x", lambda a: F.filter(F.sequence(F.lit(0), F.size("y") - 1), lambda j: let(F.col("y")[j], lambda b: asked(a, b))))
    found = pairs.select(same.alias("same"), "x", "y", places.alias("places"))
    sets = lambda items: F.when(F.exists("places", lambda p: F.size(p) > 0), F.transform(items, lambda m: F.struct(m["h1"].alias("h1"), F.array_distinct(shingles(m["line"])).alias("set"))))
    ready = found.select("same", sets(F.col("y")).alias("y"), F.when(~F.col("same"), sets(F.col("x"))).alias("x"), "places").select(F.coalesce("x", "y").alias("x"), "y", "places")

    def alike(a: Column, b: Column) -> Column:
        # |A and B| / (|A| + |B| - |A and B|) >= PART / WHOLE, with the common number on one side
        fits = WHOLE * F.least(F.size(a), F.size(b)) >= PART * F.greatest(F.size(a), F.size(b))
        return fits & ((WHOLE + PART) * F.size(F.array_intersect(a, b)) >= PART * (F.size(a) + F.size(b)))

    x, y = F.col("x"), F.col("y")
    link = lambda i, j: F.struct(F.least(x[i]["h1"], y[j]["h1"]).alias("u"), F.greatest(x[i]["h1"], y[j]["h1"]).alias("v"))
    of = lambda js, i: F.transform(F.filter(js, lambda j: alike(x[i]["set"], y[j]["set"])), lambda j: link(i, j))
    links = ready.select(F.flatten(F.transform("places", of)).alias("links"))
    # an inner generator would have the optimizer ask for arrays that aren't empty, and make them again for it
    return scratch.put(links.select(F.explode_outer("links").alias("l")).where("l is not null").select("l.*"), "links-blocks")


def line_components(tried: DataFrame, made: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Lines by bucket (buckets), their minima and their texts -> (node, root)."""
    first = verified(tried.where("h1 <> p").select("h1", "p").distinct(), texts, scratch, "links")
    linked = components(first, scratch, "components")
    more = block_links(tried, made, linked, texts, scratch)
    return components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), scratch, "components-again")


def duplicate_lines(own: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, th, removed array<int>): positions of the lines that go, for documents that have any."""
    occurrences = lines_of(own)
    made = scratch.put(signatures(occurrences), "signatures")
    tried = scratch.put(buckets(made.where("whole"), scratch), "tried")
    wanted = scratch.put(made.select("h1", "n").join(tried.select("h1").distinct(), "h1", "left_semi"), "wanted")
    total = lambda rows: int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    lines = join_counted(occurrences.select("h1", "line"), wanted, ["h1"], total(made))
    texts = scratch.put(lines.groupBy("h1").agg(F.min("line").alias("line")), "texts", small=False)
    linked = line_components(tried, made, texts, scratch)
    named = linked.union(linked.select("root", "root").distinct())
    counted = made.select("h1", "n").join(named, made["h1"] == named["node"], "left").select("h1", "n", F.coalesce("root", "h1").alias("root"), "node")
    roots = scratch.put(counted.where("n > 1 or node is not null").select("h1", "n", "root"), "roots")
    rows = total(roots)
    scratch.drop("signatures", "busy", "wanted", "texts", "tried", "links", "blocks", "links-blocks")
    of = scratch.put(join_counted(occurrences.select("h1", "id", "th", "pos"), roots, ["h1"], rows).select("root", "id", "th", "pos"), "occurrences", small=False)
    first = scratch.put(of.groupBy("root").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.count("*").alias("n")), "first")
    gone = join_counted(of, first, ["root"], rows).where(F.struct("id", "th", "pos") != F.col("first"))
    made = scratch.put(gone.groupBy("id", "th").agg(F.collect_set("pos").alias("removed")), "gone")
    scratch.drop("roots", "occurrences", "first", "components*")
    return made


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, counts: tuple[str, str] | None = ("__n_lines", "__n_removed")) -> DataFrame:
    """The rows with the text without its later duplicates; with the number of lines and of those removed, if columns for
    them are named (columns of these names are replaced)."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    gone = duplicate_lines(keyed(docs, id_col, text_col), scratch)
    one, two, removed = unused(docs.columns, "id", "th", "removed")
    marked = docs.withColumns({one: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), two: F.xxhash64(text_col)})
    joined = marked.join(gone.toDF(one, two, removed), [one, two], "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)

    def rest(v: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col(removed))
        return F.array_join(F.transform(stay, lambda i: v[i]), "\n")

    added = {text_col: F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(let(lines, rest))}
    if counts:
        n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
        added |= {counts[0]: n.cast("long"), counts[1]: F.coalesce(F.size(removed), F.lit(0)).cast("long")}
    return joined.withColumns(added).select(*docs.columns, *(c for c in counts or () if c not in docs.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
