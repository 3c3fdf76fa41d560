"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

A window is as many consecutive words of a document as an item has (the whole document if it is shorter). Words are
lower-cased and stand between white space; a shingle is K words in a row (all words of an item or document that has
fewer), weighted by how often it occurs in the window. Similarity is the sum of the lesser weights over the sum of the
greater ones, and THRESHOLD of it makes a leak.

1. Anchors: shingles of documents that any item has. A window of similarity 0.75 shares 0.75 of the item's shingle
   positions. How many of them each window holds follows from a running sum over where the anchors enter and leave it;
   windows with fewer than that cannot pass and are not fingerprinted. Nothing else is left out.
2. Each such window, and each item, gets a SimHash of BITS bits. Fingerprints are cut into as many blocks as the radius
   and one; two within the radius agree in one block at least, so an equality join by item, block and value finds all of
   them, each once (in the first block that agrees), and the Hamming distance is then checked.
3. The exact similarity of the shingles decides.

Two sets at similarity t have a cosine of 2t / (1 + t): of 0.75, they differ in 22 of 128 bits, 4.3 standard deviation,
while unrelated ones differ in 64. Repeated shingles make ties between bits, which differ more often: in up to a quarter
of the bits, 32 with 4.9 standard deviation, for texts of two shingles by turns. The radius is SLACK of those above the
mean, 47, which leaves room for both; with radius=BITS all windows with enough anchors are verified.

Null or blank texts hold no leak; items without words are ignored, and equal items are each reported. doc_id is to be an
integer number. Columns of other names are ignored. Everything is built-in functions. What comes from the items is
broadcast while it is counted to take less than BROADCAST_BYTES, and shuffled otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, matching

K, BITS, SLACK, THRESHOLD = 5, 128, 6.0, 0.75


def radius_of(threshold: float) -> int:
    """Bits in which sets at the threshold differ, and SLACK standard deviations more."""
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    return min(BITS, math.floor(BITS * p + SLACK * math.sqrt(BITS * p * (1 - p))))


def blocks_of(radius: int) -> list[list[tuple[int, int, int]]]:
    """radius + 1 blocks of the bits, each as parts (word, first bit, bits) of the words of 64 bits."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        cuts = [low, *[c for c in range(64, BITS, 64) if low < c < high], high]
        out.append([(c // 64, c % 64, d - c) for c, d in zip(cuts, cuts[1:], strict=False)])
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles(ws: str) -> Column:
    """array<long>, one for each position."""
    w = F.col(ws)
    each = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(K)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))
    return F.when(F.size(w) >= K, each).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "), F.size(w)))).otherwise(F.array().cast("array<long>"))


def split_texts(texts: DataFrame) -> DataFrame:
    """doc_id and ws. The generator holds the words of a row, so that no later expression splits the text again."""
    return texts.select("doc_id", F.explode(F.array(words(F.col("text")))).alias("ws"))


def fingerprinted(df: DataFrame, items: str, name: str) -> DataFrame:
    """df with name, the SimHash of an array column: words of 64 bits, each of a hash of its own of every item. A bit is
    set if more of the weight has it set than not.

    Several counters share a number: as many as leave each of them room for all items. Columns that are used many times
    are held by a generator, lest they be computed anew for every bit.
    """
    n = F.size(items)
    wide = lambda small, middle, large: F.when(n < 1 << 8, F.lit(small)).when(n < 1 << 16, F.lit(middle)).otherwise(F.lit(large))
    lanes = wide(*[sum(1 << low for low in range(0, 64, w)) for w in (8, 16, 32)])
    words = [F.col(items), *[F.transform(items, lambda h, k=k: F.xxhash64(h, F.lit(k))) for k in range(1, BITS // 64)]]
    held = df.select("*", F.explode(F.array(F.array(*words))).alias("_hashes"), wide(8, 16, 32).alias("_wide"), lanes.cast("long").alias("_lanes"))
    unsigned = lambda x, by: F.call_function("shiftrightunsigned", x, by)
    counts = F.transform("_hashes", lambda hs: F.transform(F.sequence(F.lit(0), F.col("_wide") - 1), lambda b: F.aggregate(hs, F.lit(0).cast("long"), lambda acc, h: acc + unsigned(h, b).bitwiseAND(F.col("_lanes")))))
    held = held.select("*", F.explode(F.array(counts)).alias("_counts"))

    def bit(cs: Column, j: Column) -> Column:
        lane = unsigned(F.get(cs, j % F.col("_wide")), (j - j % F.col("_wide")).cast("int"))
        count = lane.bitwiseAND(wide((1 << 8) - 1, (1 << 16) - 1, (1 << 32) - 1).cast("long"))
        return F.when(2 * count > n, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))

    fp = F.transform("_counts", lambda cs: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(bit(cs, j))))
    return held.withColumn(name, fp).drop("_hashes", "_wide", "_lanes", "_counts")


def block(fp: Column, parts: list[tuple[int, int, int]]) -> Column:
    """The bits of one block of a fingerprint, as a number."""
    out = F.lit(0).cast("long")
    for word, low, bits in parts:
        out = F.shiftleft(out, bits).bitwiseOR(F.shiftrightunsigned(F.get(fp, F.lit(word)), low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two multisets: with equal members ranked apart, that of two sets."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    weighted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(times(a, v), times(b, v)))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))  # no shingle counts twice
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(weighted)
    return common / (F.size(a) + F.size(b) - common)


def fingerprinted_items(benchmark: DataFrame) -> DataFrame:
    """item_id, size (words), m (shingles), items, fp of each item with words."""
    rows = benchmark.select("item_id", words(F.col("text").cast("string")).alias("ws")).where("size(ws) > 0")
    rows = rows.select("item_id", F.size("ws").alias("size"), shingles("ws").alias("items")).select("item_id", "size", F.size("items").alias("m"), "items")
    return fingerprinted(rows, "items", "fp")


def windows_with_anchors(hits: DataFrame, threshold: float) -> DataFrame:
    """doc_id, item_id, m, start of the windows of item size that hold enough anchors.

    hits: doc_id, nd (shingles of the document), pos, item_id, m. An anchor is in the windows that start in a range; each
    range adds one where it begins and takes one where it has ended, so two rows a hit tell the count of every window.
    """
    first = F.greatest(F.lit(0), F.col("pos") - F.col("m") + 1)
    last = F.least("pos", F.greatest(F.lit(0), F.col("nd") - F.col("m")))
    edges = F.array(F.struct(first.alias("at"), F.lit(1).alias("by")), F.struct((last + 1).alias("at"), F.lit(-1).alias("by")))
    steps = hits.where(first <= last).select("doc_id", "item_id", "m", F.inline(edges))
    steps = steps.groupBy("doc_id", "item_id", "m", "at").agg(F.sum("by").alias("by"))
    w = Window.partitionBy("doc_id", "item_id", "m").orderBy("at")
    runs = steps.select("doc_id", "item_id", "m", "at", F.sum("by").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("at").over(w).alias("upto"))
    runs = runs.where((F.col("n") >= threshold * F.col("m")) & F.col("upto").isNotNull())
    return runs.select("doc_id", "item_id", "m", F.explode(F.sequence("at", F.col("upto") - 1)).alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int | None = None) -> DataFrame:
    """doc_id, item_id, start (first word of the best window, from 0), n_words, hamming, similarity.

    One row for each document and item with a window of at least the threshold; the best window is the one of most
    similarity, then the first. doc_id is to be unique; rows without one are left out, as no leak can be named by it.
    radius: how many bits the fingerprints may differ in; by default what follows from the threshold.
    """
    radius = radius_of(threshold) if radius is None else radius
    items = cut(fingerprinted_items(benchmark))
    counted = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    sides = lambda size: F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    nd = F.greatest(F.size("ws") - F.lit(K - 1), F.lit(1))  # rides in each element, lest the array be copied to each row
    parsed = split_texts(texts).select("doc_id", F.explode(F.transform(shingles("ws"), lambda h, i: F.struct(i.alias("pos"), h.alias("h"), nd.alias("nd")))).alias("s"))

    wanted = items.select("item_id", "m", F.explode(F.array_distinct("items")).alias("h"))
    hits = parsed.select("doc_id", "s.pos", "s.h", "s.nd").join(sides(64 * counted["m"])(wanted), "h")  # 64 bytes a row
    windows = cut(windows_with_anchors(hits, threshold))

    holders = cut(windows.select("doc_id").distinct())
    starts = windows.groupBy("doc_id").agg(F.collect_set(F.struct("m", "start")).alias("ats"))  # of one document
    arrays = split_texts(matching(texts, holders, "doc_id")).select("doc_id", F.explode(F.array(shingles("ws"))).alias("all"))
    printed = arrays.join(starts, "doc_id").select("doc_id", F.explode(F.transform("ats", lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), F.slice("all", x["start"] + 1, x["m"]).alias("own")))).alias("w")).select("doc_id", "w.*")
    printed = cut(fingerprinted(printed, "own", "own_fp"))

    asked = printed.select("doc_id", "m", "start", "own_fp").join(windows, ["doc_id", "m", "start"])
    prints = items.select("item_id", "fp")
    if radius >= BITS:
        near = asked.join(sides(64 * counted["n"])(prints), "item_id").withColumn("hamming", hamming(F.col("own_fp"), F.col("fp")))
    else:
        blocks = blocks_of(radius)
        keys = lambda fp: F.array(*[F.struct(F.lit(i).alias("block"), block(F.col(fp), b).alias("value")) for i, b in enumerate(blocks)])
        left, right = asked.select("*", F.inline(keys("own_fp"))), prints.select("*", F.inline(keys("fp")))
        met = left.join(sides(96 * len(blocks) * counted["n"])(right), ["item_id", "block", "value"])
        differ = F.zip_with("own_fp", "fp", lambda x, y: x.bitwiseXOR(y))
        earlier = F.exists(F.array(*[F.struct(F.lit(i).alias("i"), (block(differ, b) == 0).alias("same")) for i, b in enumerate(blocks)]), lambda x: x["same"] & (x["i"] < F.col("block")))
        near = met.withColumn("hamming", hamming(F.col("own_fp"), F.col("fp"))).where((F.col("hamming") <= radius) & ~earlier)
    found = near.select("doc_id", "m", "start", "item_id", "hamming").join(printed.select("doc_id", "m", "start", "own"), ["doc_id", "m", "start"])
    sure = found.join(sides(8 * counted["m"] + 64 * counted["n"])(items.select("item_id", "size", "items")), "item_id")
    sure = sure.withColumn("similarity", similarity(F.col("own"), F.col("items"))).where(F.col("similarity") >= threshold)
    best = sure.groupBy("doc_id", "item_id", "size").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "hamming")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.start").alias("start"), F.col("size").alias("n_words"), F.col("x.hamming").alias("hamming"), (-F.col("x.s")).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a leak; all columns stay."""
    bad = cut(leaks(docs, benchmark, threshold).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct())
    return matching(docs, bad, "doc_id", "left_anti")
