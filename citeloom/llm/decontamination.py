"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions alone.

A text's shingles are its runs of five words; an item of one to four words is one shingle of its own length.  An item's
fingerprint is the majority, bit by bit, of the hashes of its shingles, repeats counted, and a window of a document that
is as long as an item gets one the same way.  Fingerprints are found by a multi-index: two within RADIUS bits differ in
at most three bits of one of five blocks, so each item stands in the index under all values within two bits of its blocks,
and a window looks up all values within one bit of its own.  Pairs within the radius are verified by exact weighted
similarity: shared shingles over all shingles, each as often as it occurs.

To fingerprint every window of a corpus in SQL functions would take 64 counters a word and item size.  A window of
similarity s with an item of the same size shares at least 2 s / (1 + s) of its shingles with it, so windows with fewer
shingles of any item of that size are not built; none that could match is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: At similarity 0.8 fingerprints differ in 9.6 of 64 bits on average, in over 15 with a probability of 0.02, in over 19 of 0.0005.
WIDTH, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 5
#: Bits of a block that the windows' side flips; the index, which is broadcast, flips the rest.
ASKED = 1
#: First bits of the blocks, and the end.
EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
#: Broadcast up to so many benchmark shingles, index rows or matched document ids; beyond, Spark joins by shuffle.
FEW = 1_000_000


def words_of(text: str) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_shingles(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Puts sh, the hashes of the runs of ``width`` words of the lower-cased text in order, in place of text.

    A lambda binds the words' hashes, and a generator of one row gives sh: as plain columns, the optimizer would copy
    their expressions into each use.
    """
    hashed = F.transform(words_of("text"), lambda w: F.xxhash64(w))

    def over(w: F.Column) -> F.Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        return F.struct(F.when(F.size(w) >= width, each).otherwise(F.array().cast("array<bigint>")).alias("sh"))

    return df.select(*(c for c in df.columns if c != "text"), F.inline(F.transform(F.array(hashed), over)))


def fingerprint(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """(keys, fp): the SimHash of an array of hashes a row.  Counts of two bits share a long, 32 bits each."""
    lane = (1 << 32) | 1
    each = rows.select(*keys, F.explode(hashes).alias("h"))
    sums = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(lane))).alias(f"s{j}") for j in range(32)))

    def bit(b: int) -> F.Column:
        count = F.shiftrightunsigned(f"s{b % 32}", 32 * (b // 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(2 * count > F.col("n"), F.lit((1 << b) - (1 << 64) * (b == 63))).otherwise(F.lit(0).cast("long"))

    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), (bit(b) for b in range(64))).alias("fp"))


def block_key(number: int, value: F.Column) -> F.Column:
    return value * BLOCKS + number


def blocks(fp: str) -> list[F.Column]:
    """The values of a fingerprint's blocks."""
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(EDGES, EDGES[1:])]


def masks(block: int, flips: int) -> list[int]:
    """All ways to flip at most ``flips`` bits of a block."""
    wide = EDGES[block + 1] - EDGES[block]
    return [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(wide), n)]


def near_values(block: int, value: F.Column, flips: int) -> F.Column:
    """All values that differ from a block's in at most ``flips`` bits."""
    return F.transform(F.array(*map(F.lit, masks(block, flips))), lambda m: value.bitwiseXOR(m.cast("long")))


def near_keys(block: int, value: F.Column, flips: int) -> F.Column:
    return F.transform(near_values(block, value, flips), lambda x: block_key(block, x))  # a second parameter would be the place


def flipped(radius: int) -> tuple[int, int]:
    """Bits of a block that the index and the windows flip: together as many as two within the radius differ in, in one block."""
    return radius // BLOCKS - min(ASKED, radius // BLOCKS), min(ASKED, radius // BLOCKS)


def near_blocks(fp: str, flips: int) -> F.Column:
    """The keys of all values that near to a fingerprint's blocks, one a row."""
    return F.explode(F.flatten(F.array(*(near_keys(b, v, flips) for b, v in enumerate(blocks(fp))))))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def window_starts(similarity: float) -> F.Column:
    """Starts of the windows of w shingles that hold enough of the sorted places ps of known shingles, for items of
    ``size``: the k-th next place decides which windows hold k of them.  Every start comes once."""
    k, w = F.col("k"), F.col("w")

    def of(j: F.Column) -> F.Column:
        a, b = F.get("ps", j), F.get("ps", j + k - 1)
        low = F.greatest(b - w + 1, F.lit(0), F.coalesce(F.when(j > 0, F.get("ps", j - 1) + 1), F.lit(0)))
        high = F.least(a, F.col("n") - w)
        return F.when((b - a < w) & (low <= high), F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size("ps") - k), of))


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance): the best window of every document and item it leaks.

    start counts words from 0; of equal similarities the first window is given.  A document shorter than an item is one
    window.  Items of one to four words match where a document holds just these words; documents of fewer than five
    words match such items alone.  Items without a word, null texts and null ids match nothing.  Rows that repeat a
    doc_id count as one document's and are compared each on its own.
    """
    scratch = Scratch(spark, "decontamination")
    known = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").dropDuplicates()
    listed = scratch.save(known.select("item_id", "text", F.least(F.size(words_of("text")), F.lit(WIDTH)).alias("width")).where("width > 0"))
    out = None
    for width in sorted(r.width for r in listed.select("width").distinct().collect()) or [WIDTH]:  # five at most
        found = _matches(scratch, docs, listed.where(F.col("width") == width).drop("width"), similarity, radius, width)
        out = found if out is None else out.unionByName(found)
    return out


def _matches(scratch: Scratch, docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, width: int) -> DataFrame:
    items = scratch.save(with_shingles(benchmark, width).withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.size("sh")))
    n_items, n_shingles = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    known = items.select("size", F.explode("sh").alias("h")).distinct()
    sources = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    body = with_shingles(sources, width).select("doc_id", F.xxhash64("sh").alias("row_key"), F.size("sh").alias("n"), "sh")
    # 1. shingles that some item has, and the starts of the item-sized windows that hold enough of them
    found = body.select("doc_id", "row_key", "n", F.posexplode("sh").alias("pos", "h")).join(small(known, n_shingles), "h")
    placed = found.groupBy("doc_id", "row_key", "n", "size").agg(F.array_sort(F.collect_set("pos")).alias("ps"))  # bounded by the text
    placed = placed.withColumn("w", F.least("n", "size")).withColumn("k", F.greatest(F.lit(1), F.ceil(similarity * (F.col("w") + F.col("size")) / (1 + similarity) - 1e-9).cast("int")))
    starts = placed.where(F.size("ps") >= F.col("k")).select("doc_id", "row_key", "size", "w", F.explode(window_starts(similarity)).alias("start"))
    windows = scratch.save(starts)
    # 2. the windows' shingles, from the documents that have any
    ids = scratch.save(windows.select("doc_id").distinct())
    held = scratch.save(with_shingles(sources.join(small(ids, ids.count()), "doc_id", "left_semi"), width).select("doc_id", F.xxhash64("sh").alias("row_key"), "sh"))
    key = ["doc_id", "row_key", "size", "w", "start"]
    filled = windows.join(held.dropDuplicates(["doc_id", "row_key"]), ["doc_id", "row_key"]).select(*key, F.slice("sh", F.col("start") + 1, F.col("w")).alias("win"))
    # 3. fingerprints, and the pairs within the radius by the multi-index
    prints = scratch.save(fingerprint(filled, key, "win")).withColumnRenamed("fp", "fp_doc")
    held_by_index, asked_for = flipped(radius)
    asked = prints.select(*key, "fp_doc", near_blocks("fp_doc", asked_for).alias("block"))
    of_items = scratch.save(fingerprint(items, ["row", "size"], "sh"))
    index = of_items.select("row", "size", "fp", near_blocks("fp", held_by_index).alias("block"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_doc")))
    met = asked.join(small(index, n_items * sum(len(masks(b, held_by_index)) for b in range(BLOCKS))), ["size", "block"])
    near = scratch.save(met.withColumn("distance", distance).where(F.col("distance") <= radius).select(*key, "row", "distance").distinct())
    # 4. exact weighted similarity
    counts = items.select("row", "item_id", F.explode("sh").alias("h")).groupBy("row", "item_id", "h").agg(F.count(F.lit(1)).alias("k"))
    each = near.join(filled, key).select(*key, "row", "distance", F.explode("win").alias("h")).groupBy(*key, "row", "distance", "h").agg(F.count(F.lit(1)).alias("c"))
    shared = each.join(small(counts, n_shingles), ["row", "h"]).groupBy(*key, "item_id", "distance").agg(F.sum(F.least("c", "k")).alias("shared"))
    scored = shared.withColumn("similarity", F.col("shared") / (F.col("w") + F.col("size") - F.col("shared"))).where(F.col("similarity") >= similarity)
    best = F.min_by(F.struct("start", "w", "similarity", "distance"), F.struct(-F.col("similarity"), "start", "distance"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", (F.col("b.w") + width - 1).alias("n_words"), F.col("b.similarity").alias("similarity"), F.col("b.distance").alias("distance"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that leak no item, with all their columns; those with a null doc_id or text stay."""
    leaks = matches(spark, docs, benchmark, **how).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["_leak"], "left_anti")
