"""Hard negatives of anchors, by disjoint score slots.

An anchor's positives have scores P1 >= P2 >= ...; positive i wants the best negatives of the window [0.8 Pi, Pi].  The
windows overlap, but their upper limits cut the scores into disjoint slots (Pj+1, Pj], and a window is the slots from its
own limit downwards, cut at its lower limit.  So every task keeps the best k negatives of each slot (a combiner), those
meet by slot, and each window takes the first k of its slots in descending order: one pass answers all windows.

Rows meet a block of anchors of bounded bytes at a time, which is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of the anchors' vectors that are sent to every task at once; cells of scores that a task holds.
BLOCK_BYTES, CELLS = 32 << 20, 1 << 21
#: Stands for a missing vec_id, which comes last among ties.
NO_ID = (1 << 63) - 1
#: Scores stay below this, so that 100 times one is a 64-bit integer.
MOST = (1 << 63) // 128


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v array<long>): the rows that take part; v is floor(256 x) of each component."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = rows.select("vec_id", "label", "embedding").where(F.col("label").isNotNull() & finite)
    return kept.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda e: F.floor(e.cast("double") * 256)).alias("v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A list column as an int64 matrix of ``width`` columns at least; shorter vectors end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, width = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as int64, exact: by floats where 53 bits hold them."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = width * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= MOST:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return a @ b.T


class Anchors:
    """A block of anchors and, of each, its slots: bounds lo and hi of column j; a slot without room has lo > hi."""

    def __init__(self, key: np.ndarray, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool):
        self.key, self.vec_id, self.label, self.v, self.lo, self.hi, self.same = key, vec_id, label, v, lo, hi, same

    def best(self, batches: Iterator[pa.RecordBatch], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot number, score, vec_id) of the best k rows of each slot; ties by the smaller vec_id.

        Rows of the anchor's label (``same``) or of others only; a row with the anchor's vec_id is never its own.
        """
        slots = self.lo.shape[1]
        floor = self.lo.copy()  # rises to the score of a slot's k-th row
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            step = max(1, min(batch.num_rows, 4096))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids, labels, x = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), 0)
                found = [held]
                tile = max(1, CELLS // step)
                for a in range(0, len(self.key), tile):
                    one = slice(a, a + tile)
                    score = products(self.v[one], x)
                    fits = (self.label[one, None] == labels) == self.same
                    fits &= self.vec_id[one, None] != ids
                    for j in range(slots):
                        i, r = np.nonzero(fits & (score >= floor[one, j, None]) & (score <= self.hi[one, j, None]))
                        found.append([(i + a) * slots + j, score[i, r], ids[r]])
                held = [np.concatenate(c) for c in zip(*found)]
                order = np.lexsort((held[2], -held[1], held[0]))
                held = [c[order] for c in held]
                first = np.searchsorted(held[0], held[0])
                place = np.arange(len(first)) - first
                last = place == k - 1
                floor.reshape(-1)[held[0][last]] = held[1][last]
                held = [c[place < k] for c in held]
        return tuple(held)


def _scan(rows: DataFrame, blocks: list[DataFrame], k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, vec_id): of every task, the best k rows of each slot of the blocks' anchors."""
    out = None
    for block in blocks:
        got = block.toArrow().combine_chunks()  # BLOCK_BYTES at most
        column = lambda name: got.column(name).combine_chunks()
        bounds = [matrix(column(c), 1) for c in ("lo", "hi")]
        anchors = Anchors(*(column(c).to_numpy() for c in ("anchor", "vec_id", "label")), matrix(column("v"), 0), *bounds, same)
        shared = common.share(rows.sparkSession, anchors)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            anchors = shared()
            slot, score, ids = anchors.best(batches, k)
            n = anchors.lo.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(anchors.key[slot // n]), pa.array((slot % n).astype(np.int32)), pa.array(score), pa.array(ids)], ["anchor", "slot", "score", "vec_id"])

        found = rows.mapInArrow(run, "anchor long, slot int, score long, vec_id long")
        out = found if out is None else out.unionByName(found)
    return out


def mine(spark: SparkSession, rows: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, low: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each anchor (rows for which ``anchor`` holds) the best ``positives`` other rows of its label and, of each of those,
    the best ``negatives`` rows of other labels whose score is at most the positive's and at least ``low`` hundredths of
    it.  Null labels and vectors, and vectors with a null or non-finite component, take no part; a missing vec_id counts
    as the largest.  "Other" goes by vec_id: rows with the anchor's vec_id are never its positives or negatives.
    Repeated rows count each, and repeated anchors are answered each; a vector that is shorter than another ends in
    zeros, an empty one scores 0.  An anchor without positives, or a window without rows, gives no row.
    """
    scratch = common.Scratch(spark, "negatives")
    vectors = scratch.save(usable(rows))
    anchors = scratch.save(vectors.where(F.expr(anchor)).withColumn("anchor", F.monotonically_increasing_id()))
    n, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    deals = max(1, -(-n * 8 * max(1, width) * 5 // (4 * block_bytes)))  # room for uneven blocks

    def blocks(table: DataFrame) -> list[DataFrame]:
        return [table.where(F.pmod(F.xxhash64("anchor"), F.lit(deals)) == b) for b in range(deals)]

    whole = anchors.withColumns({"lo": F.array(F.lit(-MOST)), "hi": F.array(F.lit(MOST))})
    best = lambda keys, k: Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    near = _scan(vectors, blocks(whole), positives, True).withColumn("p", F.row_number().over(best(["anchor"], positives)) - 1).where(F.col("p") < positives)
    chosen = scratch.save(near.select("anchor", "p", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # slots: column j is the scores over the next positive's and up to positive j's, and no lower than its window
    limits = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "positive_score"))), lambda x: x["positive_score"]).alias("hi"))
    ceiling = lambda s: F.call_function("div", s * low + F.pmod(-s * low, F.lit(100)), F.lit(100))  # noqa: E731  of low hundredths
    lows = F.transform("hi", lambda s, j: F.greatest(F.coalesce(F.get("hi", j + 1) + 1, F.lit(-MOST)), ceiling(s)))
    fill = lambda c, value: F.slice(F.concat(c, F.array_repeat(F.lit(value), positives)), 1, positives)
    slotted = anchors.join(limits.select("anchor", fill(lows, MOST).alias("lo"), fill(F.col("hi"), -MOST).alias("hi")), "anchor")
    tops = _scan(vectors, blocks(scratch.save(slotted)), negatives, False)
    tops = tops.withColumn("r", F.row_number().over(best(["anchor", "slot"], negatives))).where(F.col("r") <= negatives)
    merged = tops.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "r", "score", "vec_id"))).alias("tops"))  # positives x negatives entries at most

    first = F.slice(F.filter("tops", lambda t: t["slot"] >= F.col("p")), 1, negatives)  # the suffix of slots, best first
    windows = chosen.join(merged, "anchor").select("anchor", "positive_id", "positive_score", F.posexplode(F.filter(first, lambda t: t["score"] * 100 >= F.col("positive_score") * low)).alias("i", "t"))
    named = windows.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    back = lambda c: F.nullif(c, F.lit(NO_ID))
    return named.select(
        "anchor_id", back(F.col("positive_id")).alias("positive_id"), (F.col("i") + 1).alias("rank"), back(F.col("t.vec_id")).alias("negative_id"), "positive_score", F.col("t.score").alias("negative_score")
    )


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 5
"""
