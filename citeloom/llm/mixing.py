"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k being Poisson distributed with its source's repetition rate, found by inverting
the distribution function at a point in [0, 1) hashed from the document and a seed; so the same document gets the same
k in every run, and expected amounts meet the targets.  Copies are then ordered by another hash, over all partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SEED = 20240607
#: The table of sources is broadcast up to so many rows; beyond, Spark joins by shuffle and splits hot sources.
FEW_SOURCES = 5_000


def point(*parts) -> F.Column:
    """A point in [0, 1), in steps of 2^-52, from the MD5 of the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts)).cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def source_rates(docs: DataFrame, targets: DataFrame | None = None, smoothing: float = 0.7, volume: float = 1.0) -> DataFrame:
    """(source, n_chars, rate): how often each source's documents are to be repeated on average.

    ``targets`` (source, weight) gives the weights; without it, a source's weight is its amount of text to the power
    ``smoothing``, which lifts small sources.  The mixture holds ``volume`` times the corpus's code points in all.
    Sources that targets lack, or with a negative or null weight, get rate 0; weights of sources without
    documents don't count.  Null is a source like others.
    """
    amount = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    if targets is None:
        weighted = amount.withColumn("weight", F.pow(F.col("n_chars").cast("double"), F.lit(smoothing)))
    else:
        given = targets.groupBy(F.col("source").alias("_s")).agg(F.greatest(F.sum(F.col("weight").cast("double")), F.lit(0.0)).alias("weight"))
        weighted = amount.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("n_chars").alias("all_chars"))
    share = F.when((F.col("all_weight") > 0) & (F.col("n_chars") > 0), F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return weighted.join(F.broadcast(total)).select("source", "n_chars", F.coalesce(share * volume * F.col("all_chars") / F.nullif(F.col("n_chars"), F.lit(0)), F.lit(0.0)).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, rate, steps): the values of the distribution function at 0, 1, 2, ... until what is left is below 2^-52."""
    most = F.when(F.col("rate") > 0, F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 25)).otherwise(0).cast("int")
    each = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_step = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln("rate") - F.ln(F.greatest("k", F.lit(1))))
    logs = each.withColumn("log_p", F.sum(log_step).over(up_to))
    sums = logs.withColumn("cdf", F.sum(F.exp("log_p")).over(up_to))
    return sums.groupBy("source").agg(F.first("rate").alias("rate"), F.array_sort(F.collect_list("cdf")).alias("steps"))


def replicate(docs: DataFrame, targets: DataFrame | None = None, smoothing: float = 0.7, volume: float = 1.0, seed: int = SEED) -> DataFrame:
    """(row, copy, n_copies, place): each document as often as its count says; ``row`` holds its columns, under any names.

    Rows that repeat a doc_id get the same count.  Empty and null texts count no code points but are repeated like the
    rest of their source.  ``place`` is the hash that ``shuffle`` orders by.  The table of sources is
    written and counted first, and broadcast only if it is small.
    """
    rates = Scratch(docs.sparkSession, "mixing").save(source_rates(docs, targets, smoothing, volume))
    steps = poisson_steps(rates).withColumnRenamed("source", "_source")
    largest = rates.agg(F.count(F.lit(1)), F.max("rate")).first()
    if largest[0] * ((largest[1] or 0) + 100) <= 100 * FEW_SOURCES:
        steps = F.broadcast(steps)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    placed = rows.join(steps, F.col("row.source").eqNullSafe(F.col("_source")))
    u = point(F.lit(seed), F.col("row.doc_id"))
    counted = placed.withColumn("n_copies", F.when(F.col("rate") > 0, F.size(F.filter("steps", lambda c: c <= u))).otherwise(0))
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return copies.select("row", "copy", "n_copies", point(F.lit(seed + 1), F.col("row.doc_id"), F.col("copy")).alias("place"))


def shuffle(copies: DataFrame) -> DataFrame:
    """Copies, with all that they hold, in the order of ``place`` over all partitions (a range partitioning and a sort inside)."""
    return copies.orderBy("place", "row.doc_id", "copy")


def mix(docs: DataFrame, targets: DataFrame | None = None, **how) -> DataFrame:
    """The replicated and shuffled documents with the columns of ``docs`` alone."""
    return shuffle(replicate(docs, targets, **how)).select("row.*")


ORACLE = f"""
WITH amount AS (SELECT source, sum(coalesce(length(text), 0)) AS n_chars FROM documents GROUP BY source),
weighted AS (SELECT source, n_chars, pow(CAST(n_chars AS DOUBLE), 0.7) AS weight FROM amount),
rates AS (
  SELECT source, CASE WHEN n_chars > 0 THEN weight / (SELECT sum(weight) FROM weighted) * 1.0 * (SELECT CAST(sum(n_chars) AS DOUBLE) FROM weighted) / n_chars ELSE 0.0 END AS rate
  FROM weighted),
each AS (SELECT source, rate, unnest(generate_series(0, CASE WHEN rate > 0 THEN CAST(ceil(rate + 10 * sqrt(rate) + 25) AS INT) ELSE 0 END)) AS k FROM rates),
logs AS (
  SELECT source, rate, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(greatest(k, 1)) END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS log_p
  FROM each WHERE rate > 0),
steps AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM logs),
points AS (SELECT doc_id, source, text, ('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT p.doc_id, p.source, p.text, count(*) AS n_copies FROM points p JOIN steps s ON p.source IS NOT DISTINCT FROM s.source AND s.cdf <= p.u GROUP BY p.doc_id, p.source, p.text),
copies AS (SELECT doc_id, source, text, n_copies, unnest(generate_series(1, n_copies)) AS copy FROM counted)
SELECT doc_id, source, text, CAST(copy AS INT) AS copy, CAST(n_copies AS INT) AS n_copies,
  round(('0x' || substr(md5('{SEED + 1}|' || doc_id || '|' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE, 12) AS place
FROM copies
"""
