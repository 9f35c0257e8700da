"""Connected components of a links table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (large star) or not larger (small star) neighbours on its smallest neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))  # partial minima: a hot node costs one row a task
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``links`` (u, v long) with the smallest node that it reaches.

    Nulls, loops and repeated links are dropped; nodes without a link don't appear.  Every round is a written
    table; only its row count and checksum reach the driver.
    """
    scratch = Scratch(spark, "components")
    now, before = scratch.save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    for _ in range(rounds):
        after = scratch.save(_star(_star(now, True), False))
        mark = after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        scratch.drop(now)
        now = after
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
