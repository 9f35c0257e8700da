"""A manifest of input files: what was tried, what succeeded, what is to be tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from .upsert import incremental_files

SCHEMA = "path string, status string, attempt long, reason string"


class Manifest:
    """Records (path, status, attempt, reason) under a folder, only ever appended: ``started`` before an attempt,
    ``processed`` or ``failed`` after it.  A file whose attempt died has a ``started`` record alone and is tried again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def records(self) -> DataFrame:
        there = any(name.endswith(".parquet") for name, _ in Files(self.spark, self.folder).names())
        return self.spark.read.schema(SCHEMA).parquet(self.folder) if there else self.spark.createDataFrame([], SCHEMA)

    def append(self, rows: DataFrame, attempt: int) -> None:
        """rows: (path, status, reason)."""
        rows.select("path", "status", F.lit(attempt).cast("long").alias("attempt"), "reason").write.mode("append").parquet(self.folder)

    def state(self) -> DataFrame:
        """(path, status, attempts, reason), one row a file: ``processed`` once it ever was, else ``failed`` if its last
        attempt said so, else ``started``."""
        order = F.struct(F.col("status") == "processed", "attempt", F.col("status") != "started")
        each = self.records().groupBy("path").agg(F.max_by(F.struct("status", "reason"), order).alias("m"), F.count_distinct("attempt").alias("attempts"))
        return each.select("path", "m.status", "attempts", "m.reason")

    def run(self, files: DataFrame, process: Callable[[DataFrame, int], DataFrame], limit: int | None = None) -> dict[str, int]:
        """Processes the files (path) without a processed record, ``limit`` of them at most, the first by path.

        ``process(todo, attempt)`` writes its output, in a way that may be repeated, and returns (path, ok, reason); files
        that it doesn't return have failed.  Returns how many were processed, failed and skipped.
        """
        records = self.records()
        todo = incremental_files(files, records)
        skipped = files.select("path").distinct().count() - todo.count()
        todo = todo.orderBy("path").limit(limit) if limit is not None else todo
        attempt = 1 + (records.agg(F.max("attempt")).first()[0] or 0)
        self.append(todo.select("path", F.lit("started").alias("status"), F.lit(None).cast("string").alias("reason")), attempt)
        mine = self.records().where((F.col("attempt") == attempt) & (F.col("status") == "started")).select("path")  # as recorded, not as recomputed
        outcome = mine.join(process(mine, attempt).groupBy("path").agg(F.bool_and("ok").alias("ok"), F.max("reason").alias("reason")), "path", "left")
        ok = F.coalesce("ok", F.lit(False))
        self.append(outcome.select("path", F.when(ok, "processed").otherwise("failed").alias("status"), F.when(~ok, F.coalesce("reason", F.lit("no outcome"))).alias("reason")), attempt)
        done = self.records().where(F.col("attempt") == attempt).groupBy("status").count().collect()
        counts = {r["status"]: r["count"] for r in done}
        return {"processed": counts.get("processed", 0), "failed": counts.get("failed", 0), "skipped": skipped}
