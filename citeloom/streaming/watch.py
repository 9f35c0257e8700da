"""Directories that grow: publications are cleaned and merged as their files come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import merge_mentions
from ..schemas import PUBLICATION
from ..sources.buckets import BucketedTable


def publication_stream(spark: SparkSession, folder: str, schema: str = PUBLICATION, per_batch: int | None = None, multi_line: bool = True) -> DataFrame:
    """The JSON files of a folder as they come: a document a file, or a line with ``multi_line=False``."""
    reader = spark.readStream.schema(f"{schema}, _corrupt string").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json")
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).json(folder)


def watch_publications(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Calls ``merge`` with each new batch of files, once a file, across restarts; ``once`` stops when none is left."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def merging(table: BucketedTable, ts: str, fields: list[str]) -> Callable[[DataFrame, int], None]:
    """What ``watch_publications`` calls to upsert its batches into a table (key, fields, created_at, last_updated).

    A batch that comes again after a restart is applied once: its number is that of the table's commit.  Documents that
    couldn't be parsed, or lack a key or time, are left out; the table's totals count ``processed`` and ``failed``.
    """
    key = table.key

    def merge(batch: DataFrame, number: int) -> None:
        bad = F.col(key).isNull() | F.col(ts).isNull()
        if "_corrupt" in batch.columns:
            bad = bad | F.col("_corrupt").isNotNull()
        batch = batch.persist()
        try:
            failed, processed = batch.agg(F.count_if(bad), F.count_if(~bad)).first()
            mentions = batch.where(~bad).select(key, ts, *fields)
            table.merge(mentions, lambda old, new: merge_mentions(old, new, key, ts, fields), number, {"processed": processed, "failed": failed})
        finally:
            batch.unpersist()

    return merge


def stream_upsert(stream: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """The latest fields, first and last time of each key, kept up to date (output mode update or complete).

    State is a row a key; for keys without bound, ``watch_publications`` with ``merging`` keeps none and merges each batch
    into a bucketed table.
    """
    latest = F.max(F.struct(ts, *fields)).alias("m")
    return stream.groupBy(key).agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_updated"), latest).select(key, *(F.col(f"m.{c}").alias(c) for c in fields), "created_at", "last_updated")


def stream_load_stats(stream: DataFrame) -> DataFrame:
    """(status, n): running counts of parsed and failed documents."""
    return stream.groupBy(F.when(F.col("_corrupt").isNull(), "processed").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def run_once(df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over what is there now, and reads its last state from ``folder``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out")
