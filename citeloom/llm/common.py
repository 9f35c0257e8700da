"""What the operators share: table reading, the shared scratch folder, Arrow rows."""

from __future__ import annotations

import contextlib
import os
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, so that other columns (whatever their names) neither travel nor clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see.  Only a session on one machine (tests) may leave it unset and gets a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "citeloom-checkpoints")
    return folder.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder: a written table cuts lineage and outlives a lost executor.

    They stay until somebody clears the folder, or, where they are made within ``freed``, until its end.
    """

    within: list[list[str]] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/citeloom-{what}-{uuid.uuid4().hex[:12]}", 0
        if Scratch.within:
            Scratch.within[-1].append(self.top)

    def path(self, name: str = "") -> str:
        self.n += 1
        return f"{self.top}/{name or 't'}{self.n}"

    def save(self, df: DataFrame, name: str = "") -> DataFrame:
        df.write.parquet(where := self.path(name))
        kept = self.spark.read.schema(df.schema).parquet(where)
        kept.scratch_path = where
        return kept

    def drop(self, df: DataFrame | None) -> None:
        """Frees a table that nothing reads any more."""
        if where := getattr(df, "scratch_path", None):
            remove(self.spark, where)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Frees, at its end, all scratch tables that operators make within: write what you need of their results before."""
    Scratch.within.append([])
    try:
        yield
    finally:
        for top in Scratch.within.pop():
            remove(spark, top)


def arrow_rows(fields: list[tuple[str, pa.DataType]], each: Callable[..., tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``each`` gets the values of a row's columns, and returns those of one row out."""
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # bounds what is decoded at once
                part = batch.slice(start, 512)
                rows = [each(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    return run


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes in a text column; a longer text is a slice alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = min(max(int(np.searchsorted(ends, before + size, side="right")), start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def worker_state() -> dict:
    """What a Python worker process keeps from task to task.  (Functions travel by value, so module globals don't stay.)"""
    return sys.modules.setdefault("_citeloom_worker_state", types.ModuleType("_citeloom_worker_state")).__dict__.setdefault("kept", {})


def share(spark: SparkSession, thing: object) -> Callable[[], object]:
    """Broadcasts an object by its fields, and fields of this package's classes by theirs; call to get it back.

    A broadcast, unlike a function, travels by class name, and workers needn't have the package: the classes go with
    the function that is returned.
    """
    ours = __name__.split(".")[0]
    kinds = {name: type(value) for name, value in vars(thing).items() if type(value).__module__.split(".")[0] == ours}
    kind, fields = type(thing), spark.sparkContext.broadcast({name: vars(value) if name in kinds else value for name, value in vars(thing).items()})

    def built(kind: type, values: dict) -> object:
        made = object.__new__(kind)
        vars(made).update(values)
        return made

    return lambda: built(kind, {name: built(kinds[name], value) if name in kinds else value for name, value in fields.value.items()})
