"""Tables in hash buckets of a key: a merge rewrites the buckets that it touches and no other."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files


class BucketedTable:
    """Rows of ``schema`` under ``folder``, in ``buckets`` by the hash of ``key``.

    A merge writes its buckets to a folder of its own and then a commit, a small file that names each bucket's folder;
    readers go by the last commit.  So a merge that dies leaves the table as it was, a batch that comes again after its
    commit changes nothing, and the files of untouched buckets stay what they are.  Of two writers of one batch the
    second to commit fails.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.key, self.schema, self.buckets, self.files = spark, key, schema, buckets, Files(spark, folder)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def last(self) -> tuple[int, dict]:
        """(batch, commit) of the last commit; batch -1 where there is none."""
        names = [n for n, _ in self.files.names("_commits") if n.endswith(".json")]
        if not names:
            return -1, {"buckets": {}, "totals": {}}
        return int(names[-1][:-5]), json.loads(self.files.text(f"_commits/{names[-1]}"))

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, as of the last commit."""
        placed = self.last()[1]["buckets"]
        folders = [f"{self.files.folder}/{where}" for b, where in sorted(placed.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def totals(self) -> dict[str, int]:
        return self.last()[1]["totals"]

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: int, counts: dict[str, int] | None = None) -> bool:
        """Replaces the touched buckets by ``how(their rows, new)`` and adds ``counts`` to the totals; False if ``batch``
        or a later one has been committed."""
        before, commit = self.last()
        if batch <= before:
            return False
        new = new.persist()
        try:
            touched = sorted(r[0] for r in new.select(self.bucket().alias("b")).distinct().collect())  # a number a bucket
            where = f"data/{batch}-{uuid.uuid4().hex[:8]}"
            if touched:
                merged = how(self.read(touched), new).withColumn("bucket", self.bucket())
                names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
                merged.select(*names, "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.files.folder}/{where}")
        finally:
            new.unpersist()
        written = {name.split("=")[1]: f"{where}/{name}" for name, _ in self.files.names(where) if name.startswith("bucket=")}
        placed = {b: x for b, x in commit["buckets"].items() if int(b) not in touched} | written
        totals = {k: commit["totals"].get(k, 0) + (counts or {}).get(k, 0) for k in {*commit["totals"], *(counts or {})}}
        self.files.put(f"_commits/{batch:020d}.json", json.dumps({"buckets": placed, "totals": totals}))
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Drops commits before the last ``keep`` and the folders that only they, or merges that died, had."""
        names = [n for n, _ in self.files.names("_commits") if n.endswith(".json")]
        used = {x.rsplit("/", 1)[0] for n in names[-keep:] for x in json.loads(self.files.text(f"_commits/{n}"))["buckets"].values()}
        for n in names[:-keep]:
            self.files.drop(f"_commits/{n}")
        for n, _ in self.files.names("data"):
            if f"data/{n}" not in used:
                self.files.drop(f"data/{n}")
