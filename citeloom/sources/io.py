"""Readers and writers of entity shards, publications and exports."""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ENTITIES, PUBLICATION
from .files import Files

#: Names of the shards of an entity.
SHARDS, SHARD = "dtic_{entity}_*.jsonl.gz", "dtic_{entity}_{number}.jsonl.gz"
#: Rows of the sample that tells how many bytes a row takes.
SAMPLE = 20_000


def _found(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    matched = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return matched is not None and len(matched) > 0


def read_entity_shards(spark: SparkSession, folder: str, entity: str, strict: bool = False) -> DataFrame:
    """All ``SHARDS`` of an entity in a folder.  Blank lines, bad lines and unreadable files are skipped, unless
    ``strict``; no file: an empty table."""
    glob, schema = f"{folder}/{SHARDS.format(entity=entity)}", ENTITIES[entity]
    if not _found(spark, glob):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if strict:
        return reader.option("mode", "FAILFAST").json(glob)
    return reader.option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(glob)


def read_publications(spark: SparkSession, prefix: str, names: str = "*.json") -> DataFrame:
    """One publication a file; ``_corrupt`` holds what could not be parsed, and ``path`` the file."""
    reader = spark.read.schema(f"{PUBLICATION}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("pathGlobFilter", names).option("recursiveFileLookup", True).json(prefix).withColumn("path", F.col("_metadata.file_path"))


def load_stats(publications: DataFrame) -> DataFrame:
    return publications.agg(F.count_if(F.col("_corrupt").isNull()).alias("processed"), F.count_if(F.col("_corrupt").isNotNull()).alias("failed"))


def packed_row_bytes(df: DataFrame, staging: str, sample: int = SAMPLE) -> tuple[float, int]:
    """(compressed bytes a row, rows): measured on a written sample of at most about ``sample`` rows, in order of id."""
    n = df.count()
    if not n:
        return 0.0, 0
    spark, share = df.sparkSession, min(1.0, sample / n)
    rows = df.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003) if share < 1 else df
    rows.coalesce(1).sortWithinPartitions("id").write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", True).json(f"{staging}/sample")
    size = sum(b for name, b in Files(spark, f"{staging}/sample").names() if name.startswith("part-"))
    kept = spark.read.schema("id string").json(f"{staging}/sample").count()
    Files(spark, staging).drop("sample")
    return (size / kept if kept else 100.0), n


def write_entity_shards(df: DataFrame, folder: str, entity: str, target_bytes: int = 50 << 20) -> list[str]:
    """Writes an entity's rows as ``SHARDS`` of about ``target_bytes`` compressed, in order of id over all; returns their names.

    How many shards it takes follows from a written sample.  They are written aside and then named, in place of the
    entity's shards of before; whoever reads during the naming may see some of both.  No rows: no shards.
    """
    spark, files = df.sparkSession, Files(df.sparkSession, folder)
    aside = f"_{entity}_{uuid.uuid4().hex[:8]}"
    each, n = packed_row_bytes(df, f"{folder}/{aside}")
    shards = max(1, round(each * n / target_bytes))
    if n:
        spread = df.repartitionByRange(shards, "id").sortWithinPartitions("id")
        spread.write.option("compression", "gzip").option("ignoreNullFields", True).json(f"{folder}/{aside}/rows")
    return name_shards(files, f"{aside}/rows", entity, aside)


def name_shards(files: Files, written: str, entity: str, aside: str) -> list[str]:
    """Gives the written parts, in their order, the names of an entity's shards, and drops the folder aside."""
    before = [name for name, _ in files.names() if fnmatch.fnmatch(name, SHARDS.format(entity=entity))]
    parts = [name for name, _ in files.names(written) if name.startswith("part-")]
    width = max(3, len(str(len(parts))))
    named = [SHARD.format(entity=entity, number=str(i).zfill(width)) for i in range(1, len(parts) + 1)]
    for name in before:
        files.drop(name)
    for part, name in zip(parts, named):
        files.move(f"{written}/{part}", name)
    files.drop(aside)
    return named


def shard_stats(df: DataFrame, entity: Column) -> DataFrame:
    """Rows, files, bytes and the mean size of a file, by entity, of a table read from files."""
    files = df.select(entity.alias("entity"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    each = files.groupBy("entity", "file").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))
    return each.groupBy("entity").agg(F.sum("rows").alias("rows"), F.count("file").alias("files"), F.sum("bytes").alias("bytes"), F.avg("bytes").alias("mean_bytes"))


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, keys in alphabetical order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_sorted_jsonl(df: DataFrame, folder: str) -> None:
    sorted_json(df).write.text(folder)


CSV_COLUMNS = ("publication_id", "title", "abstract", "publication_date", "url", "doi", "document_type", "citations_count", "authors", "organizations", "keywords")


def csv_rows(publications: DataFrame) -> DataFrame:
    """Eleven text columns: lists joined with ``; ``, nothing where a value is missing."""
    names = lambda c: F.concat_ws("; ", F.transform(c, lambda x: x["name"])).alias(c)
    lists = {"authors": names("authors"), "organizations": names("organizations"), "keywords": F.concat_ws("; ", "keywords").alias("keywords")}
    return publications.select(*(lists.get(c, F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)) for c in CSV_COLUMNS))


def export_publications_csv(publications: DataFrame, folder: str) -> None:
    csv_rows(publications).write.option("header", True).option("escape", '"').csv(folder)


def graph_pieces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, piece): a document ``{"root", "nodes", "edges"}`` of each root of ``nodes``, as pieces in order.

    Rows are sorted by root within partitions and turned into text one after another: a root may have any number of
    edges, as no list of them is made.  Edges of a root without nodes are left out.
    """
    item = lambda df: F.to_json(F.struct(*(c for c in df.columns if c != "root")))
    rows = nodes.select("root", F.lit(0).alias("part"), item(nodes).alias("text"))
    rows = rows.unionByName(edges.select("root", F.lit(1).alias("part"), item(edges).alias("text")))
    key = nodes.schema["root"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 1
        for batch in batches:
            roots, out = [], []
            for root, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part and (at is None or root != at[0]):
                    continue  # a root without nodes, as those come first
                if at is None or root != at[0]:
                    if at is not None:
                        roots.append(at[0])
                        out.append("]}" if last else '], "edges": []}')
                    at, last, before = (root,), 0, f'{{"root": {json.dumps(root)}, "nodes": ['
                elif part != last:
                    last, before = 1, '], "edges": ['
                else:
                    before = ","
                roots.append(root)
                out.append(before + text)
            yield pa.RecordBatch.from_arrays([pa.array(roots, batch.schema.field(0).type), pa.array(out, pa.string())], ["root", "piece"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], batch.schema.field(0).type), pa.array(["]}" if last else '], "edges": []}'])], ["root", "piece"])

    return rows.repartition("root").sortWithinPartitions("root", "part", "text").mapInArrow(pieces, f"root {key}, piece string")


def export_graph_json(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Text files of whole documents, one after another, each over as many lines as it has nodes and edges."""
    graph_pieces(nodes, edges).select("piece").write.text(folder)


def load_guard(target: DataFrame, threshold: int = 100, force: bool = False) -> bool:
    """Whether a load is to be skipped, as the target holds ``threshold`` rows or more."""
    return not force and target.limit(threshold).count() >= threshold


def limit_per_file(df: DataFrame, n: int, order: str, file: Column | None = None) -> DataFrame:
    """At most ``n`` records of each input file, the first in ``order``."""
    file = F.col("_metadata.file_path") if file is None else file
    rows = df.withColumn("_file", file)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_file").orderBy(order))).where(F.col("_r") <= n).drop("_r", "_file")
