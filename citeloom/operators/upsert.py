"""Merges of new rows into tables, as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .publications import last_per_key

__all__ = ["add_column_default", "incremental_files", "last_write_wins", "merge_mentions", "metadata_repair", "new_vs_seen", "union_org_ids", "upsert_entities", "upsert_nodes", "upsert_vectors"]


def last_write_wins(df: DataFrame, *order: Column, key: str = "id") -> DataFrame:
    return last_per_key(df, key, *order)


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both by key; of a row in both, the properties that ``new`` lists and has a value for come from it."""
    o = old.select(F.col(key).alias("_k"), F.struct(*(F.col(c) for c in old.columns)).alias("o"))
    n = new.select(F.col(key).alias("_k"), F.struct(*(F.col(c) for c in new.columns)).alias("n"))
    both = o.join(n, "_k", "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in old.columns and c in new.columns else F.col(f"n.{c}" if c in new.columns else f"o.{c}")
    names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    return both.select(*(pick(c).alias(c) for c in names))


def union_org_ids(mentions: DataFrame, key: str = "id") -> DataFrame:
    """(key, org_ids): the sorted union of all mentions' ids."""
    each = mentions.select(key, F.explode_outer("org_ids").alias("o"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("o")).alias("org_ids"))


def upsert_entities(mentions: DataFrame, key: str, ts: str, fields: list[str], org_ids: str | None = None) -> DataFrame:
    """One row a key: the fields of the latest mention, the first and last time, and the union of organization ids.

    Of equal times the largest fields win.  Aggregates with partial results, so a hot key costs a row a task.
    """
    latest = F.max(F.struct(ts, *fields)).alias("m")
    extra = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(org_ids, F.array().cast("array<string>")))))).alias(org_ids)] if org_ids else []
    out = mentions.groupBy(key).agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_updated"), latest, *extra)
    return out.select(key, *(F.col(f"m.{c}").alias(c) for c in fields), "created_at", "last_updated", *([org_ids] if org_ids else []))


def merge_mentions(old: DataFrame, mentions: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """``upsert_entities`` of all that came before (key, fields, created_at, last_updated) and of new mentions.

    Least and greatest values only, so mentions may come in any order, in any batches, and again.
    """
    part = lambda df, first, last: df.select(key, F.col(first).alias("created_at"), F.struct(F.col(last).alias("last_updated"), *fields).alias("m"))
    both = part(old, "created_at", "last_updated").unionByName(part(mentions, ts, ts))
    out = both.groupBy(key).agg(F.min("created_at").alias("created_at"), F.max("m").alias("m"))
    return out.select(key, *(F.col(f"m.{c}").alias(c) for c in fields), "created_at", F.col("m.last_updated").alias("last_updated"))


def upsert_vectors(old: DataFrame, new: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(merged with a ``status`` of created, updated or kept; rejected rows of ``new``): vectors of another dimension,
    null and empty ones are rejected; missing counts are 0."""
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    good = new.where(fits).fillna({c: 0 for c in ("num_abstracts", "citation_count") if c in new.columns})
    seen = old.select(F.col("id"), F.lit(True).alias("_old"))
    come = good.select(F.col("id"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old") & F.col("_new"), "updated").when(F.col("_new"), "created").otherwise("kept")
    merged = upsert_nodes(old, good).join(seen, "id", "left").join(come, "id", "left").withColumn("status", status).drop("_old", "_new")
    return merged, new.where(~fits)


def metadata_repair(vectors: DataFrame, lookup: DataFrame) -> DataFrame:
    """Names that are still ids get the lookup's name, and no citations the lookup's; flags tell what changed."""
    k = lookup.select(F.col("id").alias("author_id"), F.col("name").alias("_name"), F.col("citation_count").alias("_cited"))
    joined = vectors.join(k, "author_id", "left")
    key = F.col("author_id").cast("string")
    name = (F.col("author_name") == key) & F.col("_name").isNotNull() & (F.col("_name") != key)
    cited = (F.coalesce("citation_count", F.lit(0)) == 0) & (F.col("_cited") > 0)
    flagged = joined.withColumn("name_fixed", F.coalesce(name, F.lit(False))).withColumn("citations_fixed", F.coalesce(cited, F.lit(False)))
    fixed = flagged.withColumn("author_name", F.when(F.col("name_fixed"), F.col("_name")).otherwise(F.col("author_name")))
    return fixed.withColumn("citation_count", F.when(F.col("citations_fixed"), F.col("_cited")).otherwise(F.col("citation_count"))).drop("_name", "_cited")


def repair_counts(repaired: DataFrame) -> DataFrame:
    return repaired.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("name_fixed")).alias("names"), F.count_if(F.col("citations_fixed")).alias("citations"))


def add_column_default(df: DataFrame, column: str = "citation_count", value: int = 0) -> DataFrame:
    """All rows, with ``column`` filled in where it is missing."""
    return df.fillna({column: value}) if column in df.columns else df.withColumn(column, F.lit(value).cast("long"))


def incremental_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths without a processed row in the manifest (path, status): new files and failed ones."""
    return files.select("path").distinct().join(manifest.where("status = 'processed'").select("path"), "path", "left_anti")


def new_vs_seen(works: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, new_authors): how many authors each work would add to those seen (id)."""
    each = works.select("id", F.explode("authors.author_id").alias("author_id")).distinct()
    fresh = each.join(seen.select(F.col("id").alias("author_id")), "author_id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("new_authors"))
    return works.select("id").join(fresh, "id", "left").select("id", F.coalesce("new_authors", F.lit(0)).cast("long").alias("new_authors"))
