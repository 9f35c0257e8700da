"""Predicates on entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nonblank_abstracts(works: DataFrame) -> DataFrame:
    trimmed = F.trim("abstract")
    return works.where(F.coalesce(trimmed, F.lit("")) != "").withColumn("abstract", trimmed)


def filter_expr(df: DataFrame, expression: str | None) -> DataFrame:
    return df.where(F.expr(expression)) if expression else df


def min_works_citations(authors: DataFrame, works: int = 0, citations: int = 0) -> DataFrame:
    return authors.where((F.coalesce("works_count", F.lit(0)) >= works) & (F.coalesce("citation_count", F.lit(0)) >= citations))


def filter_graph_view(nodes: DataFrame, root: int | str, year: str | None = None, org: str | None = None) -> DataFrame:
    """Hides works of other years and organizations of other labels; the root and other nodes stay."""
    keep = F.lit(True)
    if year is not None:
        keep = keep & ((F.col("group") != "work") | (F.col("year") == year))
    if org is not None:
        keep = keep & ((F.col("group") != "organization") | (F.col("label") == org))
    return nodes.where((F.col("id") == root) | keep)


def filter_entities(df: DataFrame, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Equality filters by column; ``year_from``, ``year_to`` and ``min_citations`` are ranges.  Limits go by id."""
    for name, value in equal.items():
        if value is None:
            continue
        if name == "year_from":
            df = df.where(F.col("year") >= value)
        elif name == "year_to":
            df = df.where(F.col("year") <= value)
        elif name == "min_citations":
            df = df.where(F.col("citation_count") >= value)
        else:
            df = df.where(F.col(name) == value)
    return df.orderBy("id").offset(offset).limit(limit) if limit is not None else df


def works_by_author(works: DataFrame, author_id) -> DataFrame:
    return works.where(F.exists("authors", lambda a: a["author_id"] == F.lit(author_id)))


def works_by_topic(works: DataFrame, topic_id) -> DataFrame:
    return works.where(F.exists("topics", lambda t: t["topic_id"] == F.lit(topic_id)))


def authors_by_org(authors: DataFrame, org_id) -> DataFrame:
    return authors.where(F.array_contains("org_ids", F.lit(org_id)))


def works_funded_by(works: DataFrame, org_id) -> DataFrame:
    return works.where(F.exists("orgs", lambda o: (o["org_id"] == F.lit(org_id)) & (o["role"] == "funder")))


def high_relevance_topics(works: DataFrame, least: float = 0.8) -> DataFrame:
    each = works.select(F.col("id").alias("work_id"), F.explode("topics").alias("t")).select("work_id", "t.topic_id", "t.score")
    return each.where(F.col("score") > least).orderBy(F.desc("score"), "work_id", "topic_id")


def entity_by_id(df: DataFrame, key) -> DataFrame:
    return df.where(F.col("id") == F.lit(key))


def work_flags(works: DataFrame) -> DataFrame:
    from ..functions.scalars import parse_year

    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    def count(c: str, key: str) -> F.Column:
        """Different ids that aren't empty."""
        ids = F.filter(F.transform(c, lambda x: x[key]), lambda i: F.coalesce(F.trim(i.cast("string")), F.lit("")) != "")
        return F.coalesce(F.array_size(F.array_distinct(ids)), F.lit(0))

    return works.select(
        "id", filled("abstract").alias("has_abstract"), filled("doi").alias("has_doi"), (count("authors", "author_id") > 0).alias("has_authors"), (count("topics", "topic_id") > 0).alias("has_topics"), (count("orgs", "org_id") > 0).alias("has_orgs"),
        F.coalesce(F.exists("authors", lambda a: F.coalesce(F.trim(a["org_id"].cast("string")), F.lit("")) == ""), F.lit(False)).alias("has_author_missing_org"),
        count("authors", "author_id").cast("long").alias("num_authors"), parse_year(F.col("publication_date")).alias("year"),
    )
