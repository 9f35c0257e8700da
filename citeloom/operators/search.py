"""Ranked author search."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import author_relevance, decades_since, distance_to_relevance
from .vectors import vector_search

SORTS = ("relevance_score", "citation_count", "works_count")


def rank_authors(hits: DataFrame, years: DataFrame, as_of: datetime.date, digits: int = 4) -> DataFrame:
    """Hits (author_id, author_name, num_abstracts, citation_count, distance) with a relevance score; the order is by
    score, then distance.  Hits without an author id are left out; citations may be text."""
    joined = hits.where("author_id is not null").join(years.select(F.col("author_id"), F.col("year")), "author_id", "left")
    cited = F.coalesce(F.col("citation_count").try_cast("long"), F.lit(0).cast("long"))
    score = author_relevance(distance_to_relevance(F.col("distance")), cited, decades_since(F.col("year"), as_of), digits)
    return joined.select(F.col("author_id").alias("id"), F.col("author_name").alias("name"), cited.alias("citation_count"), F.col("num_abstracts").alias("works_count"), score.alias("relevance_score"), "distance")


def ranked_order() -> list[Column]:
    return [F.desc("relevance_score"), F.asc("distance"), F.asc("id")]


def resort_authors(ranked: DataFrame, sort_by: str = "relevance_score", descending: bool = True) -> list[Column]:
    """The order asked for; null counts as 0, an unknown field leaves the ranked order."""
    if sort_by not in SORTS:
        return ranked_order()
    value = F.coalesce(F.col(sort_by), F.lit(0))
    return [value.desc() if descending else value.asc(), F.asc("distance"), F.asc("id")]


def author_search(vectors: DataFrame, query: list[float], years: DataFrame, as_of: datetime.date, limit: int = 10, offset: int = 0, sort_by: str = "relevance_score", descending: bool = True, where: str | None = None) -> DataFrame:
    """Nearest authors to a query vector, scored and ordered.  Another sort than by relevance takes the 100 nearest first."""
    fields = ["author_id", "author_name", "num_abstracts", "citation_count"]
    if sort_by == "relevance_score":
        hits = vector_search(vectors, query, limit, offset, where, fields).drop("has_more", "returned")
        return rank_authors(hits, years, as_of).orderBy(*resort_authors(hits, sort_by, descending)).drop("distance")
    hits = vector_search(vectors, query, 100, 0, where, fields).drop("has_more", "returned")
    ranked = rank_authors(hits, years, as_of)
    return ranked.orderBy(*resort_authors(ranked, sort_by, descending)).offset(offset).limit(limit).drop("distance")
