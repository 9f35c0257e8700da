"""Raw page documents to publication records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import grid_id, normalize_pub_date, truthy

_AFFILIATION = "struct<name: string, id: string, grid_id: string, url: string, href: string, link: string, country: string, navigation: map<string, string>>"
_AUTHOR = f"struct<first_name: string, last_name: string, researcher_id: string, orcid: array<string>, affiliations: array<{_AFFILIATION}>>"
_HEADER = "struct<data: struct<title: string, pub_class: string, pub_class_id: string, metadata: struct<data: struct<pub_date: string>>>>"
_ENTITY = "struct<key: string, navigation: struct<json: string>>"
#: What is read of a page's structure.
PAGE = (
    f"page_structure struct<`publication-header`: {_HEADER}, abstract: struct<data: struct<abstract: string>>, `custom-meta`: struct<data: struct<doi: string>>, "
    f"authors: struct<data: struct<affiliations_details: array<{_AUTHOR}>>>>, entities array<{_ENTITY}>"
)


def author_records(details: Column) -> Column:
    """Authors with a name: researcher id or first ORCID, affiliation names and details, organization ids in first-seen order."""

    def one(a: Column) -> Column:
        named = F.filter(a["affiliations"], lambda x: truthy(x["name"]).isNotNull())
        return F.struct(
            F.trim(F.concat_ws(" ", F.coalesce(a["first_name"], F.lit("")), F.coalesce(a["last_name"], F.lit("")))).alias("name"),
            F.coalesce(truthy(a["researcher_id"]), F.get(a["orcid"], 0)).alias("researcher_id"),
            F.transform(named, lambda x: x["name"]).alias("affiliations"),
            F.array_distinct(F.filter(F.transform(a["affiliations"], grid_id), lambda g: g.isNotNull())).alias("org_ids"),
            F.transform(named, lambda x: F.struct(x["name"].alias("name"), grid_id(x).alias("org_id"), x["country"].alias("country"))).alias("affiliation_details"),
        )

    return F.filter(F.transform(details, one), lambda a: a["name"] != "")


def organization_records(details: Column) -> Column:
    """Organizations of a document, the first of each: by GRID id, or by lower-case name where there is none."""
    named = F.filter(F.flatten(F.transform(details, lambda a: F.coalesce(a["affiliations"], F.array()))), lambda x: truthy(x["name"]).isNotNull())
    each = F.transform(named, lambda x: F.struct(x["name"].alias("name"), grid_id(x).alias("org_id"), x["country"].alias("country"), F.lit(None).cast("string").alias("type")))
    key = lambda o: F.coalesce(o["org_id"], F.lower(o["name"]))
    return F.transform(F.array_distinct(F.transform(each, key)), lambda k: F.filter(each, lambda o: key(o) == k)[0])


def fields_of_research_path(entities: Column) -> Column:
    """The JSON path of the first entity of key ``categories-for``, null included."""
    return F.get(F.filter(entities, lambda e: e["key"] == "categories-for"), 0)["navigation"]["json"]


def extract_publications(pages: DataFrame) -> DataFrame:
    """(publication_id, url, json text) to publication records."""
    s = F.col("page.page_structure")
    header = s["publication-header"]["data"]
    details = F.coalesce(s["authors"]["data"]["affiliations_details"], F.array())
    parsed = pages.withColumn("page", F.from_json("json", PAGE, {"mode": "PERMISSIVE"}))
    return parsed.select(
        "publication_id", F.coalesce(truthy(header["title"]), F.lit("Unknown Title")).alias("title"), s["abstract"]["data"]["abstract"].alias("abstract"), "url",
        normalize_pub_date(header["metadata"]["data"]["pub_date"]).alias("publication_date"), s["custom-meta"]["data"]["doi"].alias("doi"),
        F.coalesce(truthy(header["pub_class"]), header["pub_class_id"]).alias("document_type"), F.lit(0).cast("long").alias("citations_count"),
        author_records(details).alias("authors"), organization_records(details).alias("organizations"), fields_of_research_path(F.col("page.entities")).alias("fields_path"),
    )


def publication_links(links: DataFrame) -> DataFrame:
    """(pos, href) to the distinct links to publications in first-seen order."""
    return links.where(F.col("href").contains("/publication/")).groupBy("href").agg(F.min("pos").alias("pos"))


def payload_keywords(payload: Column) -> Column:
    """A fetched payload as a list: itself, or the first of its known members (one value: a list of it), or itself as one."""
    kind = F.json_object_keys(payload)
    member = F.coalesce(*(truthy(F.get_json_object(payload, f"$.{k}")) for k in ("keywords", "fields", "subjects", "for", "data")), F.when(kind.isNotNull(), payload), payload)
    return F.coalesce(F.from_json(F.when(member.startswith("["), member), "array<string>"), F.array(member))


def amplify_keywords(publications: DataFrame, payloads: DataFrame, run_ts: Column) -> DataFrame:
    """Replaces each URL keyword by its fetched list (``payloads``: url, payload), in place; others stay.

    Adds keywords_amplified (whether anything was fetched), keywords_urls and keywords_amplified_at.  Rows that repeat a
    publication_id each keep their own keywords; of repeated payloads of a URL the smallest is used.
    """
    is_url = lambda k: k.startswith("/") | k.startswith("http")
    asked = publications.select(F.explode(F.filter("keywords", is_url)).alias("url")).distinct()
    fetched = payloads.where("payload is not null").groupBy("url").agg(F.min("payload").alias("payload"))
    parts = asked.join(fetched, "url").select("url", payload_keywords(F.col("payload")).alias("parts"))

    keyed = publications.withColumn("_row", F.xxhash64(F.to_json(F.struct(*publications.columns))))  # equal rows want equal lists
    wanted = keyed.select("_row", F.explode(F.array_distinct(F.filter("keywords", is_url))).alias("url")).distinct().join(parts, "url")
    lists = wanted.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("url", "parts"))).alias("_lists"))
    joined = keyed.join(lists, "_row", "left")
    hit = F.coalesce(F.exists("keywords", lambda k: is_url(k) & F.try_element_at("_lists", k).isNotNull()), F.lit(False))
    of = lambda k: F.coalesce(F.try_element_at("_lists", k), F.array(k))
    return joined.withColumns({
        "keywords_urls": F.when(hit, F.filter("keywords", is_url)), "keywords_amplified": hit, "keywords_amplified_at": F.when(hit, run_ts),
        "keywords": F.when(hit, F.flatten(F.transform("keywords", of))).otherwise(F.col("keywords")),
    }).drop("_row", "_lists")


def last_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key in the given order: the last write wins.  A hot key costs one row a task."""
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*(df[c] for c in df.columns)), F.struct(*order)).alias("_row")).select("_row.*")


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order, nulls first.  A hot key costs one row a task."""
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*(df[c] for c in df.columns)), F.struct(*order)).alias("_row")).select("_row.*")
