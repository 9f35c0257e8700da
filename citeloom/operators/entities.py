"""Publication records to clean works, authors, organizations and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.scalars import pad_publication_date, parse_year, sanitize_name, truthy
from ..schemas import AUTHOR_METRICS, ORG_TYPES

_ENTITIES = "array<struct<id: string, details: struct<name: string, uber_cat_id: string>>>"
_GROUP = f"entities {_ENTITIES}, name string, title string, id string, field string, subfield string, domain string"


def _source(key: Column) -> Column:
    return F.array(F.struct(F.lit("dtic").alias("source"), key.alias("id")))


def _none_if_empty(df: DataFrame, *lists: str) -> DataFrame:
    """Lists without members are null.  A step of its own, so that each list is made once, and not again for its size."""
    return df.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in lists})


def with_org_map(publications: DataFrame) -> DataFrame:
    """Adds ``_orgs``: names of a publication's organizations with an id, to ids; of one name the last wins.

    The last of each name is found by one sort of (name, place), so the work is that of the sort; the sorted list is a
    column of its own, made once.
    """
    known = F.filter(F.coalesce("organizations", F.array()), lambda o: truthy(o["org_id"]).isNotNull() & truthy(o["name"]).isNotNull())
    placed = publications.withColumn("_placed", F.array_sort(F.transform(known, lambda o, i: F.struct(o["name"].alias("name"), i.alias("i"), o["org_id"].alias("org_id")))))
    after = F.slice("_placed", F.lit(2), F.greatest(F.size("_placed"), F.lit(1)))
    last = F.filter(F.zip_with("_placed", after, lambda o, n: F.when(n.isNull() | (n["name"] != o["name"]), o)), lambda o: o.isNotNull())
    return placed.withColumn("_orgs", F.map_from_entries(F.transform(last, lambda o: F.struct(o["name"], o["org_id"])))).drop("_placed")


def resolve_work_authors(authors: Column, orgs_by_name: Column) -> Column:
    """Authors with a researcher id, each with the organization of the first affiliation if the work names it."""
    known = F.filter(authors, lambda a: truthy(a["researcher_id"]).isNotNull())
    return F.transform(known, lambda a: F.struct(stable_id("author", a["researcher_id"]).alias("author_id"), stable_id("org", F.try_element_at(orgs_by_name, F.coalesce(F.get(a["affiliations"], 0), F.lit("")))).alias("org_id")))


def work_orgs(organizations: Column) -> Column:
    known = F.filter(organizations, lambda o: truthy(o["org_id"]).isNotNull())
    return F.transform(known, lambda o: F.struct(stable_id("org", o["org_id"]).alias("org_id"), F.lit("affiliation").alias("role")))


def keyword_entities(keywords: Column) -> Column:
    """The entities of all keyword groups; keywords that aren't groups have none."""
    return F.flatten(F.transform(keywords, lambda k: F.coalesce(F.from_json(F.when(k.startswith("{"), k), _GROUP)["entities"], F.array())))


def work_topics(keywords: Column) -> Column:
    cited = F.filter(keyword_entities(keywords), lambda e: truthy(e["details"]["uber_cat_id"]).isNotNull())
    return F.transform(cited, lambda e: F.struct(stable_id("topic_ref", e["details"]["uber_cat_id"]).alias("topic_id"), F.lit(1.0).alias("score")))


def clean_works(publications: DataFrame, run_ts: Column) -> DataFrame:
    """One row per publication with an id and a title; lists without members are null."""
    whole = with_org_map(publications.where(truthy(F.col("publication_id")).isNotNull() & truthy(F.col("title")).isNotNull()))
    works = whole.select(
        stable_id("work", F.col("publication_id")).alias("id"), "title", truthy(F.col("abstract")).alias("abstract"), pad_publication_date(truthy(F.col("publication_date"))).alias("publication_date"),
        F.col("citations_count").cast("long").alias("citation_count"), truthy(F.col("doi")).alias("doi"), truthy(F.col("url")).alias("url"), truthy(F.col("venue")).alias("venue"),
        resolve_work_authors(F.col("authors"), F.col("_orgs")).alias("authors"), work_orgs(F.col("organizations")).alias("orgs"), work_topics(F.col("keywords")).alias("topics"),
        _source(F.col("publication_id")).alias("sources"), run_ts.alias("last_updated"),
    )
    return _none_if_empty(works, "authors", "orgs", "topics")


def clean_authors(publications: DataFrame, run_ts: Column) -> DataFrame:
    """One row per mention of an author with a name and a researcher id; org_ids of all affiliations the work names."""
    each = with_org_map(publications).select("_orgs", F.explode("authors").alias("a"))
    known = each.where(truthy(F.col("a.name")).isNotNull() & truthy(F.col("a.researcher_id")).isNotNull())
    found = F.filter(F.transform(F.col("a.affiliations"), lambda x: F.try_element_at(F.col("_orgs"), x)), lambda x: x.isNotNull())
    authors = known.select(
        stable_id("author", F.col("a.researcher_id")).alias("id"), F.col("a.name").alias("name"), F.col("a.researcher_id").alias("researcher_id"),
        F.transform(found, lambda g: stable_id("org", g)).alias("org_ids"), _source(F.col("a.researcher_id")).alias("sources"), run_ts.alias("last_updated"),
    )
    return _none_if_empty(authors, "org_ids")


def author_metrics_enrich(authors: DataFrame, payloads: DataFrame) -> DataFrame:
    """Adds ORCIDs as sources, works_count and citation_count from payloads (researcher_id, json) where there are any.

    Counts that a payload lacks stay as the row has them; of repeated payloads of a researcher the longest is used.
    """
    one = payloads.where("researcher_id is not null").groupBy(F.col("researcher_id").alias("_rid")).agg(F.max_by("json", F.struct(F.length("json"), "json")).alias("_json"))
    p = one.select("_rid", F.from_json("_json", AUTHOR_METRICS).alias("m"))
    plus = F.get(F.filter("m.sources", lambda s: s["id"] == "publication_plus"), 0)
    cited = F.get(F.filter(plus["meta"], lambda x: x["id"] == "citations"), 0)["value"]
    orcids = F.transform(F.filter(F.coalesce(F.col("m.orcid"), F.array()), lambda o: truthy(o).isNotNull()), lambda o: F.struct(F.lit("orcid").alias("source"), o.alias("id")))
    had = lambda c: F.col(c).cast("long") if c in authors.columns else F.lit(None).cast("long")
    joined = authors.join(p, F.col("researcher_id") == F.col("_rid"), "left")
    counts = {"works_count": F.coalesce(plus["value"].try_cast("double").cast("long"), had("works_count")), "citation_count": F.coalesce(cited.cast("long"), had("citation_count"))}
    return joined.withColumns({"sources": F.concat(F.coalesce("sources", F.array()), orcids), **counts}).drop("_rid", "m")


def clean_orgs(publications: DataFrame, run_ts: Column) -> DataFrame:
    """One row per mention of an organization with an id."""
    each = publications.select(F.explode("organizations").alias("o")).where(truthy(F.col("o.org_id")).isNotNull())
    kind = truthy(F.col("o.type"))
    return each.select(
        stable_id("org", F.col("o.org_id")).alias("id"), F.coalesce("o.name", F.lit("")).alias("name"), truthy(F.col("o.country")).alias("country"),
        F.when(kind.isin(*ORG_TYPES), kind).when(kind.isNotNull(), "other").alias("type"), _source(F.col("o.org_id")).alias("sources"), run_ts.alias("last_updated"),
    )


def keyword_groups(publications: DataFrame) -> DataFrame:
    """(publication_id, grp, keyword, data): each keyword, with its parsed form where it is an object."""
    each = publications.select("publication_id", F.posexplode("keywords").alias("grp", "keyword"))
    return each.withColumn("data", F.from_json(F.when(F.col("keyword").startswith("{"), F.col("keyword")), _GROUP))


def topic_hierarchy(groups: DataFrame) -> DataFrame:
    """(name, data_id, field, subfield, domain) of each group's coded entities.

    Two leading digits: a field; four: a subfield, which joins the field of its first two digits, the last one of that
    code.  A subfield stands alone where its field is missing; a field with subfields isn't a topic itself.  A group's
    entities are one row's list, so nothing is shuffled.
    """
    kind = "array<struct<name: string, code: string, data_id: string>>"
    coded = F.transform("data.entities", lambda e: F.struct(e["details"]["name"].alias("name"), F.regexp_extract(e["details"]["name"], r"^(\d+)", 1).alias("code"), F.coalesce(truthy(e["details"]["uber_cat_id"]), truthy(e["id"])).alias("data_id")))
    each = groups.where("data.entities is not null").select(F.filter(coded, lambda e: e["data_id"].isNotNull() & F.length(e["code"]).isin(2, 4)).cast(kind).alias("es"))
    latest = each.select(
        F.filter("es", lambda e: F.length(e["code"]) == 4).alias("subs"),
        F.aggregate(F.filter("es", lambda e: F.length(e["code"]) == 2), F.array().cast(kind), lambda fs, e: F.concat(F.filter(fs, lambda f: f["code"] != e["code"]), F.array(e))).alias("fields"),
    )
    none = F.lit(None).cast("string")
    below = F.transform("subs", lambda s: F.struct(
        s["name"].alias("name"), s["data_id"].alias("data_id"), F.get(F.filter("fields", lambda f: f["code"] == F.substring(s["code"], 1, 2)), 0)["name"].alias("field"), s["name"].alias("subfield"), none.alias("domain")))
    lone = F.filter("fields", lambda f: ~F.exists("subs", lambda s: F.substring(s["code"], 1, 2) == f["code"]))
    alone = F.transform(lone, lambda f: F.struct(f["name"].alias("name"), f["data_id"].alias("data_id"), f["name"].alias("field"), none.alias("subfield"), none.alias("domain")))
    return latest.select(F.inline(F.concat(below, alone)))


def simple_topics(groups: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """Topics of plain keywords, of objects without entities, and of URL keywords by their payload (url, payload)."""
    none = F.lit(None).cast("string")
    is_url = F.col("keyword").startswith("/") | F.col("keyword").startswith("http")
    plain = groups.where(F.col("data").isNull() & ~is_url & (F.trim("keyword") != "")).select(F.col("keyword").alias("name"), none.alias("data_id"), none.alias("field"), none.alias("subfield"), none.alias("domain"))
    of = lambda d: [F.coalesce(truthy(d["name"]), truthy(d["title"])).alias("name"), d["id"].alias("data_id"), d["field"].alias("field"), d["subfield"].alias("subfield"), d["domain"].alias("domain")]
    objects = groups.where("data is not null and data.entities is null").select(*of(F.col("data")))
    out = plain.unionByName(objects)
    if payloads is not None:
        fetched = groups.where(is_url).join(payloads.select(F.col("url").alias("keyword"), F.from_json("payload", _GROUP).alias("p")), "keyword").select(*of(F.col("p")))
        out = out.unionByName(fetched)
    return out.where("name is not null")


def clean_topics(topics: DataFrame, run_ts: Column) -> DataFrame:
    """Topic rows with ids by name; ``key`` is what upserts go by."""
    key = F.coalesce(truthy(F.col("data_id")), sanitize_name(F.col("name")))
    source = F.coalesce(truthy(F.col("data_id")), F.concat(F.lit("dtic:"), sanitize_name(F.col("name"))))
    return topics.select(stable_id("topic", F.col("name")).alias("id"), "name", "field", "subfield", "domain", _source(source).alias("sources"), key.alias("key"), run_ts.alias("last_updated"))


def normalize_work_payload(works: DataFrame) -> DataFrame:
    """Defaults that the graph load needs; a null title counts as missing."""
    title = F.coalesce("title", truthy(F.col("name")), truthy(F.col("id").cast("string")), F.lit("Untitled Work"))
    return works.withColumns({"title": title, "name": F.coalesce("name", title), "type": F.coalesce("type", F.lit("report")), "citation_count": F.coalesce("citation_count", F.lit(0).cast("long")), "year": F.coalesce("year", parse_year(F.col("publication_date")))})


def default_org_type(orgs: DataFrame) -> DataFrame:
    return orgs.withColumn("type", F.coalesce(truthy(F.col("type")), F.lit("institution")))


def node_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Fills nulls: numbers with 0, roles with Researcher, scores with 1.0, or what is given."""
    known = {"h_index": 0, "works_count": 0, "citation_count": 0, "role": "Researcher", "score": 1.0} | defaults
    return df.fillna({c: v for c, v in known.items() if c in df.columns})
