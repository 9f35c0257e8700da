"""Declared schemas of the corpus tables, as DDL."""

SOURCES = "array<struct<source: string, id: string>>"
AUTHOR = f"id string, name string, org_ids array<string>, h_index long, citation_count long, works_count long, sources {SOURCES}, last_updated timestamp, created_at timestamp, email string, uid string, org_name string"
WORK = (
    "id string, title string, abstract string, publication_date string, year int, citation_count long, venue string, doi string, url string, "
    "authors array<struct<author_id: string, org_id: string>>, orgs array<struct<org_id: string, role: string>>, "
    f"topics array<struct<topic_id: string, score: double>>, sources {SOURCES}, name string, type string, last_updated timestamp, created_at timestamp"
)
ORG = f"id string, name string, country string, type string, sources {SOURCES}, last_updated timestamp, created_at timestamp"
TOPIC = f"id string, name string, field string, subfield string, domain string, sources {SOURCES}, last_updated timestamp, created_at timestamp"
PUBLICATION = (
    "publication_id string, title string, abstract string, publication_date string, url string, doi string, venue string, document_type string, citations_count long, scraped_at string, "
    "authors array<struct<name: string, researcher_id: string, affiliations: array<string>, org_ids: array<string>, affiliation_details: array<struct<name: string, org_id: string, country: string>>>>, "
    "organizations array<struct<name: string, org_id: string, country: string, type: string>>, keywords array<string>"
)
AUTHOR_METRICS = "id string, orcid array<string>, sources array<struct<id: string, label: string, value: string, meta: array<struct<id: string, value: double>>>>"
ENTITIES = {"authors": AUTHOR, "works": WORK, "orgs": ORG, "topics": TOPIC}
EMBEDDING_DIM = 384
#: Kinds of organizations, roles in a work, names of sources.
ORG_TYPES = ("institution", "funder", "publisher", "other")
ROLES = ("funder", "publisher", "affiliation", "other")
SOURCE_NAMES = ("ror", "openalex", "crossref", "dtic", "orcid", "other")

_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_TEXT, _COUNT, _TIME = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "string", "format": "date-time"}


def _list(required: list[str], **fields) -> dict:
    return {"type": "array", "items": {"type": "object", "properties": fields, "required": required}}


def _entity(kind: str, named: str, /, **fields) -> dict:
    common = {"id": {"type": "string", "pattern": f"^{kind}_{_UUID}$"}, "name": _TEXT, "last_updated": _TIME, "created_at": _TIME}
    common["sources"] = _list(["source", "id"], source={"type": "string", "enum": list(SOURCE_NAMES)}, id=_TEXT)
    return {"type": "object", "properties": common | fields, "required": ["id", named], "additionalProperties": False}


#: What clean entities must satisfy, as JSON Schema; ``orcid``, ``created_at`` and the fields that loads add are allowed.
RULES = {
    "author": _entity("author", "name", org_ids={"type": "array", "items": _TEXT, "uniqueItems": True}, h_index=_COUNT, citation_count=_COUNT, works_count=_COUNT, email=_TEXT, uid={}, org_name=_TEXT),
    "work": _entity(
        "work", "title", title=_TEXT, abstract=_TEXT, publication_date={"type": "string", "format": "date"}, citation_count=_COUNT, authors=_list(["author_id"], author_id=_TEXT, org_id=_TEXT),
        orgs=_list(["org_id", "role"], org_id=_TEXT, role={"type": "string", "enum": list(ROLES)}), topics=_list(["topic_id", "score"], topic_id=_TEXT, score={"type": "number", "minimum": 0, "maximum": 1}),
        venue=_TEXT, doi=_TEXT, url={"type": "string", "format": "uri"}, year={"type": "integer"}, type=_TEXT,
    ),
    "org": _entity("org", "name", country=_TEXT, type={"type": "string", "enum": list(ORG_TYPES)}),
    "topic": _entity("topic", "name", field=_TEXT, subfield=_TEXT, domain=_TEXT),
}
