"""Validation, referential integrity and linked samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import has_special_name
from ..schemas import RULES
from .filters import work_flags

def compile_rules(schema: dict, kind: T.DataType, path: str = "") -> list[tuple[str, Callable[[Column], Column]]]:
    """A JSON Schema as (name of a broken rule, when a value breaks it), for a column of type ``kind``.

    type object (properties, required, additionalProperties), array (items, uniqueItems), string (pattern, enum, and
    format date, date-time and uri), integer and number (minimum, maximum).  A null breaks ``required`` alone, or, in a
    list, the rule that its items aren't null.  What a column's type already rules out isn't checked again.
    """
    rules: list[tuple[str, Callable[[Column], Column]]] = []
    name = path.rstrip(".")
    if schema.get("type") == "object":
        fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        for field in schema.get("required", []):
            rules.append((f"{path}{field} missing", (lambda c, field=field: c[field].isNull()) if field in fields else (lambda c: F.lit(True))))
        for field, below in schema.get("properties", {}).items():
            if field in fields:
                rules += [(rule, lambda c, field=field, broken=broken: broken(c[field])) for rule, broken in compile_rules(below, fields[field], f"{path}{field}.")]
        if schema.get("additionalProperties") is False:
            rules += [(f"unexpected field {path}{field}", lambda c, field=field: c[field].isNotNull()) for field in fields if field not in schema.get("properties", {})]
    elif schema.get("type") == "array" and isinstance(kind, T.ArrayType):
        rules.append((f"{name} null item", lambda c: F.exists(c, lambda x: x.isNull())))
        if schema.get("uniqueItems"):
            rules.append((f"{name} repeat", lambda c: F.size(F.array_distinct(c)) < F.size(c)))
        rules += [(rule, lambda c, broken=broken: F.exists(c, lambda x: x.isNotNull() & F.coalesce(broken(x), F.lit(False)))) for rule, broken in compile_rules(schema.get("items", {}), kind.elementType, path)]
    elif schema.get("type") == "string" and isinstance(kind, T.StringType):
        if "pattern" in schema:
            rules.append((f"{name} pattern", lambda c: ~c.rlike(schema["pattern"])))
        if "enum" in schema:
            rules.append((f"{name} unknown", lambda c: ~c.isin(*schema["enum"])))
        formats = {
            "date": lambda c: ~c.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(c).isNull(), "date-time": lambda c: ~c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") | c.try_cast("timestamp").isNull(),
            "uri": lambda c: ~c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"),
        }
        if schema.get("format") in formats:
            rules.append((f"{name} format", formats[schema["format"]]))
    elif schema.get("type") in ("integer", "number"):
        if schema["type"] == "integer" and isinstance(kind, (T.FractionalType, T.StringType)):
            rules.append((f"{name} not an integer", lambda c: c.try_cast("double").isNull() | (c.try_cast("double") != F.floor(c.try_cast("double")))))
        for limit, beyond, word in (("minimum", lambda c, x: c < x, "below"), ("maximum", lambda c, x: c > x, "above")):
            if limit in schema:
                rules.append((f"{name} {word} {schema[limit]}", lambda c, beyond=beyond, x=schema[limit]: beyond(c.try_cast("double"), x)))
    return rules


def validate_entities(df: DataFrame, kind: str, schema: dict | None = None) -> DataFrame:
    """The rows with ``errors``, the broken rules of the kind's schema (``RULES``), nested ones included; repeated ids are
    errors of all their rows, unexpected fields of rows that have a value in them."""
    rules = compile_rules(RULES[kind] if schema is None else schema, df.schema)
    broken = {name: F.coalesce(when(_Columns()), F.lit(False)) for name, when in rules}
    repeated = df.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id"), F.lit(True).alias("_twice"))
    checked = df.join(repeated, F.col("id") == F.col("_id"), "left").drop("_id")
    broken["id repeats"] = F.coalesce("_twice", F.lit(False))
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in broken.items())), lambda e: e.isNotNull())
    return checked.withColumn("errors", found).drop("_twice")


class _Columns:
    """A row's columns by name, as an object's fields are taken."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{name}`")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def referential_integrity(works: DataFrame, authors: DataFrame, orgs: DataFrame, topics: DataFrame) -> DataFrame:
    """(source, ref): references without their entity, once each, of works to authors, of their authors to
    organizations, of works to organizations and topics, and of authors to organizations."""

    def missing(refs: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
        return refs.where("ref is not null").distinct().join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti").select(F.lit(source).alias("source"), F.col("ref").cast("string").alias("ref"))

    out = missing(works.select(F.explode("authors.author_id").alias("ref")), authors, "work.author")
    out = out.unionByName(missing(works.select(F.explode("authors.org_id").alias("ref")), orgs, "work.author.org"))
    if "orgs" in works.columns:
        out = out.unionByName(missing(works.select(F.explode("orgs.org_id").alias("ref")), orgs, "work.org"))
    out = out.unionByName(missing(works.select(F.explode("topics.topic_id").alias("ref")), topics, "work.topic"))
    return out.unionByName(missing(authors.select(F.explode("org_ids").alias("ref")), orgs, "author.org"))


def is_fully_linked(missing: DataFrame) -> DataFrame:
    return missing.agg((F.count(F.lit(1)) == 0).alias("is_fully_linked"))


def all_refs_present(works: DataFrame, authors: DataFrame, orgs: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, all_authors_present, all_orgs_present, all_topics_present): true where a work has no such reference."""

    def present(paths: list[str], nodes: DataFrame, name: str) -> DataFrame:
        refs = works.select("id", F.explode(F.concat(*(F.coalesce(F.col(p), F.array().cast(works.select(paths[0]).schema[0].dataType)) for p in paths))).alias("ref")).where("ref is not null")
        known = nodes.select(F.col("id").alias("ref"), F.lit(True).alias("_k"))
        return refs.join(known, "ref", "left").groupBy("id").agg(F.bool_and(F.coalesce("_k", F.lit(False))).alias(name))

    out = works.select("id")
    of_orgs = ["authors.org_id", *(["orgs.org_id"] if "orgs" in works.columns else [])]  # of its authors and its own
    for paths, nodes, name in ((["authors.author_id"], authors, "all_authors_present"), (of_orgs, orgs, "all_orgs_present"), (["topics.topic_id"], topics, "all_topics_present")):
        out = out.join(present(paths, nodes, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(True)))
    return out


def subset_analysis(works: DataFrame, authors: DataFrame, orgs: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: counts, connectivity and edge cases of a linked set."""
    none = lambda c: F.coalesce(F.array_size(c), F.lit(0)) == 0
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    linked = works.select(F.explode("authors.author_id").alias("id")).distinct()
    org_refs = authors.select(F.explode("org_ids").alias("id")).unionByName(works.select(F.explode("orgs.org_id").alias("id"))).distinct() if "orgs" in works.columns else authors.select(F.explode("org_ids").alias("id")).distinct()
    flags = work_flags(works if "orgs" in works.columns else works.withColumn("orgs", F.lit(None).cast("array<struct<org_id:string,role:string>>")))
    w = flags.agg(
        F.count(F.lit(1)).alias("works"), F.count_if(~F.col("has_abstract")).alias("works_missing_abstract"), F.count_if(~F.col("has_doi")).alias("works_missing_doi"), F.count_if(~F.col("has_authors")).alias("works_no_authors"),
        F.count_if(F.col("has_author_missing_org")).alias("works_author_missing_org"), F.count_if(~F.col("has_topics")).alias("works_no_topics"), F.count_if(~F.col("has_orgs")).alias("works_no_orgs"),
    )
    a = authors.agg(F.count(F.lit(1)).alias("authors"), F.count_if(none("org_ids")).alias("authors_no_orgs"), F.count_if(zero("works_count")).alias("authors_zero_works"), F.count_if(zero("citation_count")).alias("authors_zero_citations"), F.count_if(has_special_name(F.col("name"))).alias("authors_special_names"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        w, a, n(orgs, "orgs"), n(topics, "topics"), n(authors.join(linked, "id", "left_semi"), "authors_with_works"), n(authors.join(linked, "id", "left_anti"), "authors_without_works"),
        n(orgs.join(org_refs, "id", "left_semi"), "orgs_referenced"), n(topics.join(works.select(F.explode("topics.topic_id").alias("id")).distinct(), "id", "left_semi"), "topics_referenced"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


#: Fixed values.  Categories of a linked sample: name, quota, condition on ``work_flags`` and ``all_refs_present``.  Earlier ones pick first.
CATEGORIES = (
    ("baseline", 20, "has_abstract and has_doi and has_authors and has_topics and has_orgs and all_authors_present and all_orgs_present and num_authors <= 2"),
    ("missing_abstract", 8, "not has_abstract and has_authors and has_topics and has_orgs and all_authors_present and all_orgs_present and num_authors <= 2"),
    ("missing_doi", 5, "not has_doi and has_abstract and has_authors and has_topics and has_orgs and all_authors_present and all_orgs_present and num_authors <= 2"),
    ("no_authors", 5, "not has_authors and has_abstract and has_topics and has_orgs and all_orgs_present"),
    ("author_missing_org", 5, "has_authors and has_author_missing_org and has_topics and all_authors_present and num_authors <= 3"),
    ("no_topics", 3, "has_authors and not has_topics and has_orgs and all_authors_present and all_orgs_present and num_authors <= 2"),
    ("no_orgs", 2, "has_authors and has_topics and not has_orgs and all_authors_present and num_authors <= 2"),
    ("older", 2, "has_authors and has_topics and has_orgs and all_authors_present and all_orgs_present and year < 2000 and num_authors <= 2"),
)


#: Rules that fill up the authors of a linked sample, in this order: condition and how many authors it may add.
#: Edge cases of authors and how many of each a sample takes.
_EDGE_AUTHORS = (("works_count = 0", 6), ("size(org_ids) = 0", 6), ("citation_count = 0 and works_count > 0", 4), ("special", 4), ("true", None))


def _clean_ids(*lists: str) -> Column:
    """The different ids of some lists that aren't blank."""
    ids = F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))
    return F.array_distinct(F.filter(ids, lambda i: F.coalesce(F.trim(i.cast("string")), F.lit("")) != ""))


def _outside(column: str, df: DataFrame, known: set) -> Column:
    """How many of a list's ids aren't in ``known``, a set that a budget bounds."""
    return F.size(F.array_except(column, F.array(*map(F.lit, sorted(known))).cast(df.schema[column].dataType)))


def _pick_works(flags: DataFrame, condition: str, quota: int, picks: dict, seen: dict[str, set], budgets: dict[str, int]) -> list:
    """Ids of at most ``quota`` works, one after the other: that which refers to the fewest new authors, organizations
    and topics and keeps within the budgets.  ``seen`` grows.  Works without new references don't change what comes
    after them, so one job takes all of those that lead."""
    found: list = []
    while len(found) < quota:
        left = flags.where(condition).where(~F.col("id").isin([*picks, *found]))
        left = left.withColumns({f"new_{k}": _outside(k, flags, seen[k]) for k in seen})
        for k in seen:
            left = left.where(F.col(f"new_{k}") <= budgets[k] - len(seen[k]))
        keys = [*(f"new_{k}" for k in seen), F.when(F.col("num_authors") == 1, 0).otherwise(F.col("num_authors")), ~F.col("has_abstract"), F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)), "id"]
        rows = left.orderBy(*keys).limit(quota - len(found)).collect()
        if not rows:
            break
        for r in [r for r in rows if not any(r[f"new_{k}"] for k in seen)] or rows[:1]:
            found.append(r.id)
            for k in seen:
                seen[k] |= set(r[k])
    return found


def _fill_authors(authors: DataFrame, chosen: list, known: set, target: int) -> list:
    """Ids that fill ``chosen`` up to ``target``: by each rule those with the fewest organizations outside ``known``, which grows."""
    number = lambda c: (F.coalesce(F.col(c), F.lit(0)) if c in authors.columns else F.lit(0)).alias(c)
    all_ = authors.select("id", _clean_ids("org_ids").alias("org_ids"), number("works_count"), number("citation_count"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce(has_special_name(F.col("name")), F.lit(False)).alias("special"))
    extras: list = []
    for condition, most in _EDGE_AUTHORS:
        want = min(target - len(chosen) - len(extras), target if most is None else most)
        if want > 0:
            left = all_.where(condition).where(~F.col("id").isin([*chosen, *extras]))
            rows = left.orderBy(_outside("org_ids", all_, known), F.size("org_ids"), "works_count", "name", "id").limit(want).select("id", "org_ids").collect()
            extras += [r.id for r in rows]
            known |= {o for r in rows for o in r.org_ids}
    return extras


def linked_subset(works: DataFrame, authors: DataFrame, orgs: DataFrame, topics: DataFrame, categories: tuple = CATEGORIES, target: int = 50, strict: bool = True) -> dict[str, DataFrame]:
    """A stratified sample of works, with the authors, organizations and topics that they refer to.

    Works (with ``category``) are picked category by category, each time the one that reuses most of what earlier ones
    refer to, within budgets of linked entities.  The other tables (with ``why``: linked or fill) are filled up to
    ``target``: authors by rules for edge cases, organizations with a country and topics about information first.
    Topics that works refer to and that have no row are derived from their id.

    ``strict``: ValueError if a category finds too few works, if they aren't ``target`` in all, or if more entities are
    linked than ``target``.  Otherwise other works within the budgets fill up, and all linked entities stay.

    The driver holds ids of picked works and of what they refer to, which ``target`` bounds; tables are read by id.
    """
    refs = works.select("id", _clean_ids("authors.author_id").alias("authors"), _clean_ids("authors.org_id", "orgs.org_id").alias("orgs"), _clean_ids("topics.topic_id").alias("topics"))
    flags = work_flags(works).join(all_refs_present(works, authors, orgs, topics), "id").join(refs, "id").persist()
    # fixed values: how many linked entities a sample may have
    budgets = {"authors": max(target - 6, 40), "orgs": max(target - 5, 45), "topics": target}
    seen: dict[str, set] = {k: set() for k in budgets}
    picks: dict = {}
    for name, quota, condition in categories:
        found = _pick_works(flags, condition, quota if strict else min(quota, target - len(picks)), picks, seen, budgets)
        if strict and len(found) < quota:
            raise ValueError(f"category {name} finds {len(found)} of {quota} works")
        picks |= dict.fromkeys(found, name)
    if strict and len(picks) != target:
        raise ValueError(f"{len(picks)} works, not {target}")
    picks |= dict.fromkeys(_pick_works(flags, "true", target - len(picks), picks, seen, budgets), "fill")
    flags.unpersist()

    def marked(nodes: DataFrame, linked: list, extras: list) -> DataFrame:
        return nodes.where(F.col("id").isin([*linked, *extras])).withColumn("why", F.when(F.col("id").isin(linked), "linked").otherwise("fill"))

    def present(nodes: DataFrame, ids: set) -> list:
        linked = [r.id for r in nodes.where(F.col("id").isin(list(ids))).select("id").distinct().collect()]
        if strict and len(linked) > target:
            raise ValueError(f"{len(linked)} linked entities, more than {target}")
        return linked

    def filled(nodes: DataFrame, ids: set, *keys: Column) -> DataFrame:
        linked = present(nodes, ids)
        more = nodes.where(~F.col("id").isin(linked)).orderBy(*keys, "id").limit(max(0, target - len(linked)))
        return marked(nodes, linked, [r.id for r in more.select("id").collect()])

    text = lambda df, c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    linked = present(authors, seen["authors"])
    a = marked(authors, linked, _fill_authors(authors, linked, seen["orgs"], target))
    of_chosen = {o for r in a.select(_clean_ids("org_ids").alias("o")).collect() for o in r.o}
    derived = _derived_topics(topics, seen["topics"] - set(present(topics, seen["topics"])))
    picked = works.sparkSession.createDataFrame(list(picks.items()), f"id {works.schema['id'].dataType.simpleString()}, category string")
    return {
        "works": works.join(F.broadcast(picked), "id"),  # target rows
        "authors": a,
        "orgs": filled(orgs, seen["orgs"] | of_chosen, text(orgs, "country") == "", text(orgs, "country"), text(orgs, "name")),
        "topics": filled(topics.unionByName(derived, allowMissingColumns=True) if derived is not None else topics, seen["topics"], ~F.lower(text(topics, "field")).contains("information"), text(topics, "field"), text(topics, "name")),
    }


def _derived_topics(topics: DataFrame, ids: set) -> DataFrame | None:
    """Rows of topics that have none, in the columns of ``topics``."""
    if not ids:
        return None
    made = topics.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"id {topics.schema['id'].dataType.simpleString()}")
    key = F.col("id").cast("string")
    values = {"name": F.concat(F.lit("Derived topic "), F.regexp_replace(key, "^[^_]*_", "")), "field": F.lit("Derived from selected work references")}
    if "sources" in topics.columns:
        source = F.to_json(F.array(F.struct(F.lit("dtic").alias("source"), key.alias("id"))))
        values["sources"] = F.from_json(source, topics.schema["sources"].dataType.simpleString())
    return made.withColumns({c: v for c, v in values.items() if c in topics.columns})
