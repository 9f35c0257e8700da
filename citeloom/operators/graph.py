"""Edges of the corpus graph and queries of one or two steps on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mock_email, short_label, work_year_label


def authored_edges(works: DataFrame, authors: DataFrame) -> DataFrame:
    """(author_id, work_id), once each, where both nodes exist.

    Works may hold ``authors`` or, where that is empty, a flat list ``author_ids``.
    """
    ids = F.transform("authors", lambda a: a["author_id"])
    if "author_ids" in works.columns:
        ids = F.when(F.coalesce(F.array_size("authors"), F.lit(0)) > 0, ids).otherwise(F.col("author_ids"))
    mentions = works.where("id is not null").select(F.col("id").alias("work_id"), F.explode(ids).alias("author_id")).where("author_id is not null")
    return mentions.dropDuplicates(["author_id", "work_id"]).join(authors.select(F.col("id").alias("author_id")), "author_id", "left_semi").select("author_id", "work_id")


def affiliated_edges(works: DataFrame, authors: DataFrame, orgs: DataFrame) -> DataFrame:
    """(author_id, org_id, role), once each, of the authors of works with an organization, where both nodes exist."""
    mentions = works.select(F.explode("authors").alias("a")).select("a.author_id", "a.org_id", F.lit("Researcher").alias("role")).where("author_id is not null and org_id is not null").dropDuplicates()
    return mentions.join(authors.select(F.col("id").alias("author_id")), "author_id", "left_semi").join(orgs.select(F.col("id").alias("org_id")), "org_id", "left_semi").select("author_id", "org_id", "role")


def covers_edges(works: DataFrame, topics: DataFrame) -> DataFrame:
    """(work_id, topic_id, score), once each; no score counts as 1."""
    ids = F.transform("topics", lambda t: F.struct(t["topic_id"].alias("topic_id"), F.coalesce(t["score"], F.lit(1.0)).alias("score")))
    if "topic_ids" in works.columns:
        flat = F.transform("topic_ids", lambda t: F.struct(t.alias("topic_id"), F.lit(1.0).alias("score")))
        ids = F.when(F.coalesce(F.array_size("topics"), F.lit(0)) > 0, ids).otherwise(flat)
    mentions = works.select(F.col("id").alias("work_id"), F.explode(ids).alias("t")).select("work_id", "t.topic_id", "t.score").where("topic_id is not null").dropDuplicates()
    return mentions.join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_semi").select("work_id", "topic_id", "score")


def topic_bridge(topics: DataFrame) -> DataFrame:
    """(topic_ref, topic_id): the id that works cite a topic by, from its category id, to the topic's own id."""
    from ..functions.ids import stable_id

    cited = topics.select(F.col("id").alias("topic_id"), F.explode("sources").alias("s")).where("s.source = 'dtic' and s.id is not null")
    return cited.select(stable_id("topic_ref", F.col("s.id")).alias("topic_ref"), "topic_id").dropDuplicates()


def author_lookup_join(vectors: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds author_name (the id where unknown) and citation_count (0) by author_id."""
    names = lookup.select(F.col("id").alias("author_id"), F.col("name").alias("_name"), F.col("citation_count").alias("_cited"))
    joined = vectors.join(names, "author_id", "left")
    return joined.withColumn("author_name", F.coalesce("_name", F.col("author_id").cast("string"))).withColumn("citation_count", F.coalesce("_cited", F.lit(0)).cast("long")).drop("_name", "_cited")


def author_detail(authors: DataFrame, affiliated: DataFrame, orgs: DataFrame) -> DataFrame:
    """Each author with the sorted list of organizations, empty where there are none."""
    named = affiliated.join(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id")
    lists = named.groupBy("author_id").agg(F.sort_array(F.collect_set(F.struct("org_id", F.col("org_name").alias("name")))).alias("organizations"))
    joined = authors.join(lists.withColumnRenamed("author_id", "id"), "id", "left")
    empty = F.array().cast(lists.schema["organizations"].dataType)
    listed = F.coalesce("organizations", empty)
    return joined.withColumn("organizations", listed).withColumn("org_ids", F.transform(listed, lambda o: o["org_id"]))


def affiliation_orgs(authors: DataFrame, orgs: DataFrame) -> DataFrame:
    each = authors.select(F.col("id").alias("author_id"), F.explode("org_ids").alias("org_id"))
    return each.join(orgs.select(F.col("id").alias("org_id"), "name", "country"), "org_id").select("author_id", "org_id", "name", "country")


#: Members of a block of a heavy group; rows of a table that is counted and broadcast.
BLOCK, FEW = 512, 500_000


def pairs_within(left: DataFrame, right: DataFrame, group: str, member: str, other: str, block: int = BLOCK) -> DataFrame:
    """left (group, member, ...) and right (group, other): the pairs of different members of each group, once a pair of rows.

    Groups of more than ``block`` rows are heavy: their rows are dealt into blocks, and each pair of blocks is a key of
    its own, so that no task has more than a pair of blocks of a group at once.  The other groups are joined by the group
    alone, so tables that are dealt by it already are not shuffled again.
    """
    heavy = right.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")).repartition(group)  # most often none

    def dealt(df: DataFrame, key: str, mine: str, theirs: str) -> DataFrame:
        own = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")
        return df.join(heavy, group).withColumns({mine: own, theirs: F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))}).drop("_blocks")

    light = left.join(heavy, group, "left_anti").join(right, group)
    met = dealt(left, member, "_i", "_j").join(dealt(right, other, "_j", "_i"), [group, "_i", "_j"]).drop("_i", "_j")
    return light.unionByName(met).where(F.col(member) != F.col(other))


def _few(df: DataFrame) -> DataFrame:
    """Sent to every task where it is counted and small."""
    return F.broadcast(df) if df.count() <= FEW else df


def collaborators(authored: DataFrame, author_id=None, block: int = BLOCK) -> DataFrame:
    """(author_id, collaborator_id), once each: other authors of a shared work; of one author, or of all."""
    mine = authored if author_id is None else authored.where(F.col("author_id") == F.lit(author_id))
    other = authored.select("work_id", F.col("author_id").alias("collaborator_id"))
    return pairs_within(mine.select("work_id", "author_id"), other, "work_id", "author_id", "collaborator_id", block).select("author_id", "collaborator_id").distinct()


def network_rows(roots: DataFrame, authored: DataFrame, max_rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """(root, work_id, co_author): the works of each root and their other authors (null where there are none).

    With ``max_rows`` only so many rows of a root stay, the first by work and co-author.
    """
    mine = roots.select("root").join(authored.select(F.col("author_id").alias("root"), "work_id"), "root")
    other = authored.select("work_id", F.col("author_id").alias("co_author"))
    pairs = pairs_within(mine, other, "work_id", "root", "co_author", block).select("root", "work_id", "co_author")
    shared = other.groupBy("work_id").agg((F.min("co_author") != F.max("co_author")).alias("_shared"))
    alone = mine.join(shared, "work_id", "left").where("not coalesce(_shared, false)").select("root", "work_id", F.lit(None).cast(other.schema["co_author"].dataType).alias("co_author"))
    rows = pairs.unionByName(alone)
    if max_rows is None:
        return rows
    first = Window.partitionBy("root").orderBy("work_id", "co_author")
    return rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= max_rows).drop("_r")


def node_union(*nodes: DataFrame) -> DataFrame:
    """The nodes of all tables (root, id, group, label, year, email), once by root and id; of two, that with the first group."""
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n, allowMissingColumns=True)
    return out.groupBy("root", "id").agg(F.min_by(F.struct("group", "label", "year", "email"), F.struct("group", "label")).alias("n")).select("root", "id", "n.*")


def _once(df: DataFrame, key: str, label: str, *others: str) -> DataFrame:
    """One row of each key, that with the first label."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(label, *others)).alias("_n")).select(key, "_n.*")


def network_pairs(mine: DataFrame, everyone: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """mine (root, work_id) and everyone (work_id, author_id): (root, co_author, both, work_id), the pairs of a root and
    another author of each work.  Pairs of two roots (``both``) come once, the lesser in front: see ``both_ways``."""
    is_root = roots.select(F.col("root").alias("co_author"), F.lit(True).alias("both"))
    other = everyone.select("work_id", F.col("author_id").alias("co_author")).join(is_root, "co_author", "left").select("work_id", "co_author", F.coalesce("both", F.lit(False)).alias("both"))
    pairs = pairs_within(mine.select("work_id", "root"), other, "work_id", "root", "co_author", block)
    return pairs.where(~F.col("both") | (F.col("root") < F.col("co_author"))).select("root", "co_author", "both", "work_id")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs of ``network_pairs`` from each root's side."""
    rest = [c for c in pairs.columns if c not in ("root", "co_author", "both")]
    there, back = F.struct(F.col("root").alias("root"), F.col("co_author").alias("co_author")), F.struct(F.col("co_author").alias("root"), F.col("root").alias("co_author"))
    sides = F.explode(F.when(F.col("both"), F.array(there, back)).otherwise(F.array(there)))
    return pairs.select(sides.alias("_p"), *rest).select("_p.root", "_p.co_author", *rest)


def ego_network(
    roots: DataFrame, authors: DataFrame, works: DataFrame, orgs: DataFrame, authored: DataFrame, affiliated: DataFrame, all_edges: bool = False, max_rows: int | None = None, together: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each root author: works, co-authors, organizations.  Ids are texts with their kind in front.

    A co-author's edge goes to the first shared work by id, or with ``all_edges`` to each.  ``max_rows`` bounds the pairs
    of a work and a co-author that a root's network is made from (the first by id); without it nothing is left out.
    With ``together`` nodes and edges share one shuffle of the pairs: for queries that read both.

    A table's rows that repeat an id count once, that with the first name or title.  Nodes of different kinds never share
    an id, so each kind is made without repeats and labels are joined last; only pairs of ids are shuffled.
    """
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    roots = _few(roots.select("root").where("root is not null").distinct())
    email = F.col("email") if "email" in authors.columns else none
    a = _few(_once(authors.select(F.col("id").alias("aid"), F.col("name"), email.alias("email")), "aid", "name", "email"))
    w = works.select(F.col("id").alias("work_id"), short_label(F.col("title")).alias("label"), work_year_label(F.col("publication_date"), F.col("year")).alias("year"))
    w = _once(w.repartition("work_id"), "work_id", "label", "year")
    o = _once(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("label")), "org_id", "label")

    everyone = authored.select("author_id", "work_id").where("author_id is not null and work_id is not null").distinct()
    mine = everyone.join(roots.withColumnRenamed("root", "author_id"), "author_id").select(F.col("author_id").alias("root"), "work_id")
    if max_rows is None:
        pairs = network_pairs(mine, everyone, roots)
        sides = both_ways
    else:
        rows = network_rows(roots, everyone, max_rows)
        mine, pairs = rows.select("root", "work_id").distinct(), rows.where("co_author is not null").withColumn("both", F.lit(False))
        sides = lambda p: p.drop("both")
    first = pairs.groupBy("root", "co_author", "both").agg(F.min("work_id").alias("work_id"))
    met = sides(first.where("work_id is not null") if together else pairs.select("root", "co_author", "both").distinct())  # asks for the work, so that the plans are the same
    member = affiliated.select(F.col("author_id").alias("root"), "org_id").join(roots, "root").distinct()

    person = lambda group, c: [F.col("root"), key("author", c).alias("id"), F.lit(group).alias("group"), F.col("name").alias("label"), none.alias("year"), mock_email(F.col("name"), F.col("email")).alias("email")]
    root_nodes = roots.join(a, F.col("root") == F.col("aid")).select(*person("author", "root"))
    co_nodes = met.join(a, F.col("co_author") == F.col("aid")).select(*person("coauthor", "co_author"))
    work_nodes = mine.join(w, "work_id").select("root", key("work", "work_id").alias("id"), F.lit("work").alias("group"), "label", "year", none.alias("email"))
    org_nodes = member.join(o, "org_id").select("root", key("org", "org_id").alias("id"), F.lit("organization").alias("group"), "label", none.alias("year"), none.alias("email"))
    nodes = root_nodes.unionByName(co_nodes).unionByName(work_nodes).unionByName(org_nodes)

    theirs = sides(pairs.distinct() if all_edges else first.where("work_id is not null"))
    edge = lambda df, kind, c, to, t, of: df.select("root", key(kind, c).alias("source"), key(to, t).alias("target"), F.lit(of).alias("type"))
    edges = edge(mine, "author", "root", "work", "work_id", "AUTHORED").unionByName(edge(theirs, "author", "co_author", "work", "work_id", "AUTHORED"))
    return nodes, edges.unionByName(edge(member, "author", "root", "org", "org_id", "AFFILIATED_WITH"))


def most_recent_year(authored: DataFrame, works: DataFrame) -> DataFrame:
    """(author_id, year): the largest year of each author's works that have one; authors without get no row."""
    years = works.select(F.col("id").alias("work_id"), work_year_label(F.col("publication_date"), F.col("year")).try_cast("int").alias("year")).where("year is not null")
    return authored.join(years, "work_id").groupBy("author_id").agg(F.max("year").alias("year"))


def distinct_facets(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, years, orgs): a network's work years, latest first, and organization labels in order.

    ``roots`` (root) names the networks, so that those without works and organizations are known without their other nodes.
    """
    kind = F.col("group")
    shown = nodes if roots is None else nodes.where(kind.isin("work", "organization"))
    each = shown.select("root", F.when(kind == "work", F.col("year")).alias("year"), F.when(kind == "organization", F.col("label")).alias("org"))
    if roots is not None:
        none = F.lit(None).cast("string")
        each = each.unionByName(roots.select("root", none.alias("year"), none.alias("org")))
    return each.distinct().groupBy("root").agg(F.sort_array(F.collect_set("year"), asc=False).alias("years"), F.sort_array(F.collect_set("org")).alias("orgs"))


def dedupe_backfill_topics(covers: DataFrame, topics: DataFrame) -> DataFrame:
    """A derived row for each topic that works cite and no topic has."""
    missing = covers.select(F.col("topic_id").alias("id")).where("id is not null").distinct().join(topics.select("id"), "id", "left_anti")
    return missing.select("id", F.concat(F.lit("Derived topic "), F.col("id").cast("string")).alias("name"))
