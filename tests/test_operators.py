import json
import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import entities, filters, graph, identity, publications, quality, search, stats, upsert, vectors
from citeloom.schemas import PUBLICATION


def ts():
    return F.lit("2026-01-01").cast("timestamp")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def publication(spark, **over):
    base = {
        "publication_id": "pub.1", "title": "T", "publication_date": "2020-05", "citations_count": 0, "doi": "",
        "authors": [{"name": "Ann", "researcher_id": "ur.1", "affiliations": ["X", "Y"]}, {"name": "Bob", "affiliations": ["X"]}, {"name": "", "researcher_id": "ur.3", "affiliations": []}],
        "organizations": [{"name": "X", "org_id": "grid.1", "type": "Education"}, {"name": "X", "org_id": "grid.2"}, {"name": "Y", "org_id": "grid.3", "type": "funder"}, {"name": "Z"}],
        "keywords": ["Soil", "/kw/1", json.dumps({"entities": [{"id": "a", "details": {"name": "30 Food", "uber_cat_id": "80003"}}, {"id": "b", "details": {"name": "3002 Soil", "uber_cat_id": "80020"}}, {"id": "c", "details": {"name": "41 Env"}}, {"id": "d", "details": {"name": "5101 Odd"}}]}), json.dumps({"name": "Named", "field": "F"})],
    }
    text = json.dumps(base | over)
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", PUBLICATION).alias("p")).select("p.*")


def test_clean_works(spark):
    w = entities.clean_works(publication(spark), ts()).first()
    assert w.publication_date == "2020-05-01" and w.citation_count == 0 and w.doi is None
    assert len(w.authors) == 2 and w.authors[0].org_id == entities.clean_orgs(publication(spark), ts()).collect()[1].id  # the last of one name wins
    assert len(w.orgs) == 3 and w.orgs[0].role == "affiliation" and len(w.topics) == 2
    assert entities.clean_works(publication(spark, title=""), ts()).count() == 0
    empty = entities.clean_works(publication(spark, authors=[], organizations=[], keywords=None), ts()).first()
    assert empty.authors is None and empty.orgs is None and empty.topics is None


def test_clean_authors_and_orgs(spark):
    a = entities.clean_authors(publication(spark), ts()).collect()
    assert [x.name for x in a] == ["Ann"] and len(a[0].org_ids) == 2
    assert [x.type for x in entities.clean_orgs(publication(spark), ts()).collect()] == ["other", None, "funder"]


def test_author_metrics(spark):
    payload = json.dumps({"id": "ur.1", "orcid": ["0000-1", ""], "sources": [{"id": "other"}, {"id": "publication_plus", "value": 12, "meta": [{"id": "h", "value": 1}, {"id": "citations", "value": 34}]}]})
    p = spark.createDataFrame([("ur.1", payload)], "researcher_id string, json string")
    a = entities.author_metrics_enrich(entities.clean_authors(publication(spark), ts()), p).first()
    assert (a.works_count, a.citation_count) == (12, 34) and [s.source for s in a.sources] == ["dtic", "orcid"]


def test_topics(spark):
    groups = entities.keyword_groups(publication(spark))
    found = {(r.name, r.field) for r in entities.topic_hierarchy(groups).collect()}
    assert found == {("3002 Soil", "30 Food"), ("41 Env", "41 Env"), ("5101 Odd", None)}
    payloads = spark.createDataFrame([("/kw/1", '{"title": "Fetched"}')], "url string, payload string")
    assert {r.name for r in entities.simple_topics(groups, payloads).collect()} == {"Soil", "Named", "Fetched"}


def test_amplify_keywords(spark):
    p = publication(spark, keywords=["a", "/kw/1", "http://x", "z"])
    payloads = spark.createDataFrame([("/kw/1", '["k1", "k2"]')], "url string, payload string")
    r = publications.amplify_keywords(p, payloads, ts()).first()
    assert r.keywords == ["a", "k1", "k2", "http://x", "z"] and r.keywords_urls == ["/kw/1", "http://x"] and r.keywords_amplified
    assert publications.amplify_keywords(p, payloads.limit(0), ts()).first().keywords_amplified_at is None


def test_extract_publications(spark):
    page = {
        "page_structure": {
            "publication-header": {"data": {"title": "", "pub_class": "", "pub_class_id": "article", "metadata": {"data": {"pub_date": "May 2001"}}}}, "custom-meta": {"data": {"doi": "10.1/x"}},
            "authors": {"data": {"affiliations_details": [
                {"first_name": "Ann", "last_name": "Lee", "orcid": ["0-1"], "affiliations": [{"name": "U", "id": "grid.5", "country": "US"}, {"name": "V", "navigation": {"a": "/x/grid.6.7?y"}}, {"name": "Raw"}]},
                {"first_name": "", "affiliations": [{"name": "raw"}, {"name": "U2", "grid_id": "grid.5"}]}]}},
        },
        "entities": [{"key": "categories-for", "navigation": {"json": "/p.json"}}],
    }
    df = spark.createDataFrame([("pub.9", "u", json.dumps(page))], "publication_id string, url string, json string")
    r = publications.extract_publications(df).first()
    assert (r.title, r.document_type, r.publication_date, r.doi, r.fields_path) == ("Unknown Title", "article", "1 May 2001", "10.1/x", "/p.json")
    assert [a.name for a in r.authors] == ["Ann Lee"] and r.authors[0].researcher_id == "0-1" and r.authors[0].org_ids == ["grid.5", "grid.6.7"]
    assert [(o.name, o.org_id) for o in r.organizations] == [("U", "grid.5"), ("V", "grid.6.7"), ("Raw", None)]


@pytest.fixture
def corpus(spark):
    works = spark.createDataFrame(
        [("w1", "One", "2020-01-01", None, [("a1", "o1"), ("a2", None), ("a9", "o9")], [("t1", 0.9), ("t9", None)]), ("w2", "Two", None, 2016, [("a1", "o1"), ("a1", "o1"), ("a3", "o2")], []), ("w3", "Three", None, None, None, None)],
        "id string, title string, publication_date string, year int, authors array<struct<author_id:string,org_id:string>>, topics array<struct<topic_id:string,score:double>>",
    )
    authors = spark.createDataFrame([("a1", "Ann", ["o1"]), ("a2", "Bob", []), ("a3", "Cy", ["o7"])], "id string, name string, org_ids array<string>")
    orgs = spark.createDataFrame([("o1", "Uni"), ("o2", "Lab")], "id string, name string")
    topics = spark.createDataFrame([("t1", "Soil")], "id string, name string")
    return works, authors, orgs, topics


def test_edges(corpus):
    works, authors, orgs, topics = corpus
    assert rows(graph.authored_edges(works, authors), "author_id", "work_id") == [("a1", "w1"), ("a1", "w2"), ("a2", "w1"), ("a3", "w2")]
    assert rows(graph.affiliated_edges(works, authors, orgs), "author_id") == [("a1", "o1", "Researcher"), ("a3", "o2", "Researcher")]
    assert rows(graph.covers_edges(works, topics)) == [("w1", "t1", 0.9)]


def test_ego_network(spark, corpus):
    works, authors, orgs, _ = corpus
    e, f = graph.authored_edges(works, authors), graph.affiliated_edges(works, authors, orgs)
    nodes, edges = graph.ego_network(spark.createDataFrame([("a1",)], "root string"), authors, works, orgs, e, f)
    assert {(r.id, r.group) for r in nodes.collect()} == {("author:a1", "author"), ("author:a2", "coauthor"), ("author:a3", "coauthor"), ("work:w1", "work"), ("work:w2", "work"), ("org:o1", "organization")}
    assert edges.count() == 5 and {r.year for r in nodes.collect()} == {None, "2020", "2016"}
    assert rows(graph.collaborators(e, "a1"), "collaborator_id") == [("a1", "a2"), ("a1", "a3")]
    shown = filters.filter_graph_view(nodes, "author:a1", year="2020", org="Lab")
    assert {r.id for r in shown.collect()} == {"author:a1", "author:a2", "author:a3", "work:w1"}


def test_integrity(corpus):
    works, authors, orgs, topics = corpus
    missing = quality.referential_integrity(works, authors, orgs, topics)
    assert {tuple(r) for r in missing.collect()} == {("work.author", "a9"), ("work.author.org", "o9"), ("work.topic", "t9"), ("author.org", "o7")}
    assert not quality.is_fully_linked(missing).first()[0]
    assert {r.id: r.all_authors_present for r in quality.all_refs_present(works, authors, orgs, topics).collect()} == {"w1": False, "w2": True, "w3": True}
    s = quality.linked_subset(works.withColumns({"abstract": F.lit("x"), "doi": F.lit("d"), "orgs": F.lit(None).cast("array<struct<org_id:string,role:string>>")}), authors, orgs, topics, target=2, strict=False)
    assert s["works"].count() == 2 and s["authors"].count() >= 2


def test_most_recent_year(spark, corpus):
    years = spark.createDataFrame([("w1", "1973", None), ("w2", None, 2020), ("w3", "1999-01", None), ("w4", "n.d.", None)], "id string, publication_date string, year int")
    edges = spark.createDataFrame([("a", w) for w in ("w1", "w2", "w3", "w4")] + [("b", "w4")], "author_id string, work_id string")
    assert rows(graph.most_recent_year(edges, years)) == [("a", 2020)]


def test_vectors(spark):
    v = spark.createDataFrame([(i, f"A{i}", [float(i), 0.0], i) for i in range(6)], "id long, author_name string, embedding array<float>, num_abstracts long")
    page = vectors.vector_search(v, [0.0, 0.0], limit=2, offset=1, where="num_abstracts > 0")
    assert [(r.id, r.distance, r.has_more) for r in page.collect()] == [(2, 2.0, True), (3, 3.0, True)]
    assert vectors.vector_search(v, [0.0, 0.0], limit=10, offset=20).count() == 0
    with pytest.raises(ValueError):
        vectors.vector_search(v, [0.0, 0.0], limit=0)
    q = v.select(F.col("id").alias("query_id"), "embedding")
    assert {(r.query_id, r.id) for r in vectors.batch_knn(v, q, 1).collect()} == {(i, i) for i in range(6)}
    mean = vectors.author_embeddings(v.withColumn("a", F.col("id") % 2), "a").orderBy("author_id").collect()
    assert [(r.embedding[0], r.num_abstracts) for r in mean] == [(2.0, 3), (3.0, 3)]
    with pytest.raises(ValueError):
        vectors.embed_text(F.lit("x"), "no such model")


def test_ivf_recall(spark, tmp_path):
    r = random.Random(3)
    centers = [[r.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    data = [(i, [c + r.gauss(0, 0.4) for c in centers[i % 20]]) for i in range(1500)]
    v = spark.createDataFrame(data, "id long, embedding array<float>")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    vectors.write_ivf(v, f"{tmp_path}/ivf")
    measured = {x.nprobe: x.recall for x in vectors.ivf_recall(spark, f"{tmp_path}/ivf", q).collect()}
    assert measured[10] >= 0.9 and max(measured) == 128 and measured[128] == 1.0  # ten of 128 cells are enough
    true = {(x.query_id, x.id) for x in vectors.batch_knn(v, q, 10).collect()}
    found = vectors.ivf_search(spark, f"{tmp_path}/ivf", q, 10, 10)
    assert abs(len(true & {(x.query_id, x.id) for x in found.collect()}) / len(true) - measured[10]) < 1e-6
    assert rows(vectors.ivf_search(spark, f"{tmp_path}/ivf", q, 10, 10, block=7), "query_id", "rank") == rows(found, "query_id", "rank")
    assert rows(vectors.ivf_search(spark, f"{tmp_path}/ivf", q, 10, 128), "query_id", "rank") == rows(vectors.batch_knn(v, q, 10).select(found.columns), "query_id", "rank")
    one = vectors.ivf_search(spark, f"{tmp_path}/ivf", q.where("query_id = 50"), 10, 10)
    cells = vectors._cells_in_order(spark, f"{tmp_path}/ivf", vectors.np.array([data[50][1]]))[0, :10].tolist()
    plan = one._jdf.queryExecution().toString()  # the scan itself is limited to the probed cells
    assert "PartitionFilters: [cell#" in plan.replace("isnotnull(", "").replace("PartitionFilters: [(", "PartitionFilters: [") and "IN (" in plan
    assert vectors.ivf_bytes(spark, f"{tmp_path}/ivf", cells) < 0.25 * vectors.ivf_bytes(spark, f"{tmp_path}/ivf")


def test_rank_and_sort(spark):
    import datetime

    hits = spark.createDataFrame([("a", "A", 3, "100", 0.25), (None, "N", 1, "5", 0.1), ("b", "B", 1, None, 0.25)], "author_id string, author_name string, num_abstracts long, citation_count string, distance double")
    years = spark.createDataFrame([("a", 2024)], "author_id string, year int")
    r = search.rank_authors(hits, years, datetime.date(2026, 1, 1))
    assert [x.id for x in r.orderBy(*search.ranked_order()).collect()] == ["a", "b"]
    assert [x.id for x in r.orderBy(*search.resort_authors(r, "citation_count", False)).collect()] == ["b", "a"]


def test_identity(spark):
    d = spark.createDataFrame([("1", "John Doe", "j@x"), ("2", "Jon Doe", "k@x"), ("3", "Ann", None)], "uid string, cn string, mail string")
    asked = spark.createDataFrame([("john doe",), ("Jon Do",), ("ANN",)], "name string")
    found = identity.identity_lookup(d, asked)
    got = {(r.query, r.cn, r.exact) for r in found.collect()}
    assert {("john doe", "John Doe", True), ("john doe", "Jon Doe", False), ("Jon Do", "Jon Doe", False), ("ANN", "Ann", True)} <= got and ("john doe", "John Doe", False) not in got
    assert {r.query: r.message for r in identity.lookup_messages(found).collect()}["john doe"] == "exact match and suggestions"
    a = spark.createDataFrame([("Ann Lee", None, None, None), ("ann lee", "x@y", None, "Org"), ("  ", None, None, None)], "name string, email string, uid string, org_name string")
    entries = identity.build_directory(a, ["O"]).collect()
    assert len(entries) == 1 and entries[0].sn == "Lee"
    assert rows(identity.org_name_list(spark.createDataFrame([("",)], "name string"))) == [("DefaultOrg",)]


def test_blocks_of_queries(spark):
    names = [f"Name {k} of {'xyz'[k % 3]}" for k in range(40)]
    d = spark.createDataFrame([(str(k), n, f"{k}@x") for k, n in enumerate(names)], "uid string, cn string, mail string")
    asked = spark.createDataFrame([(n.lower() + "s",) for n in names[:20]], "name string")
    assert rows(identity.identity_lookup(d, asked, top=3), "query", "score", "cn") == rows(identity.identity_lookup(d, asked, top=3, block=6), "query", "score", "cn")
    v = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(30)], "id long, embedding array<float>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    assert rows(vectors.batch_knn(v, q, 3), "query_id", "rank") == rows(vectors.batch_knn(v, q, 3, block=7), "query_id", "rank")


def test_flags_count_different_ids(spark):
    w = spark.createDataFrame(
        [("w1", [("a1", "o1"), ("a1", "o1"), (None, "o1"), ("", "o1")], [(None, 1.0)], [("", "x")], "t", "d", "2001"), ("w2", [("a2", "o2")], [("t1", 1.0)], [("o9", "funder")], "t", "d", "2001")],
        "id string, authors array<struct<author_id:string,org_id:string>>, topics array<struct<topic_id:string,score:double>>, orgs array<struct<org_id:string,role:string>>, abstract string, doi string, publication_date string",
    )
    assert [(r.num_authors, r.has_authors, r.has_topics, r.has_orgs) for r in filters.work_flags(w).orderBy("id").collect()] == [(1, True, False, False), (1, True, True, True)]
    of = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r.id: r.all_orgs_present for r in quality.all_refs_present(w, of(["a2"]), of(["o2"]), of(["t1"])).collect()}["w2"] is False
    found = {r.author_id: (r.abstracts, r.num_abstracts) for r in vectors.author_abstracts(w).collect()}
    assert found["a1"] == (["t", "t"], 2)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "A", 5), (2, "B", 6)], "id long, name string, cites long")
    new = spark.createDataFrame([(2, 9), (3, 1)], "id long, cites long")
    assert rows(upsert.upsert_nodes(old, new), "id") == [(1, "A", 5), (2, "B", 9), (3, None, 1)]
    m = spark.createDataFrame([("k", 1, "x", ["o1"]), ("k", 3, "z", ["o2", "o1"]), ("k", 2, "y", None)], "id string, ts long, f string, org_ids array<string>")
    assert rows(upsert.upsert_entities(m, "id", "ts", ["f"], "org_ids")) == [("k", "z", 1, 3, ["o1", "o2"])]
    vec = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0], 3), (3, [], 3), (4, None, 3)], "id long, embedding array<double>, num_abstracts long")
    merged, rejected = upsert.upsert_vectors(vec.limit(0), vec, 2)
    assert [(r.id, r.num_abstracts, r.status) for r in merged.collect()] == [(1, 0, "created")] and rejected.count() == 3
    v = spark.createDataFrame([("a", "a", 0), ("b", "B", 0), ("c", "c", 4)], "author_id string, author_name string, citation_count long")
    k = spark.createDataFrame([("a", "Ann", 0), ("b", "Bea", 7), ("c", "c", 9)], "id string, name string, citation_count long")
    assert rows(upsert.metadata_repair(v, k).select("author_id", "author_name", "citation_count"), "author_id") == [("a", "Ann", 0), ("b", "B", 7), ("c", "c", 4)]
    assert rows(upsert.repair_counts(upsert.metadata_repair(v, k))) == [(3, 1, 1)]
    manifest = spark.createDataFrame([("f1", "processed"), ("f2", "failed")], "path string, status string")
    assert rows(upsert.incremental_files(spark.createDataFrame([("f1",), ("f2",), ("f3",)], "path string"), manifest), "path") == [("f2",), ("f3",)]


def test_stats(spark):
    p = publication(spark)
    c = stats.coverage_stats(p).first()
    assert (c.total, c.with_doi, c.with_citations, c.total_authors, c.pct_keywords) == (1, 0, 0, 3, 100.0)
    assert stats.coverage_stats(p.limit(0)).first().pct_doi is None
    cites = spark.createDataFrame([(1,), (5,), (3,), (9,), (None,)], "citations_count long")
    assert tuple(stats.citation_stats(cites).first()) == (4, 18, 4.5, 9, 1, 3)
    assert [r.name for r in stats.top_organizations(p).collect()] == ["X", "Y", "Z"]
    assert [(r.a, r.b) for r in stats.collaboration_pairs(p).collect()] == [("Ann", "Bob")]


def test_validate(spark):
    a = spark.createDataFrame([("author_" + "0" * 8 + "-0000-5000-8000-" + "0" * 12, "A", ["x", "x"], 1), ("bad", None, None, -1), ("bad", "B", None, 1)], "id string, name string, org_ids array<string>, h_index long")
    errors = {(r.id, r.h_index): set(r.errors) for r in quality.validate_entities(a, "author").collect()}
    assert errors[("bad", -1)] == {"id pattern", "name missing", "h_index below 0", "id repeats"} and len([e for e in errors.values() if e == {"org_ids repeat"}]) == 1
    good, quarantined = quality.split_valid(quality.validate_entities(a, "author"))
    assert good.count() == 0 and quarantined.count() == 3


def test_payload_defaults(spark):
    w = spark.createDataFrame([("w", None, "N", None, None, None, "2003-01")], "id string, title string, name string, type string, citation_count long, year int, publication_date string")
    r = entities.normalize_work_payload(w).first()
    assert (r.title, r.name, r.type, r.citation_count, r.year) == ("N", "N", "report", 0, 2003)
    o = entities.default_org_type(spark.createDataFrame([("o", "")], "id string, type string")).first()
    assert o.type == "institution"


@pytest.fixture(scope="module")
def linked(spark):
    """Works over few authors, organizations and topics, by a fixed rule."""
    pick = lambda i, k, n: f"{i * 7919 * k % 10007 % n:02d}"
    works = [
        (f"w{i:02d}", "a" if i % 4 else " ", "d" if i % 3 else None, f"{1990 + i}", [(f"a{pick(i, j + 1, 30)}", f"o{pick(i, j + 2, 20)}" if i % 5 else None) for j in range(i % 4)], [(f"o{pick(i, 5, 20)}", "affiliation")] if i % 6 else None, [(f"topic_{pick(i, 3, 12)}", 0.5)] if i % 7 else [])
        for i in range(45)
    ]
    w = spark.createDataFrame(works, "id string, abstract string, doi string, publication_date string, authors array<struct<author_id:string,org_id:string>>, orgs array<struct<org_id:string,role:string>>, topics array<struct<topic_id:string,score:double>>")
    a = spark.createDataFrame([(f"a{i:02d}", "A-B" if i % 9 == 0 else f"N{i}", [f"o{i % 20:02d}"] if i % 3 else [], i % 4, i % 5) for i in range(30)], "id string, name string, org_ids array<string>, works_count int, citation_count int")
    o = spark.createDataFrame([(f"o{i:02d}", f"O{i}", "US" if i % 3 == 0 else None) for i in range(20)], "id string, name string, country string")
    t = spark.createDataFrame([(f"topic_{i:02d}", f"T{i}", "Information science" if i % 2 else "Art") for i in range(8)], "id string, name string, field string")
    return works, (w, a, o, t)


def test_linked_subset_reuses(linked):
    works, tables = linked
    quotas = (("one", 4, "has_authors and has_topics"), ("two", 3, "not has_abstract"))
    got = quality.linked_subset(*tables, categories=quotas, target=12, strict=False)
    refs = {i: ({x for x, _ in a}, {x for _, x in a if x} | {x for x, _ in o or []}, {x for x, _ in t}) for i, _, _, _, a, o, t in works}
    info = {w[0]: w for w in works}
    seen, want = (set(), set(), set()), {}

    def cost(i):
        n = len(refs[i][0])
        return (*(len(r - s) for r, s in zip(refs[i], seen)), 0 if n == 1 else n, not info[i][1].strip(), int(info[i][3]), i)

    for name, n, holds in (("one", 4, lambda i: refs[i][0] and refs[i][2]), ("two", 3, lambda i: not info[i][1].strip()), ("fill", 5, lambda i: True)):
        for _ in range(n):
            fits = [i for i in refs if i not in want and holds(i) and all(len(r | s) <= m for r, s, m in zip(refs[i], seen, (40, 45, 12)))]
            want[best := min(fits, key=cost)] = name
            for r, s in zip(refs[best], seen):
                s |= r
    assert {r.id: r.category for r in got["works"].collect()} == want
    authors = {r.id: r.why for r in got["authors"].collect()}
    assert {i for i, why in authors.items() if why == "linked"} == seen[0] and len(authors) == max(12, len(seen[0]))
    assert {r.id for r in got["topics"].collect()} >= seen[2]
    assert all(r.name == f"Derived topic {r.id[6:]}" for r in got["topics"].collect() if r.id >= "topic_08")
    orgs = {r.id: r.why for r in got["orgs"].collect()}
    assert {i for i, why in orgs.items() if why == "linked"} == seen[1] | {o for r in got["authors"].collect() for o in r.org_ids}


def test_linked_subset_strict(linked):
    _, tables = linked
    with pytest.raises(ValueError, match="missing_everything"):
        quality.linked_subset(*tables, categories=(("missing_everything", 1, "not has_authors and has_authors"),))
    with pytest.raises(ValueError, match="2 works, not 50"):
        quality.linked_subset(*tables, categories=(("any", 2, "true"),))


def test_fill_authors(linked):
    _, (_, authors, _, _) = linked
    extras = quality._fill_authors(authors, ["a00"], {"o01"}, 9)
    free = ["a12", "a24"]  # no works; without organizations, by name
    assert extras[:2] == sorted(free, key=lambda i: f"N{int(i[1:])}") and len(extras) == 8 and len(set(extras)) == 8


def test_directory_of_many_organizations(spark):
    """Every organization of a table may be picked; the same name picks the same one again."""
    orgs = spark.range(500).select(F.format_string("Org %03d", "id").alias("name"))
    a = spark.range(4000).select(F.format_string("Name %d", "id").alias("name"), *(F.lit(None).cast("string").alias(c) for c in ("email", "uid", "org_name")))
    one = {r.cn: r.o for r in identity.build_directory(a, orgs).collect()}
    two = {r.cn: r.o for r in identity.build_directory(a.repartition(3), orgs.repartition(5)).collect()}
    assert one == two and len(one) == 4000 and len(set(one.values())) > 450
    assert identity.build_directory(a.limit(1), []).first().o == "DefaultOrg"


def test_lookup_scores_few_pairs(spark):
    """The same rows as scoring every name against every entry, from a small part of the pairs (the less, the more entries)."""
    r = random.Random(2)
    made = sorted({f"{r.choice(['Ana', 'Bo', 'Chen', 'Dmitri', 'Eva-Maria', 'José'])} {r.choice('ABC')}. {''.join(r.choice('aeiouklmnrst') for _ in range(r.randrange(4, 11)))}" for _ in range(500)} | {f"Customer#{i:09}" for i in range(0, 900, 3)})
    d = spark.createDataFrame([(str(i), n, f"{i}@x" if i % 5 else None) for i, n in enumerate(made)] + [("a", "", "e@x"), ("b", None, "n@x"), ("c", made[1], "z@x")], "uid string, cn string, mail string")
    asked = [n.replace("a", "e", 1) + "n" for n in made[::40]] + ["", "q", "Customer#00000012x", made[3].upper(), "JOSE", None]
    asked = spark.createDataFrame([(x,) for x in asked], "name string")
    mailed = sorted({n for i, n in enumerate(made) if i % 5} | {"", made[1]})

    def ratio(a, b):
        rows = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, rows[j] = rows[j], last + 1 if x == y else max(rows[j], rows[j - 1])
        return round(200 * rows[-1] / (len(a) + len(b)) + 1e-9, 2) if a or b else 100.0

    found = identity.identity_lookup(d, asked, top=10, block=30)
    got, exact = {}, {x.query: x.cn for x in found.where("exact").collect()}
    for x in found.where("not exact").collect():
        got.setdefault(x.query, []).append((-x.score, x.cn))
    for q in {x.name for x in asked.collect()} - {None}:
        best = sorted((-ratio(q, n), n) for n in mailed)[:10]
        assert sorted(got.get(q, [])) == [x for x in best if x[1] != exact.get(q)], q
    names = asked.where("name <> '' and length(name) > 4").select(F.col("name").alias("query")).distinct()
    of = d.where("mail is not null and cn is not null").groupBy("cn").agg(F.max("mail").alias("mail"))
    scored = identity.near_entries(of, names, 10).count()
    assert scored < 0.15 * names.count() * of.count()


def test_lookup_in_blocks_of_entries(spark):
    """Numbered names have many entries near their floor: each block of entries gives the best of each name alone, and together
    they give what scoring every pair gives."""

    def common(a, b):
        rows = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, rows[j] = rows[j], last + 1 if x == y else max(rows[j], rows[j - 1])
        return rows[-1]

    made = [f"Customer#{i:09}" for i in range(0, 2400, 2)] + ["n" * 150 + "é", "😀 Li"]
    of = spark.createDataFrame([(n, f"{n}@x") for n in made], "cn string, mail string")
    names = [f"Customer#{i:09}x" for i in range(0, 2400, 80)] + ["n" * 140, "😀Li"]
    found = identity.near_entries(of, spark.createDataFrame([(n,) for n in names], "query string"), 10, block=8, entries=300).collect()
    assert len(found) <= 10 * len(names) * 6
    got = {}
    for x in found:
        assert x.common == common(x.query, x.cn) and x.mail == f"{x.cn}@x"
        got.setdefault(x.query, []).append((-round(200 * x.common / (len(x.query) + len(x.cn)) + 1e-9, 2), x.cn))
    for q in names:
        assert sorted(got[q])[:10] == sorted((-round(200 * common(q, n) / (len(q) + len(n)) + 1e-9, 2), n) for n in made)[:10], q


def test_heavy_works(spark):
    """Blocks of a heavy work's authors give the rows that all pairs give; no cell has more than a pair of blocks."""
    r = random.Random(4)
    rows_ = sorted({(r.randrange(300), w) for w in range(40) for _ in range(2)} | {(a, 99) for a in range(120)} | {(7, 1000)})
    authored = spark.createDataFrame(rows_, "author_id long, work_id long")
    want = sorted({(a, b) for a, w in rows_ for b, x in rows_ if w == x and a != b})
    assert rows(graph.collaborators(authored, block=16), "author_id", "collaborator_id") == want
    assert rows(graph.collaborators(authored, 7, block=16), "collaborator_id") == [x for x in want if x[0] == 7]
    roots = spark.createDataFrame([(7,), (1,), (5000,)], "root long")
    net = sorted({(a, w, b) for a, w in rows_ for b, x in rows_ if w == x and a != b and a in (7, 1)} | {(a, w, None) for a, w in rows_ if a in (7, 1) and [b for b, x in rows_ if x == w] == [a]}, key=str)
    assert sorted(map(tuple, graph.network_rows(roots, authored, block=16).collect()), key=str) == net
    assert graph.network_rows(roots, authored, max_rows=5, block=16).groupBy("root").count().select("count").distinct().collect()[0][0] == 5
    p = spark.createDataFrame([([(f"n{i:03}",) for i in range(70)] + [("n001",), ("",), (None,)],), ([("n001",), ("n002",)],), ([("x",)],), (None,)], "authors array<struct<name:string>>")
    whole, cut = stats.collaboration_pairs(p, 5000), stats.collaboration_pairs(p, 5000, block=16)
    assert rows(whole, "a", "b") == rows(cut, "a", "b") and whole.count() == 70 * 69 // 2 and tuple(whole.first()) == ("n001", "n002", 2)


def test_networks_by_brute_force(spark):
    """Nodes and edges of some roots, with repeated rows, unknown ids and a heavy work, as plain loops give them."""
    r = random.Random(8)
    pairs = [(r.randrange(40), r.randrange(30)) for _ in range(150)] + [(a, 99) for a in range(600)] + [(3, None), (None, 3), (3, 5), (3, 5)]
    authored = spark.createDataFrame(pairs, "author_id long, work_id long")
    authors = spark.createDataFrame([(a, f"A {a}") for a in range(590)] + [(3, "A 0"), (None, "none")], "id long, name string")
    works = spark.createDataFrame([(w, f"T {w}", f"{2000 + w}-01", None) for w in range(25)] + [(99, "T", None, None), (5, "T 0", None, 1990)], "id long, title string, publication_date string, year int")
    orgs = spark.createDataFrame([(0, "Uni"), (1, "Lab")], "id long, name string")
    member = sorted({(a, a % 3) for a in range(60)})
    affiliated = spark.createDataFrame(member + member[:5], "author_id long, org_id long")
    asked = [3, 7, 8, 8, 595, 5000]
    roots = spark.createDataFrame([(a,) for a in asked] + [(None,)], "root long")
    by = {}
    for a, w in set(pairs):
        if a is not None and w is not None:
            by.setdefault(w, set()).add(a)
    title, name = {w: (f"T {w}", str(2000 + w)) for w in range(25)} | {99: ("T", "N/A"), 5: ("T 0", "1990")}, {a: f"A {a}" for a in range(590)} | {3: "A 0"}
    nodes, edges, every = set(), set(), set()
    for x in set(asked):
        first = {}
        if x in name:
            nodes.add((x, f"author:{x}", "author", name[x], None))
        for w in sorted(w for w, who in by.items() if x in who):
            edges.add((x, f"author:{x}", f"work:{w}", "AUTHORED"))
            if w in title:
                nodes.add((x, f"work:{w}", "work", *title[w]))
            for c in by[w] - {x}:
                first.setdefault(c, w)
                every.add((x, f"author:{c}", f"work:{w}", "AUTHORED"))
        nodes |= {(x, f"author:{c}", "coauthor", name[c], None) for c in first if c in name}
        nodes |= {(x, f"org:{o}", "organization", ("Uni", "Lab")[o], None) for a, o in member if a == x and o < 2}
        edges |= {(x, f"author:{c}", f"work:{w}", "AUTHORED") for c, w in first.items()} | {(x, f"author:{x}", f"org:{o}", "AFFILIATED_WITH") for a, o in member if a == x}
    net = lambda **how: graph.ego_network(roots, authors, works, orgs, authored, affiliated, **how)
    plain = lambda rows_: sorted(map(tuple, rows_), key=str)
    for how in ({}, {"together": True}, {"max_rows": 10_000}):
        n, e = net(**how)
        assert plain(n.drop("email").collect()) == plain(nodes), how
        assert plain(e.collect()) == plain(edges), how
    assert plain(net(all_edges=True)[1].collect()) == plain(edges | every)


def test_nodes_shuffle_ids_alone(spark, corpus):
    """Nodes are never dealt by root and id, which would shuffle all their texts once more."""
    works, authors, orgs, _ = corpus
    e, f = graph.authored_edges(works, authors), graph.affiliated_edges(works, authors, orgs)
    nodes = graph.ego_network(authors.select(F.col("id").alias("root")), authors, works, orgs, e, f)[0]
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(root" in plan and not any("hashpartitioning(root" in line and ", id#" in line for line in plan.splitlines())


def test_facets_need_no_coauthors(spark, corpus):
    """With the roots' table, facets of all of them come without a join for pairs of authors."""
    works, authors, orgs, _ = corpus
    e, f = graph.authored_edges(works, authors), graph.affiliated_edges(works, authors, orgs)
    roots = spark.createDataFrame([("a1",), ("a2",), ("none",)], "root string")
    nodes = graph.ego_network(roots, authors, works, orgs, e, f)[0]
    facets = graph.distinct_facets(nodes, roots)
    assert "co_author" not in facets._jdf.queryExecution().sparkPlan().toString()
    assert rows(facets, "root") == [("a1", ["2020", "2016"], ["Uni"]), ("a2", ["2020"], []), ("none", [], [])]
    assert rows(graph.distinct_facets(nodes), "root") == [("a1", ["2020", "2016"], ["Uni"]), ("a2", ["2020"], [])]


def test_view_of_works_needs_no_pairs(spark, corpus):
    """Works of a year are found without a join for pairs of authors."""
    works, authors, orgs, _ = corpus
    e, f = graph.authored_edges(works, authors), graph.affiliated_edges(works, authors, orgs)
    nodes = graph.ego_network(authors.select(F.col("id").alias("root")), authors, works, orgs, e, f)[0]
    shown = filters.filter_graph_view(nodes, "author:a1", year="2016").where(F.col("group") == "work").select("root", "id")
    assert "co_author" not in shown._jdf.queryExecution().sparkPlan().toString()
    assert rows(shown, "root") == [("a1", "work:w2"), ("a3", "work:w2")]


def test_median_by_ranges(spark):
    for values in ([5], [1, 2], [3, 3, 1, 9, 9, 9, 2], list(range(-50_000, 70_001, 7)), [-(1 << 63), (1 << 63) - 1, 0, 5, 5], [1 << 62, 3, -(1 << 62)]):
        got = stats.citation_stats(spark.createDataFrame([(v,) for v in values], "citations_count long").where("true")) if sum(values) < 1 << 62 else None
        want = sorted(values, reverse=True)[len(values) // 2]
        if got is not None and abs(sum(values)) < 1 << 62:
            assert tuple(got.first())[-3:] == (max(values), min(values), want)
        counts = spark.createDataFrame([(v, values.count(v)) for v in set(values)] if len(values) < 100 else [(v, 1) for v in values], "v long, k long")
        assert stats.nth_largest(counts, len(values) // 2, min(values), max(values)) == want
    assert stats.citation_stats(spark.createDataFrame([(None,)], "citations_count long")).count() == 0
    many = spark.range(0, 10_000_000, 1, 8).select(((F.col("id") * 7919) % 10_000_000 * 3).alias("citations_count"))
    assert stats.citation_stats(many).first()["median"] == 3 * (10_000_000 - 1 - 5_000_000)


def test_payloads_and_repeats(spark):
    a = spark.createDataFrame([("r1", [("dtic", "r1")], 5, 6), ("r2", None, 1, 2)], "researcher_id string, sources array<struct<source:string,id:string>>, works_count long, citation_count long")
    full = json.dumps({"orcid": ["0-1"], "sources": [{"id": "publication_plus", "value": "9", "meta": [{"id": "citations", "value": 4.0}]}]})
    got = entities.author_metrics_enrich(a, spark.createDataFrame([("r2", full), ("r2", "{}"), ("r3", full)], "researcher_id string, json string"))
    assert {(r.researcher_id, r.works_count, r.citation_count, len(r.sources)) for r in got.collect()} == {("r1", 5, 6, 1), ("r2", 9, 4, 1)}
    p = spark.createDataFrame([("p", ["/a", "x"]), ("p", ["/b", "/a", "/b"]), (None, ["/none"]), ("q", None), ("p", ["/a", "x"])], "publication_id string, keywords array<string>")
    pay = spark.createDataFrame([("/a", '["1","2"]'), ("/a", '["9"]'), ("/b", "[]"), ("/c", "[]")], "url string, payload string")
    out = publications.amplify_keywords(p, pay, F.lit("now"))
    assert sorted(map(str, ((r.publication_id, r.keywords, r.keywords_urls, r.keywords_amplified, r.keywords_amplified_at) for r in out.collect()))) == sorted(map(str, [
        ("p", ["1", "2", "x"], ["/a"], True, "now"), ("p", ["1", "2", "x"], ["/a"], True, "now"), ("p", ["1", "2"], ["/b", "/a", "/b"], True, "now"), (None, ["/none"], None, False, None), ("q", None, None, False, None)]))


def test_every_rule_has_a_failing_row(spark):
    uid = "00000000-0000-5000-8000-00000000000"
    good = {"id": f"work_{uid}0", "title": "T", "publication_date": "2020-02-29", "citation_count": 0, "authors": [("a", None)], "orgs": [("o", "funder")], "topics": [("t", 0.5)], "sources": [("dtic", "x")], "url": "https://x/y?z", "last_updated": "2020-01-01T10:00:00Z"}
    schema = "id string, title string, publication_date string, citation_count long, authors array<struct<author_id:string,org_id:string>>, orgs array<struct<org_id:string,role:string>>, topics array<struct<topic_id:string,score:double>>, sources array<struct<source:string,id:string>>, url string, last_updated string, extra int"
    bad = {
        "id pattern": {"id": "work_1"}, "title missing": {"title": None}, "publication_date format": {"publication_date": "2021-02-29"}, "citation_count below 0": {"citation_count": -1}, "authors.author_id missing": {"authors": [("a", None), (None, "o")]},
        "authors null item": {"authors": [None]}, "orgs.org_id missing": {"orgs": [(None, "other")]}, "orgs.role missing": {"orgs": [("o", None)]}, "orgs.role unknown": {"orgs": [("o", "boss")]}, "topics.topic_id missing": {"topics": [(None, 1.0)]},
        "topics.score missing": {"topics": [("t", None)]}, "topics.score below 0": {"topics": [("t", -0.1)]}, "topics.score above 1": {"topics": [("t", 1.5)]}, "sources.source missing": {"sources": [(None, "x")]}, "sources.id missing": {"sources": [("dtic", None)]},
        "sources.source unknown": {"sources": [("web", "x")]}, "url format": {"url": "no scheme"}, "last_updated format": {"last_updated": "yesterday"}, "unexpected field extra": {"extra": 1},
    }
    names = [c.split(" ")[0] for c in ("id title publication_date citation_count authors orgs topics sources url last_updated extra").split(" ")]
    made = [tuple((good | {"id": f"work_{uid[:-1]}{i:02x}"} | change).get(c) for c in names) for i, change in enumerate(bad.values())]
    got = [set(r.errors) for r in quality.validate_entities(spark.createDataFrame(made, schema).coalesce(1), "work").collect()]
    assert sorted(map(sorted, got)) == sorted([k] for k in bad)
    assert quality.validate_entities(spark.createDataFrame([tuple(good.get(c) for c in names)], schema), "work").first().errors == []
    assert quality.validate_entities(spark.createDataFrame([(None, 1.0)], "id string, h_index double"), "author").first().errors == ["id missing", "name missing"]
    kinds = {"type": "object", "properties": {"id": {}, "n": {"type": "integer", "minimum": 2}, "o": {"type": "object", "properties": {"a": {"type": "string", "enum": ["x"]}}, "required": ["b"], "additionalProperties": False}}}
    rows_ = spark.createDataFrame([("1", 1.5, ("y", 1))], "id string, n double, o struct<a:string,c:int>")
    assert quality.validate_entities(rows_, "work", kinds).first().errors == ["n not an integer", "n below 2", "o.b missing", "o.a unknown", "unexpected field o.c"]
