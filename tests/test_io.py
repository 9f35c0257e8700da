import gzip
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from citeloom.operators import upsert
from citeloom.operators.manifest import Manifest
from citeloom.sources import io
from citeloom.sources.buckets import BucketedTable
from citeloom.streaming import watch


def test_shards(spark, tmp_path):
    good = [json.dumps({"id": f"a{i}", "name": f"N{i}"}) for i in range(3)]
    (tmp_path / "dtic_authors_001.jsonl.gz").write_bytes(gzip.compress("\n".join([good[0], "", "   ", "NOT VALID JSON", good[1]]).encode()))
    (tmp_path / "dtic_authors_002.jsonl.gz").write_bytes(b"not gzip")
    (tmp_path / "dtic_authors_003.jsonl.gz").write_bytes(gzip.compress(good[2].encode()))
    assert {r.id for r in io.read_entity_shards(spark, str(tmp_path), "authors").where("id is not null").collect()} == {"a0", "a1", "a2"}
    assert io.read_entity_shards(spark, str(tmp_path), "topics").count() == 0


def test_round_trip(spark, tmp_path):
    df = spark.range(30_000).select(F.format_string("t%06d", "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(None).cast("string").alias("field"))
    names = io.write_entity_shards(df.repartition(3), f"{tmp_path}/out", "topics", target_bytes=200_000)
    files = sorted((tmp_path / "out").glob("dtic_topics_*.jsonl.gz"))
    assert [f.name for f in files] == names and names[0] == "dtic_topics_001.jsonl.gz" and not [f for f in (tmp_path / "out").iterdir() if f.is_dir()]
    sizes = [f.stat().st_size for f in files]
    assert len(sizes) > 5 and abs(sum(sizes) / len(sizes) - 200_000) < 40_000
    lines = [json.loads(x) for f in files for x in gzip.decompress(f.read_bytes()).decode().splitlines()]
    assert [x["id"] for x in lines] == sorted(x["id"] for x in lines) and "field" not in lines[0]
    back = io.read_entity_shards(spark, f"{tmp_path}/out", "topics")
    assert back.count() == 30_000 and back.select("id", "name", "field").exceptAll(df).count() == 0
    s = io.shard_stats(spark.read.json(f"{tmp_path}/out"), F.lit("topics")).first()
    assert (s.rows, s.files) == (30_000, len(names))
    again = io.write_entity_shards(df.limit(10), f"{tmp_path}/out", "topics")  # replaces the shards of before, and only the entity's
    assert again == ["dtic_topics_001.jsonl.gz"] and io.read_entity_shards(spark, f"{tmp_path}/out", "topics").count() == 10
    io.write_entity_shards(df.select("id", "name").limit(5), f"{tmp_path}/out", "orgs")
    assert io.write_entity_shards(df.limit(0), f"{tmp_path}/out", "topics") == [] and io.read_entity_shards(spark, f"{tmp_path}/out", "topics").count() == 0
    assert io.read_entity_shards(spark, f"{tmp_path}/out", "orgs").count() == 5
    io.write_sorted_jsonl(df.limit(1), f"{tmp_path}/sorted")
    assert next((tmp_path / "sorted").glob("*.txt")).read_text().startswith('{"id":')


def test_publications_and_guard(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"publication_id": "p", "title": "T", "authors": [{"name": "A"}, {"name": "B"}], "keywords": ["x", {"entities": []}]}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    p = io.read_publications(spark, str(tmp_path)).cache()
    assert tuple(io.load_stats(p).first()) == (1, 1)
    row = io.csv_rows(p.where("publication_id is not null")).first()
    assert row.authors == "A; B" and row.doi == ""
    assert io.load_guard(spark.range(100)) and not io.load_guard(spark.range(99)) and not io.load_guard(spark.range(200), force=True)
    assert io.limit_per_file(spark.range(10), 2, "id", F.col("id") % 3).count() == 6


def test_graph_documents(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a", "A"), (1, "b", None), (2, "c", 'say "x"'), (3, "d", "D")], "root long, id string, label string")
    some = [(1, "a", f"t{i}") for i in range(100_000)] + [(2, "c", "d"), (9, "no", "node")]
    edges = spark.createDataFrame(some, "root long, source string, target string")
    io.export_graph_json(nodes, edges, f"{tmp_path}/g")
    found, decoder = {}, json.JSONDecoder()
    for f in (tmp_path / "g").glob("*.txt"):
        text = f.read_text().strip()
        while text:
            doc, end = decoder.raw_decode(text)
            found[doc["root"]], text = doc, text[end:].strip()
    assert sorted(found) == [1, 2, 3] and found[3] == {"root": 3, "nodes": [{"id": "d", "label": "D"}], "edges": []}
    assert found[2] == {"root": 2, "nodes": [{"id": "c", "label": 'say "x"'}], "edges": [{"source": "c", "target": "d"}]}
    assert found[1]["nodes"] == [{"id": "a", "label": "A"}, {"id": "b"}] and sorted(e["target"] for e in found[1]["edges"]) == sorted(t for r, _, t in some if r == 1)


def test_graph_documents_shuffle_once(spark):
    """Nodes and edges are dealt by root once, as texts; no table of roots is made beside them."""
    nodes = spark.range(100).selectExpr("id % 9 as root", "cast(id as string) as id")
    edges = spark.range(100).selectExpr("id % 12 as root", "cast(id as string) as source")
    pieces = io.graph_pieces(nodes, edges)
    assert pieces._jdf.queryExecution().sparkPlan().toString().count("Join") == 0 and pieces._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.root for r in pieces.collect()} == set(range(9))


def test_watch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []

    def merge(batch, number):
        seen.extend(r.publication_id for r in batch.where("publication_id is not null").collect())

    def run():
        stream = watch.publication_stream(spark, f"{tmp_path}/in")
        watch.watch_publications(stream, merge, f"{tmp_path}/check", once=True).awaitTermination(60)

    (tmp_path / "in" / "1.json").write_text('{"publication_id": "p1"}')
    run()
    (tmp_path / "in" / "2.json").write_text('{"publication_id": "p2"}')
    run()
    assert seen == ["p1", "p2"]


ROWS = [(f"k{i % 37}", (i * 7) % 50, f"v{i}") for i in range(300)]
TABLE = "id string, v string, created_at long, last_updated long"


def cut(tmp_path, files=12):
    (tmp_path / "in").mkdir()
    for f in range(files):
        lines = [json.dumps({"id": k, "ts": ts, "v": v}) for k, ts, v in ROWS[f::files]] + ["{broken"] * (f % 2)
        (tmp_path / "in" / f"{f:02}.json").write_text("\n".join(lines))


@pytest.mark.parametrize("dies", ["before", "between", "after"])
def test_watch_survives_a_crash(spark, tmp_path, dies):
    """A merge that dies before it writes, before it commits, or before the stream knows that it ended, is applied once."""
    cut(tmp_path)
    table = BucketedTable(spark, f"{tmp_path}/table", "id", TABLE, buckets=8)
    good, put, deaths = watch.merging(table, "ts", ["v"]), table.files.put, []

    def bad(batch, number):
        if number == 2 and dies == "before":
            raise RuntimeError("killed")
        if number == 2 and dies == "between":
            table.files.put = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
        good(batch, number)
        if number == 2 and dies == "after":
            raise RuntimeError("killed")

    def run(merge):
        stream = watch.publication_stream(spark, f"{tmp_path}/in", "id string, ts long, v string", per_batch=2, multi_line=False)
        watch.watch_publications(stream, merge, f"{tmp_path}/check", once=True).awaitTermination(120)

    with pytest.raises(StreamingQueryException):
        run(bad)
    table.files.put = put
    run(good)
    want = upsert.upsert_entities(spark.createDataFrame(ROWS, "id string, ts long, v string"), "id", "ts", ["v"])
    assert sorted(map(tuple, table.read().collect())) == sorted((r.id, r.v, r.created_at, r.last_updated) for r in want.collect())
    assert table.totals() == {"processed": 300, "failed": 6}
    table.vacuum()
    assert table.read().count() == 37 and table.last()[0] == 5


def test_merges_leave_other_buckets_alone(spark, tmp_path):
    table = BucketedTable(spark, f"{tmp_path}/t", "id", "id long, name string, n long", buckets=16)
    merge = lambda rows, batch: table.merge(spark.createDataFrame(rows, "id long, name string, n long"), upsert.upsert_nodes, batch)
    assert merge([(i, f"a{i}", i) for i in range(200)], 0)
    files = set(table.read().inputFiles())
    before = table.last()[1]["buckets"]
    assert merge([(3, "new", None), (1000, "more", 1)], 1) and not merge([(4, "twice", 0)], 1)
    after = table.last()[1]["buckets"]
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2
    assert len(files & set(table.read().inputFiles())) == len(files) - sum(before[b] != after[b] for b in before)
    want = upsert.upsert_nodes(spark.createDataFrame([(i, f"a{i}", i) for i in range(200)], "id long, name string, n long"), spark.createDataFrame([(3, "new", None), (1000, "more", 1)], "id long, name string, n long"))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    assert table.merge(spark.createDataFrame([], "id long, name string, n long"), upsert.upsert_nodes, 2) and table.read().count() == 201


def test_manifest_with_a_crash(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i:02}",) for i in range(20)], "path string")
    manifest = Manifest(spark, f"{tmp_path}/manifest")
    broken, seen = {"f03", "f07"}, []

    def process(todo, attempt):
        seen.append([r.path for r in todo.orderBy("path").collect()])
        return todo.where("path <> 'f19'").select("path", ~F.col("path").isin(*broken), F.when(F.col("path").isin(*broken), "bad JSON")).toDF("path", "ok", "reason")

    def dies(todo, attempt):
        raise RuntimeError("killed")

    assert manifest.run(files, process, limit=8) == {"processed": 6, "failed": 2, "skipped": 0}
    with pytest.raises(RuntimeError):
        manifest.run(files, dies)
    assert {r.path: r.status for r in manifest.state().collect()}["f15"] == "started"
    broken.remove("f07")
    assert manifest.run(files, process) == {"processed": 12, "failed": 2, "skipped": 6}  # f03 again, and f19 without an outcome
    assert seen[0] == [f"f{i:02}" for i in range(8)] and seen[1] == ["f03", "f07"] + [f"f{i:02}" for i in range(8, 20)]
    state = {r.path: (r.status, r.attempts, r.reason) for r in manifest.state().collect()}
    assert state["f07"] == ("processed", 3, None) and state["f03"] == ("failed", 3, "bad JSON") and state["f19"] == ("failed", 2, "no outcome") and state["f00"] == ("processed", 1, None)


def test_stream_upsert(spark, tmp_path):
    for k, (ts, v) in enumerate([(1, "x"), (5, "z"), (3, "y")]):
        (tmp_path / f"{k}.json").write_text(json.dumps({"id": "a", "ts": ts, "v": v}))
    stream = spark.readStream.schema("id string, ts long, v string").json(str(tmp_path))
    q = watch.stream_upsert(stream, "id", "ts", ["v"]).writeStream.format("memory").queryName("upserted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("upserted").collect()] == [("a", "z", 1, 5)]
