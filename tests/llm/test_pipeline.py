"""Each stage of the pipeline over what the one before kept, against brute force."""

import pytest

pytest.importorskip("citeloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from citeloom.llm import simhash
from citeloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        results.append(docs.collect())
    start, langs, near, clean, mixed, tokens = results
    assert {r.doc_id for r in langs} == {r.doc_id for r in start if any(c.isalpha() for c in r.text)}
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in langs}
    group = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    assert {r.doc_id for r in near} == set(group.values())
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in near for w in items if " ".join(w) in " ".join(r.text.lower().split())}
    assert leaks and {r.doc_id for r in clean} <= {r.doc_id for r in near} - leaks and len(clean) >= len(near) - 2 * len(leaks)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and len(tokens) == len(mixed)
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed)
    assert corpus_pipeline.run(spark, SF).count() == len(tokens)


def test_scratch_tables_are_freed(spark, tmp_path):
    """What an operator keeps between its jobs goes with ``freed``; what was written from it stays."""
    import os

    from citeloom.llm import common, simhash

    before = set(os.listdir(common.shared_folder(spark))) if os.path.isdir(common.shared_folder(spark)) else set()
    docs = spark.createDataFrame([(i, f"one two three four five {i % 3}") for i in range(20)], "doc_id long, text string")
    with common.freed(spark):
        simhash.near_duplicates(spark, docs).write.parquet(f"{tmp_path}/out")
        assert set(os.listdir(common.shared_folder(spark))) - before
    assert set(os.listdir(common.shared_folder(spark))) <= before and spark.read.parquet(f"{tmp_path}/out").count() == 20
