"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Language ID drops texts without a language; SimHash near-dedup keeps one document of each group; decontamination drops
documents that leak a benchmark item; mixing repeats documents to their sources' target rates and shuffles them; the
last stage writes token-id files and reports on every document from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import decontamination, language_id, mixing, simhash, token_files
from citeloom.llm.common import Scratch, freed, table

TOKENIZER = "word_bpe_49k.json"
#: Pieces that a worker remembers: few, as the pipeline's other stages share its memory.
PIECES = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the automata learn from the folds of ``docs`` that aren't held out."""
    model = language_id.train(docs.select("doc_id", "text", "lang").where(language_id.fold(3) != 1))
    return language_id.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id."""
    return simhash.one_of_each_group(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of ``benchmark``."""
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' rates, in random order."""
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every copy of a document, from the files."""
    folder = Scratch(spark, "pipeline").path("files")
    token_files.write(spark, docs, public_tokenizers.path(TOKENIZER), folder, room=PIECES)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("cells").alias("ids_crc32"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

#: SQL has no suffix automata, XXH64 or BPE.  tests/llm/test_pipeline.py holds the stages' decisions against plain rules, and
#: tests/llm/test_corpus.py and test_texts.py the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's result is a table in the shared scratch folder, and what the stage kept
    besides is freed."""
    scratch = Scratch(spark, "stages")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with freed(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_").replace("/", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
