"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, hard_negatives, html_text, jaccard_join, language_id, line_dedup, mixing, quality_rules, repeats, simhash, token_files, toxicity
from .common import Scratch, table
from .language_id import fold


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = (fold(4) == 2).alias("held_out")
    scorer = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, scorer)
    return found.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_html_text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_mixing_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixing.shuffle(copies).select("row.doc_id", "row.source", "copy", "n_copies", F.round("place", 12).alias("place"), "row.text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op5_repeats_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Scratch(spark, "op6").path("files")
    token_files.write(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("cells").alias("ids_crc32"))


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(spark, table(spark, sf_dir, "documents")).drop("text")  # the cleaned text is the operator's; a digest needs no texts moved


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_decontamination_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (fold(3) == 1).alias("held_out")
    found = language_id.identify(docs, language_id.train(docs.where(~held)))
    return found.select("doc_id", held, "lang_pred", "score")


def op11_divergence_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op12_hard_negatives_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark, table(spark, sf_dir, "embeddings"))


def op13_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity_nnpu": op1_toxicity_nnpu,
    "op2_html_text_ratio": op2_html_text_ratio,
    "op3_mixing_poisson": op3_mixing_poisson,
    "op4_quality_rules": op4_quality_rules,
    "op5_repeats_interval_tree": op5_repeats_interval_tree,
    "op6_token_huffman": op6_token_huffman,
    "op7_line_edit_join": op7_line_edit_join,
    "op8_simhash_golay": op8_simhash_golay,
    "op9_decontamination_simhash": op9_decontamination_simhash,
    "op10_language_cross_parsing": op10_language_cross_parsing,
    "op11_divergence_transducer": op11_divergence_transducer,
    "op12_hard_negatives_slots": op12_hard_negatives_slots,
    "op13_grouped_prefix_join": op13_grouped_prefix_join,
}
ORACLES: dict[str, str] = {"op3_mixing_poisson": mixing.ORACLE, "op4_quality_rules": quality_rules.ORACLE, "op11_divergence_transducer": divergence.ORACLE, "op12_hard_negatives_slots": hard_negatives.ORACLE}
