"""Queries of the text operators over the given tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgemark.llm import (
    counts,
    decontaminate,
    extract,
    languages,
    lm,
    packing,
    quality,
    repeats,
    secrets,
    simhash,
    simple8b,
    spelling,
    whitening,
)
from hedgemark.llm.answers import DECONTAMINATION, REPEATS
from hedgemark.llm.common import crc_fold, table


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return lm.score_documents(docs.withColumn("held_out", crc_fold(F.col("doc_id"), 5) == 1))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write_token_files(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return simple8b.read_token_files(files)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = decontaminate.Benchmark(table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    judged = decontaminate.judge(table(spark, sf_dir, "documents", ["doc_id", "text"]), benchmark, ["doc_id"])
    return judged.drop("hits")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents", ["doc_id", "text"]), ["doc_id"])


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    filters = languages.fit(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    found = docs.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"),
                        languages.predicted(F.col("text"), filters, spark).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents", ["doc_id", "text"]), ["doc_id"]).drop("parts")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    found = pages.select("page_id", "url", extract.main_text(F.col("html")).alias("text"))
    return found.select("*", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]), ["doc_id"])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


LLM_QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_packing": op2_packing,
    "op3_token_files": op3_token_files,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_languages": op6_languages,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_main_text": op9_main_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_substring_dedup": op13_substring_dedup,
}

LLM_ANSWERS = {
    "op4_decontamination": DECONTAMINATION,
    "op13_substring_dedup": REPEATS,
}
