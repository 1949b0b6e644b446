"""A training corpus from raw documents: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgemark.llm import decontaminate, languages, neardup, packing, secrets
from hedgemark.llm.common import table
from hedgemark.sources.tables import stage

#: A document whose best language explains less of its n-grams than this is taken for none of the learned languages.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages: those without a letter, or that none explains, go.

    Where no document is labelled there is nothing to judge by and all documents with a letter stay.
    """
    filters = languages.fit(docs.select("doc_id", "text", "lang"))
    if not filters.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = list(docs.columns)
    judged = docs.select(F.struct(*names).alias("whole"), languages.predicted(F.col("text"), filters, spark).alias("p"))
    kept = judged.where((F.col("p.lang_pred") != languages.UNKNOWN) & (F.col("p.score") >= MIN_LANGUAGE_SCORE))
    return kept.select("whole.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    SimHash classes and MinHash bands give the candidates; exact Jaccard similarity of 5-word shingles, at least 0.8, decides.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_contaminated(
        docs, decontaminate.Benchmark(table(spark, sf_dir, "benchmark", ["item_id", "text"])))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts blanked out."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Bloom filters, SimHash fingerprints and tokenizers have no SQL form; tests/llm/test_pipeline.py holds plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each one's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
